"""Reading an ordered table page by page."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def after(keys: Sequence[str], last: Sequence) -> Column:
    """(k1, k2, ...) > last, written so that the first key's bound reaches the scan."""
    out = F.lit(False)
    for k in range(len(keys) - 1, -1, -1):
        out = (F.col(keys[k]) > F.lit(last[k])) | ((F.col(keys[k]) == F.lit(last[k])) & out)
    return (F.col(keys[0]) >= F.lit(last[0])) & out


def pages(df: DataFrame, keys: Sequence[str], size: int) -> Iterator[list[Row]]:
    """Keyset pages: each asks for the rows after the last one seen, so a page costs the same wherever it lies."""
    last = None
    while True:
        found = (df if last is None else df.filter(after(keys, last))).orderBy(*keys).limit(size).collect()
        if not found:
            return
        yield found
        last = [found[-1][k] for k in keys]
