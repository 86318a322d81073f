"""Interval algebra on rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column, open_ends: bool = False) -> Column:
    """Whether [a0, a1] and [b0, b1] share a point; with open ends, more than a point."""
    return (a0 < b1) & (b0 < a1) if open_ends else (a0 <= b1) & (b0 <= a1)


def contains(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 <= b0) & (b1 <= a1)


def intersection(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """struct(start, end), null where the intervals share nothing."""
    s, e = F.greatest(a0, b0), F.least(a1, b1)
    return F.when(s <= e, F.struct(s.alias("start"), e.alias("end")))


def merged(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Unions of overlapping or touching intervals per key: keys, start, end, n."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    top = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("_new", F.when(F.col(start) <= top, 0).otherwise(1))
    d = d.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_i").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_i")
