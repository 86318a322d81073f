"""Dealing weighted items to bins."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lpt(items: DataFrame, key: str, weight: str, bins: int, classes: int = 4096) -> DataFrame:
    """Each item with its bin, heaviest first to the lightest bin: key, weight, bin.

    The rule is sequential, so items are dealt by weight class: those of a class (one of ``classes`` steps of the
    weight's range) are numbered and go round over the bins, and only the classes' counts, a bounded table, are
    dealt on the driver. No bin is heavier than under the plain rule by more than the width of a class for each of
    its items.
    """
    lo, hi = items.agg(F.min(weight), F.max(weight)).first()
    if lo is None:
        return items.select(key, weight, F.lit(0).alias("bin"))
    width = (hi - lo) / classes or 1.0
    c = items.select(key, weight, F.floor((F.col(weight) - lo) / width).cast("int").alias("_c"))
    counts = sorted(((r["_c"], r["n"]) for r in c.groupBy("_c").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    load = [(0.0, b) for b in range(bins)]
    order = []
    for k, n in counts:
        w = lo + (k + 0.5) * width
        ranked = [b for _, b in sorted(load)]
        share = [n // bins + (i < n % bins) for i in range(bins)]
        now = dict((b, x) for x, b in load)
        for b, s in zip(ranked, share, strict=True):
            now[b] += s * w
        load = [(x, b) for b, x in now.items()]
        order.append((k, ranked))
    heapq.heapify(load)
    plan = items.sparkSession.createDataFrame(order, "_c int, _bins array<int>")
    from pyspark.sql.window import Window

    i = (F.row_number().over(Window.partitionBy("_c").orderBy(F.desc(weight), key)) - 1) % bins
    return c.withColumn("_i", i).join(F.broadcast(plan), "_c").select(key, weight, F.get("_bins", F.col("_i")).alias("bin"))
