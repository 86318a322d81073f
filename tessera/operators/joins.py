"""Join patterns that Spark has no keyword for, without theta joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(facts: DataFrame, history: DataFrame, keys: Sequence[str], at: str, valid_from: str) -> DataFrame:
    """Each row of ``facts`` with the columns of the latest ``history`` row of its keys whose ``valid_from`` is not after ``at``.

    Both sides are put in one order per key and the last history row is carried forward: one exchange and a sort,
    where a join on the interval would compare all versions of a key with all its facts. Facts without a match
    keep nulls. Of history rows that begin at the same time, the last by its columns' order counts.
    """
    carried = [c for c in history.columns if c not in keys and c != valid_from]
    state = F.struct(*carried)
    left = facts.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*facts.columns).alias("_fact"), F.lit(None).cast(history.select(state.alias("s")).schema["s"].dataType).alias("_state"))
    right = history.select(*keys, F.col(valid_from).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_fact"].dataType).alias("_fact"), state.alias("_state"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side", "_state").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("_state", F.last("_state", ignorenulls=True).over(w))
    return both.filter("_side = 1").select("_fact.*", *(F.col(f"_state.{c}").alias(c) for c in carried))


def allocate(facts: DataFrame, bridge: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """``value`` of each fact spread over its group's members by their share of ``weight``: column ``allocated``."""
    share = F.col(weight) / F.sum(weight).over(Window.partitionBy(group))
    return bridge.withColumn("_w", share).join(facts, group).withColumn("allocated", F.col(value) * F.col("_w")).drop("_w")


def depth(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, keys: Sequence[str] = (), closed: bool = True, width: int = 3600) -> DataFrame:
    """``points`` with the number of ``spans`` of their keys that hold them, [start, end] or, unless ``closed``, [start, end): column ``depth``.

    Starts and ends are changes of a running sum, so no pair of a point and a span is formed. Sums run in two steps,
    within buckets of ``width`` seconds and over the buckets, so no key's rows are ordered in one task.
    """
    row = F.struct(*points.columns)
    none = F.lit(None).cast(points.select(row.alias("r")).schema["r"].dataType)
    order = (0, 1, 2) if closed else (0, 1, 0)  # of starts, points and ends at the same time
    real = spans.filter(F.col(start) <= F.col(end) if closed else F.col(start) < F.col(end))
    marks = [(real, start, order[0], 1, none), (points, at, order[1], 0, row), (real, end, order[2], -1, none)]
    parts = [df.select(*keys, F.col(t).alias("_t"), F.lit(o).alias("_o"), F.lit(d).alias("_d"), r.alias("_row")) for df, t, o, d, r in marks]
    all_ = parts[0].union(parts[1]).union(parts[2]).filter("_t IS NOT NULL").withColumn("_b", F.floor(F.unix_micros(F.col("_t").cast("timestamp")) / (width * 1_000_000)))
    sums = all_.groupBy(*keys, "_b").agg(F.sum("_d").alias("_s"))
    before = sums.select(*keys, "_b", (F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_s")).alias("_before"))
    inner = F.sum("_d").over(Window.partitionBy(*keys, "_b").orderBy("_t", "_o"))
    out = all_.withColumn("_in", inner).filter("_row IS NOT NULL").join(before, [*keys, "_b"])
    return out.select("_row.*", (F.col("_in") + F.col("_before")).cast("long").alias("depth"))


def open_at_start(spans: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """For each span the number of spans [start, end) of its group, itself included, that hold its start: column ``depth``."""
    return depth(spans, spans, start, start, end, [group], closed=False)


def stab(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, keys: Sequence[str] = (), width: int = 86_400) -> DataFrame:
    """Pairs of points and intervals [start, end] (timestamps) that hold them: an equi-join on buckets of ``width`` seconds, then the exact test."""
    cell = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (width * 1_000_000))
    left = points.withColumn("_b", cell(F.col(at)))
    right = intervals.withColumn("_b", F.explode(F.sequence(cell(F.col(start)), cell(F.col(end)))))
    return left.join(right, [*keys, "_b"]).filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_b")
