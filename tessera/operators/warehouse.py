"""Incremental warehouse patterns: slowly changing dimensions, islands, cumulative activity, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import bitmaps


def islands(snapshots: DataFrame, keys: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """Versions from daily snapshots: keys, values, valid_from, valid_to (last day seen; null if seen on the last snapshot day), version.

    A version ends where the values change; days without a snapshot do not end it.
    """
    w = Window.partitionBy(*keys).orderBy(at)
    state = F.struct(*values)
    marked = snapshots.withColumn("_new", (~state.eqNullSafe(F.lag(state).over(w))).cast("int"))
    marked = marked.withColumn("version", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    last = snapshots.agg(F.max(at).alias("_last"))
    spans = marked.groupBy(*keys, *values, "version").agg(F.min(at).alias("valid_from"), F.max(at).alias("_to"))
    return spans.crossJoin(F.broadcast(last)).withColumn("valid_to", F.when(F.col("_to") < F.col("_last"), F.col("_to"))).drop("_to", "_last")


def scd1(dim: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The dimension with new and changed rows taken over from ``source``."""
    values = [c for c in dim.columns if c not in keys]
    new = source.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in values), F.lit(True).alias("_in"))
    return dim.join(new, list(keys), "full_outer").select(*keys, *(F.when(F.col("_in"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in values))


def scd2(dim: DataFrame, source: DataFrame, keys: Sequence[str], values: Sequence[str], day: Column) -> DataFrame:
    """One day's load: dim has keys, values, valid_from, valid_to, version, active. Changed rows close the day before and open a version."""
    live = dim.filter("active").select(*keys, *(F.col(c).alias(f"_o_{c}") for c in values), F.col("version").alias("_v"))
    now, old = F.struct(*values), F.struct(*(F.col(f"_o_{c}").alias(c) for c in values))
    delta = source.select(*keys, *values).join(live, list(keys), "left").filter(F.col("_v").isNull() | ~now.eqNullSafe(old))
    opened = delta.select(*keys, *values, day.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), (F.coalesce("_v", F.lit(0)) + 1).cast("long").alias("version"), F.lit(True).alias("active"))
    closing = delta.filter("_v IS NOT NULL").select(*keys, F.lit(True).alias("_close"))
    kept = dim.join(closing, list(keys), "left")
    ends = F.col("active") & F.coalesce("_close", F.lit(False))
    kept = kept.withColumn("valid_to", F.when(ends, F.date_sub(day, 1)).otherwise(F.col("valid_to"))).withColumn("active", F.col("active") & ~ends)
    return kept.select(*keys, *values, "valid_from", "valid_to", "version", "active").unionByName(opened)


def scd3(dim: DataFrame, source: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The dimension with ``value`` and ``previous``: a change moves the old value over."""
    new = source.select(*keys, F.col(value).alias("_n"))
    changed = F.col("_n").isNotNull() & F.col(value).isNotNull() & ~F.col("_n").eqNullSafe(F.col(value))
    both = dim.join(new, list(keys), "full_outer")
    return both.select(*keys, F.coalesce("_n", value).alias(value), F.when(changed, F.col(value)).otherwise(F.col("previous")).alias("previous"))


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``target`` with the rows of ``source``; of several source rows with a key the first by ``order`` counts."""
    one = source.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")
    return target.join(one.select(*keys), list(keys), "left_anti").unionByName(one)


def cumulative_day(yesterday: DataFrame, today: DataFrame, key: str, day: Column) -> DataFrame:
    """State (key, days array, bitmap) of ``day`` from the day before's and the day's active keys; run again, it gives the same."""
    new = today.select(key).distinct().withColumn("_active", F.lit(True))
    both = yesterday.join(new, key, "full_outer")
    active = F.coalesce("_active", F.lit(False))
    days = F.coalesce("days", F.array().cast("array<date>"))
    return both.select(key, F.when(active, F.array_append(days, day)).otherwise(days).alias("days"), bitmaps.shifted(F.col("bitmap"), active).alias("bitmap"))


def cumulative_grid(activity: DataFrame, key: str, at: str, since: Column, until: Column) -> DataFrame:
    """All states of a range of days at once: key, day, days (count so far), bitmap."""
    per = activity.groupBy(key).agg(F.array_sort(F.collect_set(at)).alias("_d"))
    grid = per.withColumn("day", F.explode(F.sequence(since, until))).filter(F.col("day") >= F.array_min("_d"))
    return grid.select(key, "day", F.size(F.filter("_d", lambda d: d <= F.col("day"))).cast("long").alias("days"), bitmaps.from_days(F.col("_d"), F.col("day")).alias("bitmap"))


def monthly_arrays(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Per key and month the daily values up to the last day seen: key, month, daily (0 where none), total, bitmap (bit 31 is day 1)."""
    day = rows.groupBy(key, F.trunc(at, "month").alias("month"), F.dayofmonth(at).alias("_n")).agg(F.sum(value).alias("_v"))
    per = day.groupBy(key, "month").agg(F.map_from_entries(F.collect_list(F.struct("_n", "_v"))).alias("_m"), F.max("_n").alias("_top"), F.sum("_v").alias("total"), F.sum(bitmaps.day_of_month_bit(F.col("_n"))).alias("bitmap"))
    daily = F.transform(F.sequence(F.lit(1), F.col("_top")), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    return per.select(key, "month", daily.alias("daily"), "total", "bitmap")
