"""Decomposing overlapping sets given as (set_key, element) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def euler(members: DataFrame) -> DataFrame:
    """The non-empty regions of the sets' Euler diagram: sets (sorted array), elements (sorted array)."""
    per = members.groupBy("element").agg(F.array_sort(F.collect_set("set_key")).alias("sets"))
    return per.groupBy("sets").agg(F.array_sort(F.collect_list("element")).alias("elements"))


def boundaries(members: DataFrame) -> DataFrame:
    """For each set those that share an element with it: set_key, neighbours. Found through the distinct regions, not through pairs of rows."""
    regions = members.groupBy("element").agg(F.array_sort(F.collect_set("set_key")).alias("sets")).select("sets").distinct()
    pairs = regions.select(F.explode("sets").alias("set_key"), "sets").select("set_key", F.explode("sets").alias("other")).filter("set_key <> other")
    return pairs.groupBy("set_key").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))
