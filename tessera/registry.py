"""Registering named queries together with the SQL that gives the same rows elsewhere."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under ``name``."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return put


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Registers Spark SQL whose tables are written ``{name}``. Without ``oracle`` the text holds in both dialects."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = set(re.findall(r"\{(\w+)\}", text))
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})

    QUERIES[name] = run
    SQL[name] = oracle or re.sub(r"\{(\w+)\}", r"\1", text)
