"""Access to the test tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``; any path Spark's readers can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
