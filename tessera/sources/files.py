"""Reading and writing files: delimited text with quarantine, JSON dictionaries, HTML tables, layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_delimited(spark: SparkSession, path: str, names: Sequence[str] | None = None, sep: str = ";") -> DataFrame:
    """A glob of headerless delimited files as strings: c1, c2, ... or ``names``; NUL bytes are dropped."""
    df = spark.read.csv(path, sep=sep, header=False)
    df = df.toDF(*(names or [f"c{i + 1}" for i in range(len(df.columns))]))
    return df.select(*(F.translate(c, "\x00", "").alias(c) for c in df.columns))


def split_bad(df: DataFrame, checks: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose columns cast to the types in ``checks``, cast; and the others as they are."""
    ok = F.lit(True)
    for c, kind in checks.items():
        ok = ok & (F.col(c).isNull() | F.col(c).try_cast(kind).isNotNull())
    good = df.filter(ok).select(*(F.col(c).cast(checks[c]).alias(c) if c in checks else c for c in df.columns))
    return good, df.filter(~ok)


def parse_log_lines(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Syslog lines that end in ': ' and a JSON object -> (appname, severity, timestamp), and the lines that hold none."""
    body = F.from_json(F.regexp_extract(col, r"^.*?: (\{.*\})\s*$", 1), "appname string, severity string, timestamp string", {"mode": "PERMISSIVE"})
    d = lines.withColumn("_j", body)
    return d.filter("_j.appname IS NOT NULL").select("_j.*"), d.filter("_j IS NULL OR _j.appname IS NULL").drop("_j")


def read_sets(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document {key: [values]} as (set_key, element) rows."""
    text = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string, array<string>>")
    return text.select(F.explode(m).alias("set_key", "v")).select("set_key", F.explode("v").alias("element"))


def html_rows(pages: DataFrame, id_col: str, html_col: str, cells: int | None = None) -> DataFrame:
    """Rows of HTML tables: id, row, cells (trimmed, tags removed); with ``cells``, only rows of that many."""
    row = F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "_r")
    out = pages.select(id_col, row)
    inner = F.regexp_extract_all("_r", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    out = out.select(id_col, "row", F.transform(inner, lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", ""))).alias("cells"))
    return out.filter(F.size("cells") == cells) if cells is not None else out


def write_layout(df: DataFrame, path: str, by: Sequence[str] = (), files: int | None = None, compression: str = "zstd") -> None:
    """Parquet, flat or partitioned. A partition's rows are brought together first, so each has few files."""
    if by:
        df = df.repartition(*by) if files is None else df.repartition(files, *by)
    w = df.write.mode("overwrite").option("compression", compression)
    (w.partitionBy(*by) if by else w).parquet(path)


def overwrite_days(df: DataFrame, path: str, day: str) -> None:
    """Replaces exactly the days that ``df`` holds; run again, it gives the same."""
    df.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
