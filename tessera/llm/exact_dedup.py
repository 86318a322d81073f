"""Exact deduplication by 128-bit content hash, with byte comparison inside the hash groups. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import SPACE


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are first grouped by (128-bit hash, bytes): grouping on the hash decides where a text goes, and the
    grouping key's second part compares the bytes, so two texts that share a hash stay two groups. Partial
    aggregation leaves one row per text and input partition before the exchange, however many copies there are.
    The rows then meet their group through the hash and the SHA-256, without moving texts a second time; should
    two texts agree in both, the query fails instead of merging them.

    Null and empty texts are one text. Rows without an id come last: their group's keep_id is null only if no
    member has an id, and they are never kept beside one that has. Rows that repeat an id with an equal text are
    one document and are marked alike. An empty table gives no rows. Further columns of ``docs`` are not read.
    """
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    keyed = rows.select("doc_id", "t", F.md5(F.encode("t", "UTF-8")).alias("h"))
    groups = keyed.groupBy("h", "t").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("h", F.sha2(F.encode("t", "UTF-8"), 256).alias("s"), "keep_id", "group_size")
    one = groups.groupBy("h", "s").agg(F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("n"))
    one = one.select("h", "s", "keep_id", F.when(F.col("n") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share MD5 and SHA-256")).cast("long")).alias("group_size"))
    members = keyed.select("doc_id", "h", F.sha2(F.encode("t", "UTF-8"), 256).alias("s"))
    return members.join(one, ["h", "s"]).select(
        F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("s").alias("text_sha256")
    )


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The whole rows that ``exact_dedup`` keeps, one for each text: that with the smallest id.

    Rows without an id come last; of rows that are alike in the id, that with the smaller raw text stays, and of rows
    alike in both any one. Texts are grouped by hash and bytes as above; copies are reduced to their best row before
    the exchange, so a text with any number of copies sends one row for each input partition, and each text is moved
    once. Any further columns, whatever their names, are carried.
    """
    text, given = normalised(F.col(text_col)), F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    keyed = docs.select(given.alias("given"), text.alias("t")).select("given", "t", F.md5(F.encode("t", "UTF-8")).alias("h"))
    order = F.struct(F.col(f"given.{id_col}").isNull(), F.col(f"given.{id_col}"), F.col(f"given.{text_col}"))
    best = keyed.groupBy("h", "t").agg(F.min_by("given", order).alias("given"))
    return best.select(*(F.col(f"given.`{c}`").alias(c) for c in docs.columns))
