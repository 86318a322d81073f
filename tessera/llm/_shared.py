"""What several operators of this subpackage need: staging, connected components, word hashes."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, \t, \n, \v, \f, \r.
SPACE = r"[\x20\x09-\x0D]+"


_folders: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of our own only in local mode, where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_folders[-1] if _folders else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of ours that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession, name: str):
    """Tables staged inside go to a folder of their own, which is removed at the end; results must be written before."""
    _folders.append(new_path(spark, name))
    try:
        yield
    finally:
        remove(spark, _folders.pop())


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage ends there, and a lost executor loses nothing.

    The shuffle files behind the table serve nothing once it is written, and go with the end of the query.
    """
    spark = df.sparkSession
    path, key = new_path(spark, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def forget_tokens() -> None:
    """Drops what a reused worker may hold from encoding; it is made anew when needed."""
    encoding = sys.modules.get("tessera.llm.encoding")
    if encoding is not None:
        encoding.forget()


def input_bytes(df: DataFrame) -> int:
    """Bytes that the planner expects of ``df``: for a table read from files, the size of the files. 0 where it can't tell."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 60 else 0


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, v) long pairs -> (node, component): the smallest node reachable, for every node of an edge.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Each round is two grouped minima with
    map-side combining and joins on the node, so a star around one node is not gathered in one task by the
    aggregation, and adaptive execution may split the join. Rounds end when all edges lead to their component's
    smallest node.
    """
    spark = edges.sparkSession

    def halved(e: DataFrame, larger_only: bool) -> DataFrame:
        """Edges (a, b) with a > b, after one star step."""
        if larger_only:  # large-star: of every node's neighbourhood, the larger ones meet its smallest
            both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            out = both.filter("b > a").join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        else:  # small-star: the smaller neighbours and the node itself meet the smallest
            low = e.groupBy("a").agg(F.min("b").alias("m"))
            out = e.join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).union(low.select(F.col("a"), F.col("m")))
        return out.filter("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()

    def done(e: DataFrame) -> bool:
        """Every edge leads to a node that is the end of all of its own: the components are stars."""
        nodes = e.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(e.select("b", F.lit(0)))
        return nodes.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).filter("ups > 1 OR (ups = 1 AND least = 0)").isEmpty()

    u, v = edges.columns[:2]
    now = staged(edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).filter("a != b").distinct(), name)
    while not done(now):
        before, now = now, staged(halved(halved(now, True), False), name)
        for path in {f.rsplit("/", 1)[0] for f in before.inputFiles()}:
            remove(spark, path)
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


# -- hashes of words over whole batches -------------------------------------------------------------------------

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "i" if inverse else "p"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = np.full(size, _INVERSE if inverse else _BASE, dtype=np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        _POWERS[key] = have = out
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finish (the one of splitmix64), so that near values end far apart."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte slices of ``data``; equal bytes give equal hashes wherever they stand."""
    n = len(data)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _powers(n), out=prefix[1:])
    return mixed((prefix[ends] - prefix[starts]) * _powers(n + 1, True)[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def batch_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string or binary array as (bytes, offsets); nulls are empty. One copy at most."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks_of(offsets: np.ndarray, most: int = 1 << 22):
    """Row ranges (from, to) of about ``most`` bytes each, one row at least: bounds what is held for a batch."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


_GAP = np.zeros(256, dtype=bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a batch, and for each row the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    gap = _GAP[data]
    first = ~gap
    first[1:] &= gap[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] |= ~gap[edges]
    last = ~gap
    last[:-1] &= gap[1:]
    last[edges - 1] |= ~gap[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = slice_hashes(_LOWER[data] if lower else data, starts, ends)
    return hashes, np.searchsorted(starts, offsets)
