"""Token ids of all documents in shards, each one compressed wavelet matrix."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._shared import input_bytes

#: A shard ends with the document that reaches so many ids.
SHARD_IDS = 1 << 18
#: Bytes of stored input for each range of documents; a range has many shards, and one is held at a time.
RANGE_BYTES = 128 << 20


def write_store(docs: DataFrame, vocabulary: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text and writes the shards to ``path``, in ascending order of the id.

    The texts are exchanged once, into ranges of the id whose number follows the size of the input; a range is
    sorted, encoded and packed in one task, which holds one shard at a time. Shards are written as binary values of
    a Parquet table, so any store that Spark can write will do and a task that is run again leaves no trace.
    ``shard`` numbers ascend with the id. Null and empty texts have the end id only; a null id comes first; rows
    that repeat an id stay neighbours, ordered by a hash of the text, and may be split among ranges.
    """
    n = max(4 * docs.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(docs) // RANGE_BYTES))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from tessera.llm import wavelet
        from tessera.llm.encoding import encoder

        enc = encoder(vocabulary)
        part, seq = TaskContext.get().partitionId(), 0
        held, ids, lengths, size = [], [], [], 0

        def shard():
            nonlocal held, ids, lengths, size, seq
            row, found = ((part << 20) + seq, sum(map(len, lengths)), size), pa.chunked_array(ids)
            blob = wavelet.pack(np.concatenate(held), found.fill_null(0).to_numpy(), np.concatenate(lengths), found.is_valid().to_numpy())
            held, ids, lengths, size, seq = [], [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in row), pa.array([blob], pa.binary())], names=["shard", "n_docs", "n_ids", "data"])

        for batch in batches:
            for a, b, tokens, ends in enc.encode_documents(batch.column(1), end_id):
                # cut where shards end: with the documents that reach a multiple of their size
                while a < b:
                    k = min(len(ends) - 1, int(np.searchsorted(ends, ends[0] + SHARD_IDS - size)))
                    held.append(tokens[ends[0] : ends[k]])
                    ids.append(batch.column(0).slice(a, k))
                    lengths.append(np.diff(ends[: k + 1]))
                    size, a, ends = size + int(ends[k] - ends[0]), a + k, ends[k:]
                    if size >= SHARD_IDS:
                        yield shard()
        if ids:
            yield shard()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    rows = rows.repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")
    rows.mapInArrow(run, "shard long, n_docs long, n_ids long, data binary").write.option("compression", "uncompressed").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, read from the shards alone: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    store = spark.read.parquet(path)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tessera.llm.wavelet import Shard, crc

        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [(number, d, at, len(x), crc(x)) for d, at, x in Shard(data.as_buffer()).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = store.select("shard", "data").mapInArrow(run, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    # One row per shard, the blobs left aside: running sums in two steps, ranges of documents (one row for RANGE_BYTES
    # of input, so few enough for one task) and shards within one.
    sizes = store.select("shard", "n_ids", F.shiftright("shard", 20).alias("part"))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.withColumn("w", within).join(parts, "part").select("shard", (F.coalesce("w", F.lit(0)) + F.coalesce("before", F.lit(0))).alias("first"))
    return docs.join(firsts, "shard").select(
        "doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_counts(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Occurrences of one id in each shard, by rank in its file: shard, n."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tessera.llm.wavelet import Shard

        for batch in batches:
            n = [Shard(x.as_buffer()).count(token) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["shard", "n"])

    return spark.read.parquet(path).select("shard", "data").mapInArrow(run, "shard long, n long")
