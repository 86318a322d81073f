"""Embedding near-duplicates by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import connected_components, mixed, staged

#: Dimensions of a block of the rotated space.
BLOCK_DIMS = 16
#: Coordinates of a block by which its grid is laid.
GRID_DIMS = 2
#: Rows of a cell that are compared in one task; larger cells are dealt into parts, and each pair of parts is a task's.
CELL_ROWS = 2048
#: Slack for rounding in the filter; the verification has none.
SLACK = 1e-6


def rotation(dims: int, seed: int = 5) -> np.ndarray:
    """A fixed random rotation, so that no block holds all of the distance by design of the embedding."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int) -> list[tuple[int, int]]:
    return [(a, min(a + BLOCK_DIMS, dims)) for a in range(0, dims, BLOCK_DIMS)]


def _forward(g: int) -> list[tuple[int, ...]]:
    """Of the neighbouring cells, one of each opposite pair."""
    offs = [()]
    for _ in range(g):
        offs = [(*o, d) for o in offs for d in (-1, 0, 1)]
    return [o for o in offs if o > (0,) * g]


def near_vectors(vectors: DataFrame, cosine: float, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: id, n_links (other vectors linked directly), component_id, kept.

    Two vectors with equal labels and lengths link when their cosine in double precision is at least ``cosine``.

    1. Equal vectors of a label are one, with a count; the least id stands for them.
    2. Unit vectors are rotated and split into blocks of ``BLOCK_DIMS``. A linked pair's squared distance is at most
       2 - 2 cos, so in some block it is at most the block's share by dimensions. Each block is range-joined on its
       own: a grid of that radius over its first coordinates, every row in its cell and as a guest in half of the
       neighbouring cells, so a pair of neighbours meets once. Distances within the block decide what is a candidate.
    3. A cell with more rows than a task should compare is dealt into parts; each pair of parts is a task's.
    4. The union of the blocks' candidates is verified on the whole vectors.

    Vectors that are null, empty or zero, or hold null or non-finite components, and those without a label or an id
    link with nothing: n_links 0, their own id as component. Rows that repeat an id and a vector count as copies.
    An empty table gives no rows. Further columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    groups = rows.filter("good").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = staged(groups, "vectors")
    most = 2 - 2 * cosine + SLACK

    def cells(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            values, ends = batch.column(2).flatten().to_numpy(), np.cumsum([0, *(len(x) for x in batch.column(2))])
            dims = np.diff(ends)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = np.stack([values[ends[i] : ends[i + 1]] for i in at])
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                x = x @ rotation(d)
                labels = batch.column(1).to_numpy()[at].view(np.uint64)
                for k, (a, b) in enumerate(blocks_of(d)):
                    radius = np.sqrt(most * (b - a) / d)
                    g = min(GRID_DIMS, b - a)
                    cell = np.floor(x[:, a : a + g] / radius).astype(np.int64)
                    raw = pa.array(list(map(bytes, x[:, a:b].astype("<f8"))), pa.binary())
                    for offset in [(0,) * g, *_forward(g)]:
                        key = mixed(labels + np.uint64(d * 1000 + k))
                        for j, o in enumerate(offset):
                            key = mixed(key * np.uint64(31) + (cell[:, j] + o).astype(np.uint64))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key.view(np.int64)), batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), any(offset))), pa.array(np.full(len(at), radius * radius)), raw],
                            names=["key", "rep", "guest", "most", "x"],
                        )

    def candidates(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def done(reps, guests, blocks, key, most, xs):
            x = np.stack([np.frombuffer(v, "<f8") for v in xs])
            sq = (x * x).sum(1)
            rep, guest, block = np.array(reps), np.array(guests), np.array(blocks)
            for a in range(0, len(x), 1024):
                near = sq[a : a + 1024, None] + sq - 2 * x[a : a + 1024] @ x.T <= most + SLACK
                p, q = np.nonzero(near)
                p += a
                # at home both: once; home and guest: as they are; of two parts: one of each
                keep = (rep[p] != rep[q]) & ~guest[p] & (guest[q] | (p < q))
                if key[1] != key[2]:
                    keep &= block[p] != block[q]
                if keep.any():
                    u, v = rep[p[keep]], rep[q[keep]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

        at, held = None, []
        for batch in batches:
            for key, i, j, rep, guest, block, most_, x in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if (key, i, j) != at:
                    if len(held) > 1:
                        yield from done(*list(zip(*held, strict=True))[:3], at, held[0][3], [h[4] for h in held])
                    at, held = (key, i, j), []
                held.append((rep, guest, block, most_, x))
        if len(held) > 1:
            yield from done(*list(zip(*held, strict=True))[:3], at, held[0][3], [h[4] for h in held])

    def verified(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ends = np.cumsum([0, *(len(x) for x in batch.column(4))])
            a, b = batch.column(4).flatten().to_numpy(), batch.column(5).flatten().to_numpy()
            total = lambda x: np.add.reduceat(x, ends[:-1]) if len(x) else np.zeros(0)
            with np.errstate(over="ignore", under="ignore", invalid="ignore"):
                dot, norms = total(a * b), np.sqrt(total(a * a)) * np.sqrt(total(b * b))
                odd = ~(np.isfinite(dot) & np.isfinite(norms) & (norms > 1e-200))
            cos = np.divide(dot, norms, out=np.full(len(dot), -2.0), where=~odd)
            for i in np.flatnonzero(odd):  # squares beyond what doubles hold: scaled first
                p, q = (y[ends[i] : ends[i + 1]] / np.abs(y[ends[i] : ends[i + 1]]).max() for y in (a, b))
                cos[i] = p @ q / np.sqrt((p @ p) * (q @ q))
            ok = pa.array(cos >= cosine)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(ok) for k in range(4)], names=["u", "v", "nu", "nv"])

    label_key = F.xxhash64("label").alias("label")
    placed = reps.select("rep", label_key, "v").mapInArrow(cells, "key long, rep long, guest boolean, most double, x binary")
    sizes = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("parts"))
    dealt = placed.join(sizes, "key").withColumn("part", F.expr("cast(pmod(xxhash64(rep), parts) as int)"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "rep", "guest", "part", "most", "x")
    found = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(candidates, "u long, v long").distinct()
    # Representatives of equal labels only: the label is checked here, as cells go by its hash.
    one = reps.select(F.col("rep").alias("u"), F.col("label").alias("lu"), F.col("copies").alias("nu"), F.col("v").alias("x"))
    two = reps.select(F.col("rep").alias("v"), F.col("label").alias("lv"), F.col("copies").alias("nv"), F.col("v").alias("y"))
    pairs = found.join(one, "u").join(two, "v").filter("lu = lv AND size(x) = size(y)").select("u", "v", "nu", "nv", "x", "y")
    links = staged(pairs.mapInArrow(verified, "u long, v long, nu long, nv long"), "vector-links")
    others = links.select(F.col("u").alias("rep"), F.col("nv").alias("n")).union(links.select("v", "nu")).groupBy("rep").agg(F.sum("n").alias("n"))
    comp = connected_components(links.select("u", "v"), "vector-components").withColumnRenamed("node", "rep")
    of = reps.join(others, "rep", "left").join(comp, "rep", "left").select(
        "label", "v", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    linked = rows.filter("good").join(of, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
