"""Mixing sources to target weights by Pfair scheduling. DataFrame functions only; the plan is a small table."""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Name under which all sources without a weight of their own are mixed.
REST = "*"
#: Documents of a source are numbered within so many ranges of their hash, so that no source is ranked in one task.
RANGES = 1024


def pfair(counts: Mapping[str, int]) -> list[str]:
    """One period of ``sum(counts)`` slots in which each name gets its count.

    Block i of a name with weight w = count / slots is released at floor((i - 1) / w) and due at ceil(i / w);
    each slot goes to the released block with the earliest deadline. On one processor this meets all deadlines,
    so after every slot each name is less than one block away from w times the slots so far.
    """
    slots = sum(counts.values())
    waiting = [(0, name, 1) for name, c in sorted(counts.items()) if c]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out: list[str] = []
    for now in range(slots):
        while waiting and waiting[0][0] <= now:
            _, name, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-i * slots // counts[name]), name, i))
        due, name, i = heapq.heappop(ready)
        if due <= now:
            raise AssertionError("a deadline was missed")
        out.append(name)
        if i < counts[name]:
            heapq.heappush(waiting, (i * slots // counts[name], name, i + 1))
    return out


def plan(blocks: Mapping[str, int], weights: Mapping[str, int]) -> list[tuple[int, int, int, int, dict[str, int]]]:
    """Segments (first slot, slots of a period, periods, number, counts of a period) until no block is left.

    A segment repeats one period as often as all its names can fill it. Then the names that cannot fill another
    whole period spend the rest in one shorter period and leave; the others' weights hold on among themselves.
    """
    left = {k: n for k, n in blocks.items() if n}
    out, at = [], 0
    while left:
        period = {k: weights[k] for k in left}
        times = min(n // period[k] for k, n in left.items())
        if not times:
            period, times = {k: min(n, period[k]) for k, n in left.items()}, 1
        out.append((at, sum(period.values()), times, len(out), period))
        at += sum(period.values()) * times
        left = {k: n - times * period[k] for k, n in left.items() if n > times * period[k]}
    return out


def mix(docs: DataFrame, weights: Mapping[str, int], rest_weight: int = 1, block_docs: int = 16, id_col: str = "doc_id", source_col: str = "source", seed: int = 17) -> DataFrame:
    """One row per document: id, mix_source, block (of its source), slot, position.

    ``weights`` are small whole numbers; they and ``rest_weight`` (for all sources not named, null included)
    bound the plan: at most two segments for each name, each of sum(weights) slots at most, whatever the number
    of documents. A source is dealt into blocks of ``block_docs`` documents in the order of a seeded hash of the
    id; its last block may be short. ``slot`` is the block's place in the mix, ``position`` the document's.

    Every document appears once: a source that runs out leaves, and the others go on at their weights. Documents
    are numbered in two steps, within a range of the hash and by running counts over the ranges, so neither a
    large source nor a large table is ranked in one task. Documents without an id are placed among the others;
    rows that repeat an id get places of their own.
    """
    if any(not isinstance(w, int) or w < 1 for w in (*weights.values(), rest_weight)):
        raise ValueError("weights are whole numbers of 1 or more")
    spark = docs.sparkSession
    all_weights = {**weights, REST: rest_weight}
    name = F.when(F.col(source_col).isin(*weights), F.col(source_col)).otherwise(F.lit(REST))
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), name.alias("mix_source"), h.alias("h"), F.shiftrightunsigned(h, 54).cast("int").alias("r"))
    counts = rows.groupBy("mix_source", "r").agg(F.count(F.lit(1)).alias("n"))
    # (names of weights + 1) x RANGES rows at most
    table = sorted((x["mix_source"], x["r"], x["n"]) for x in counts.collect())
    before, total = [], {}
    for s, r, n in table:
        before.append((s, r, total.get(s, 0)))
        total[s] = total.get(s, 0) + n
    blocks = {s: -(-n // block_docs) for s, n in total.items()}
    segments = plan(blocks, all_weights)
    slots, used = [], dict.fromkeys(blocks, 0)
    for at, size, times, k, period in segments:
        seen: dict[str, int] = {}
        for place, s in enumerate(pfair(period)):
            slots.append((s, k, seen.get(s, 0), period[s], used[s], used[s] + times * period[s], at, size, place))
            seen[s] = seen.get(s, 0) + 1
        for s, c in period.items():
            used[s] += times * c
    offsets = spark.createDataFrame(before, "mix_source string, r int, before long")
    within = F.row_number().over(Window.partitionBy("mix_source", "r").orderBy("h", "doc_id"))
    ranked = rows.withColumn("i", within.cast("long") - 1).join(F.broadcast(offsets), ["mix_source", "r"])
    ranked = ranked.withColumn("i", F.col("i") + F.col("before")).withColumn("block", F.expr(f"i div {block_docs}"))
    # The segment of a block, then its slot in the period: two small tables of proven size.
    seg = {(s, k): (s, k, lo, hi, c, at, size) for s, k, _, c, lo, hi, at, size, _ in slots}
    segs: dict[str, list] = {}
    for s, k, lo, hi, c, at, size in seg.values():
        segs.setdefault(s, []).append((k, lo, hi, c, at, size))
    seg_type = T.StructType([T.StructField("mix_source", T.StringType()), T.StructField("segs", T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("k", "lo", "hi", "c", "at", "size")])))])
    seg_table = spark.createDataFrame([(s, v) for s, v in segs.items()], seg_type)
    slot_table = spark.createDataFrame([(s, k, j, place) for s, k, j, _, _, _, _, _, place in slots], "mix_source string, k long, j long, place long")
    placed = ranked.join(F.broadcast(seg_table), "mix_source").withColumn("seg", F.filter("segs", lambda x: (x["lo"] <= F.col("block")) & (F.col("block") < x["hi"]))[0])
    placed = placed.select("doc_id", "mix_source", "i", "block", F.col("seg.*"))
    placed = placed.withColumn("j", (F.col("block") - F.col("lo")) % F.col("c")).withColumn("turn", F.expr("(block - lo) div c"))
    placed = placed.join(F.broadcast(slot_table), ["mix_source", "k", "j"]).withColumn("slot", F.col("at") + F.col("turn") * F.col("size") + F.col("place"))
    # A document's position: full blocks before it, less what short last blocks lack (one for each name).
    short = [(s, blocks[s] * block_docs - n) for s, n in total.items()]
    ends = {s: _slot_of(blocks[s] - 1, segs[s], {(x[0], x[1], x[2]): x[8] for x in slots}, s) for s in blocks}
    lacks = F.lit(0).cast("long")
    for s, lack in short:
        if lack:
            lacks = lacks + F.when(F.col("slot") > ends[s], lack).otherwise(0)
    position = F.col("slot") * block_docs + F.col("i") % block_docs - lacks
    return placed.select(F.col("doc_id").alias(id_col), "mix_source", "block", "slot", position.alias("position"))


def _slot_of(block: int, segs: list, places: Mapping[tuple, int], s: str) -> int:
    for k, lo, hi, c, at, size in segs:
        if lo <= block < hi:
            return at + (block - lo) // c * size + places[s, k, (block - lo) % c]
    raise AssertionError("a block without a segment")
