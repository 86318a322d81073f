"""Packing by lexical retrieval: a sharded BM25 index finds the unused documents that fill each seed's window."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import input_bytes, mixed, staged

#: Stored bytes of token ids for each shard, a task's, and shards for each core at least; ids of the documents that a
#: shard's index holds at once.
SHARD_BYTES, CORE_SHARDS, POOL_IDS = 256 << 20, 2, 4_000_000
#: BM25's usual constants.
K1, B = 1.2, 0.75
#: The routing's bounded sample of documents, its topics, the cells that terms are hashed to, and the terms of a place.
SAMPLE, TOPICS, CELLS, PLACE_TERMS = 2048, 8, 4096, 4


class Doc(NamedTuple):
    """A document of a pool; ``key`` is whatever its pieces carry."""

    key: object
    size: int
    terms: np.ndarray
    tf: np.ndarray


def terms_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, ascending, and how often each stands in the document."""
    s = np.sort(ids, kind="stable")
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    return s[first], np.diff(np.append(first, len(s)))


def idf_of(df: np.ndarray, n_docs: int) -> np.ndarray:
    """BM25's weight of each term; one of half of all documents or more tells nothing."""
    return np.maximum(0, np.log((n_docs - df + 0.5) / (df + 0.5)))


def impact(idf: np.ndarray, tf: np.ndarray, size: np.ndarray | int, mean: float) -> np.ndarray:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / max(mean, 1e-9)))


class Index:
    """BM25 over some documents, with the weights and the mean length of the whole corpus.

    A term's list names its documents and their impacts; that of a term of a sixteenth of the documents or more is a
    row with the impact on every document, as adding whole rows is faster. Rows hold no more than sixteen numbers for
    each entry of a list.
    """

    def __init__(self, docs: list[Doc], idf: np.ndarray, mean: float):
        self.n = len(docs)
        sizes = np.array([d.size for d in docs], np.int64)
        term = np.concatenate([d.terms for d in docs]) if docs else np.zeros(0, np.uint16)
        tf = np.concatenate([d.tf for d in docs]) if docs else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(self.n), np.array([len(d.terms) for d in docs], np.int64))
        useful = idf[term] > 0
        term, tf, owner = term[useful], tf[useful], owner[useful]
        weight = impact(idf[term], tf, sizes[owner], mean).astype(np.float32)
        counts = np.bincount(term, minlength=len(idf))
        wide = np.flatnonzero(counts * 16 >= max(1, self.n))
        self.row = np.full(len(idf), -1)
        self.row[wide] = np.arange(len(wide))
        self.rows = np.zeros((len(wide), self.n), np.float32)
        dense = self.row[term] >= 0
        self.rows[self.row[term[dense]], owner[dense]] = weight[dense]
        term, owner, weight = term[~dense], owner[~dense], weight[~dense]
        order = np.argsort(term, kind="stable")
        self.doc, self.impact = owner[order], weight[order].astype(np.float64)
        self.starts = np.append(0, np.cumsum(np.where(self.row < 0, counts, 0)))

    def query(self, terms: np.ndarray) -> np.ndarray:
        """The score of every document."""
        score, rows = np.zeros(self.n), self.row[terms]
        for at in range(0, len(terms), 64):  # single precision holds for so many
            part = np.zeros(self.n, np.float32)
            for r in rows[at : at + 64].tolist():
                if r >= 0:
                    part += self.rows[r]
            score += part
        a, b = self.starts[terms], self.starts[terms.astype(np.int64) + 1]
        some = a < b
        if some.any():
            lists = list(zip(a[some].tolist(), b[some].tolist(), strict=True))
            score += np.bincount(np.concatenate([self.doc[x:y] for x, y in lists]), np.concatenate([self.impact[x:y] for x, y in lists]), self.n)
        return score


def fill(docs: Iterable[Doc], window: int, index: Callable[[list[Doc]], Index], most: int | None = None) -> Iterator[tuple[Doc, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of all documents, every id in one piece.

    ``docs`` come in an order in which like ones are near. The index holds ``most`` ids of unused documents at first
    and takes in the next ones whenever half of them are used, so each seed meets its nearest in that order on both
    sides, and all unused ones at the end. The first unused document is a seed. Its neighbours in the index come by
    falling score: always the best one that fits what is left of the window; if none does, the best is cut, and its
    rest seeds the next window. What is left at the end is cut into sequences of a power of two, so nothing is padded.
    """
    most = POOL_IDS if most is None else most
    source, more = iter(docs), True
    pool: list[Doc] = []
    sizes, used, found = np.zeros(0, np.int64), np.zeros(0, bool), None
    unused = sequence = nxt = 0
    left, open_, seed, at = window, [], None, 0

    def close():
        nonlocal open_, sequence, left
        offset = 0
        for d, start, n in open_:
            yield d, start, n, sequence, offset
            offset += n
        open_, sequence, left = [], sequence + 1, window

    while True:
        if more and unused * 2 <= most:
            pool, held = [d for d, u in zip(pool, used.tolist(), strict=True) if not u], unused
            while more and held < most:
                d = next(source, None)
                more = d is not None
                if more:
                    pool.append(d)
                    held += d.size
            sizes, used, found, unused, nxt = np.array([d.size for d in pool], np.int64), np.zeros(len(pool), bool), index(pool), held, 0
        if seed is None:
            while nxt < len(pool) and used[nxt]:
                nxt += 1
            if nxt == len(pool):
                break
            seed, at, used[nxt] = pool[nxt], 0, True
            unused -= seed.size
        while seed.size - at >= left:
            open_.append((seed, at, left))
            at += left
            yield from close()
        if at == seed.size:
            seed = None
            continue
        open_.append((seed, at, seed.size - at))
        left -= seed.size - at
        score, seed = np.where(used, -1.0, found.query(seed.terms)), None
        while left < window:
            fits = np.where(sizes <= left, score, -1.0)
            k = int(np.argmax(fits)) if len(fits) else 0
            if not len(fits) or fits[k] < 0:
                k = int(np.argmax(score)) if len(score) else 0
                if not len(score) or score[k] < 0:
                    break  # all used
            d, n = pool[k], min(left, int(sizes[k]))
            used[k], score[k] = True, -1.0
            unused -= d.size
            open_.append((d, 0, n))
            left -= n
            if n < d.size:
                seed, at = d, n
            if not left:
                yield from close()
    rest = open_
    while rest:
        total = sum(n for _, _, n in rest)
        take = 1 << (total.bit_length() - 1)
        open_, after = [], []
        for d, start, n in rest:
            now = min(n, take - sum(x for _, _, x in open_))
            if now:
                open_.append((d, start, now))
            if now < n:
                after.append((d, start + now, n - now))
        yield from close()
        rest = after


class Routing:
    """Deals documents to places such that lexically like ones are near: by topic, then by their heaviest terms.

    The topics are spherical k-means over hashed terms of a sample; the terms of a place are a document's
    ``PLACE_TERMS`` of the greatest impact, the most widespread of them first, so that near copies share a place.
    Weights are the sample's. Where a document lies decides only which others its index holds, no score.
    """

    def __init__(self, sample: list[tuple[np.ndarray, np.ndarray]], size: int):
        self.df = np.zeros(size)
        for terms, _ in sample:
            self.df[terms] += 1
        self.idf = np.log(1 + (len(sample) + 0.5) / (self.df + 0.5))  # terms that the sample lacks are the rarest
        self.idf[self.df * 2 > len(sample)] = 0
        self.mean = sum(int(tf.sum()) for _, tf in sample) / max(1, len(sample))
        self.cell = (mixed(np.arange(size, dtype=np.uint64)) & np.uint64(CELLS - 1)).astype(np.int64)
        x = np.zeros((len(sample), CELLS), np.float32)
        for row, (terms, _) in zip(x, sample, strict=True):
            np.add.at(row, self.cell[terms], self.idf[terms])
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        centres = x[np.linspace(0, max(0, len(x) - 1), TOPICS).astype(np.int64)] if len(x) else np.zeros((TOPICS, CELLS), np.float32)
        for _ in range(10):
            near = np.argmax(x @ centres.T, axis=1) if len(x) else np.zeros(0, np.int64)
            for k in range(TOPICS):
                if (near == k).any():
                    c = x[near == k].mean(axis=0)
                    centres[k] = c / max(float(np.linalg.norm(c)), 1e-9)
        self.centres = np.ascontiguousarray(centres[:, self.cell].T * self.idf[:, None].astype(np.float32))

    def place(self, terms: np.ndarray, tf: np.ndarray, size: int) -> tuple[int, ...]:
        """(topic, term, ...); -1 where a document has fewer terms."""
        weight = impact(self.idf[terms], tf, size, self.mean)
        k = np.argpartition(-weight, PLACE_TERMS - 1)[:PLACE_TERMS] if len(terms) > PLACE_TERMS else np.arange(len(terms))
        best = terms[k][np.lexsort((terms[k], -self.df[terms[k]]))]
        return int(np.argmax(self.centres[terms].sum(axis=0))), *best.tolist(), *[-1] * (PLACE_TERMS - len(best))


def pack(
    docs: DataFrame, vocabulary: str, end_id: int, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", order: tuple[str, ...] = ()
) -> DataFrame:
    """Pieces of all documents: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    1. A routing is fitted on about ``SAMPLE`` documents (twice as many at most). It only decides who meets whom.
    2. Texts are encoded where they are read, and written once as token ids with their terms and place.
    3. Document frequencies are counted over all documents, in a table no longer than the vocabulary.
    4. Documents are exchanged into ranges of places, the shards, sorted by place. A hash of the id and the ids ends
       the place, so any number of like documents can be split. A task streams its shard through an index of
       ``POOL_IDS`` ids that is refilled with the next documents (see ``fill``): its memory does not depend on the
       shard, and the work is in proportion to the number of documents.

    ``window`` is a power of two. A sequence is full, or its length is a power of two, so there is no padding; each
    shard ends with the binary digits of what is left. Sequences are numbered by shard, or if ``order`` names columns
    of ``docs``, by the place of their seeds in that order.

    Null and empty texts are the end id alone. Rows that repeat an id are packed each for itself, and null ids keep
    theirs. An empty table gives no rows. Further columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    marks = [f"mark{k}" for k in range(len(order))]
    marked = "".join(f", {p} {docs.schema[c].dataType.simpleString()}" for p, c in zip(marks, order, strict=True))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(p) for p, c in zip(marks, order, strict=True)))

    def sampled(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tessera.llm.encoding import encoder

        enc = encoder(vocabulary)
        for batch in batches:
            for a, b, ids, ends in enc.encode_documents(batch.column(0), end_id):
                found = [terms_of(ids[ends[k] : ends[k + 1]]) for k in range(b - a)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k].astype("<i4").tobytes() for x in found], pa.binary()) for k in (0, 1)], names=["terms", "tf"])

    n_rows = docs.count()
    some = rows.select("text").sample(min(1.0, SAMPLE / max(1, n_rows)), seed=11).limit(2 * SAMPLE)
    sample = [tuple(np.frombuffer(x, "<i4") for x in r) for r in some.mapInArrow(sampled, "terms binary, tf binary").collect()]
    routing = Routing(sample, 1 + max((int(t[-1]) for t, _ in sample), default=0))
    places = [f"place{k}" for k in range(1 + PLACE_TERMS)]

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tessera.llm.encoding import encoder

        enc = encoder(vocabulary)
        for batch in batches:
            for a, b, ids, ends in enc.encode_documents(batch.column(1), end_id):
                found, where = [], []
                for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    terms, tf = terms_of(ids[x:y])
                    known = terms < len(routing.df)
                    where.append(routing.place(terms[known], tf[known], y - x))
                    found.append((terms.tobytes(), tf.astype("<u4").tobytes()))
                width = ids.dtype.itemsize
                raw = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])
                given = [batch.column(k).slice(a, b - a) for k in (0, *range(2, batch.num_columns))]
                put = [pa.array(c, pa.int32()) for c in zip(*where, strict=True)] + [pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([given[0], pa.array([width] * (b - a), pa.int32()), raw, *put, *given[1:]], names=["id", "width", "ids", *places, "terms", "tf", *marks])

    def frequencies(batches: Iterator) -> Iterator:
        import pyarrow as pa

        df, n, total = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            for width, size, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                terms = np.frombuffer(raw.as_buffer(), f"<u{width}")
                if terms[-1] >= len(df):
                    df = np.append(df, np.zeros(int(terms[-1]) + 1 - len(df), np.int64))
                df[terms] += 1
                n, total = n + 1, total + size // width
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(terms, [-1, -2])), pa.array(np.append(df[terms], [n, total]))], names=["term", "n"])

    placed = "".join(f", {p} int" for p in places)
    encoded = staged(rows.mapInArrow(encode, f"id {kind}, width int, ids binary{placed}, terms binary, tf binary{marked}"), "packing-ids")
    counts = encoded.select("width", F.octet_length("ids").alias("size"), "terms").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counted = {r["term"]: r["n"] for r in counts.collect()}
    n_docs, total = counted.pop(-1, 0), counted.pop(-2, 0)
    df = np.zeros(max(counted, default=0) + 1)
    df[list(counted)] = list(counted.values())
    idf, mean = idf_of(df, n_docs), total / max(1, n_docs)
    shards = max(1, CORE_SHARDS * docs.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(encoded) // SHARD_BYTES))

    def fill_shard(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from tessera.llm.encoding import forget

        forget()
        first, types = TaskContext.get().partitionId() << 32, []

        def stored() -> Iterator[Doc]:
            for batch in batches:
                given = [batch.column(k) for k in (0, *range(5, batch.num_columns))]
                types[:] = [c.type for c in given]
                for row in range(0, len(batch), 256):
                    cols = [c.slice(row, 256).to_pylist() for c in (*batch.columns[1:5], *given)]
                    for w, raw, terms, tf, *key in zip(*cols, strict=True):
                        ids = np.frombuffer(raw, f"<u{w}")
                        yield Doc((key, ids), len(ids), np.frombuffer(terms, f"<u{w}"), np.frombuffer(tf, "<u4"))

        def batch_of(pieces: list) -> pa.RecordBatch:
            found = [(s, n, zlib.crc32(d.key[1][s : s + n].astype("<u4").tobytes()), d.size, first + q, o) for d, s, n, q, o in pieces]
            kept = [pa.array(c, t) for c, t in zip(zip(*(d.key[0] for d, *_ in pieces), strict=True), types, strict=True)]
            cols = [kept[0], *(pa.array(c, pa.int64()) for c in zip(*found, strict=True)), *kept[1:]]
            return pa.RecordBatch.from_arrays(cols, names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *marks])

        held = []
        for piece in fill(stored(), window, lambda pool: Index(pool, idf, mean)):
            held.append(piece)
            if len(held) == 1024:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    dealt = encoded.withColumn("tie", F.xxhash64("id", "ids"))
    dealt = dealt.repartitionByRange(shards, *places, "tie").sortWithinPartitions(*places, "tie", "id", "ids").select("id", "width", "ids", "terms", "tf", *marks)
    pieces = dealt.mapInArrow(fill_shard, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long{marked}")
    if order:
        pieces = staged(pieces, "packing-pieces")

        def number(batches: Iterator) -> Iterator:
            import pyarrow as pa
            from pyspark import TaskContext

            at = TaskContext.get().partitionId() << 32
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(at, at + len(batch)))], names=["sequence_id", "number"])
                at += len(batch)

        seeds = pieces.filter("offset = 0").select("sequence_id", *marks).repartitionByRange(*marks, "sequence_id").sortWithinPartitions(*marks, "sequence_id")
        numbers = seeds.select("sequence_id").mapInArrow(number, "sequence_id long, number long")
        pieces = pieces.join(numbers, "sequence_id").withColumn("sequence_id", F.col("number"))
    return pieces.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
