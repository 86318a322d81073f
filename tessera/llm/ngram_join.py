"""N-gram Jaccard join: a grouped prefix join over word shingles, and the components of its links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._shared import batch_bytes, chunks_of, connected_components, forget_tokens, mixed, staged, words

#: Shingles of a block of documents that meets another block in one task.
BLOCK_SHINGLES = 1 << 20
#: Distinct sets of which a task remembers that their cells are out already.
REMEMBERED = 200_000
#: Rows of a task's edges that are thinned out together.
HELD_ROWS = 1 << 20
#: Bits of the parity sketch that bounds the difference of two sets from below.
SKETCH_BITS = 1024

_A, _B, _C = (np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25))
_SALT = np.uint64(0x27D4EB2F165667C5)
_ALL = (1 << 64) - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each row the sorted 64-bit hashes of its distinct word n-grams; the whole sequence where it has fewer words."""
    h, at = words(data, offsets)
    grams = np.zeros(len(h), np.uint64)
    for k in range(n):
        step = h[k : len(h) - (n - 1 - k)] if len(h) >= n else h[:0]
        grams[: len(step)] = grams[: len(step)] * _A + step
    grams = mixed(grams + _B)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            whole = (b - a) * int(_C)
            for x in h[a:b].tolist():
                whole = (whole * int(_A) + x) & _ALL
            yield mixed(np.array([whole], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, in no order."""
    return int(mixed(tokens ^ _SALT).sum(dtype=np.uint64).view(np.int64)), int(mixed(tokens * _C + _A).sum(dtype=np.uint64).view(np.int64))


def size_classes(percent: int, most: int) -> np.ndarray:
    """Least sizes of classes such that linked sets lie in one class or in neighbouring ones."""
    lows = [1]
    while lows[-1] <= most:
        lows.append(max(lows[-1] + 1, (lows[-1] - 1) * 100 // percent + 1))
    return np.array(lows, np.int64)


class Cells:
    """The elements of a set by which it may meet others, before the prefix is taken.

    For a class of sizes, let d be the largest difference that a linked pair with its smaller set in the class can
    have. Hash space is cut into 1.5 (d + 1) cells. A differing shingle spoils one cell, so a linked pair agrees in
    all that they hold in more cells than ``spare``. In an order of all cell keys, the rarest first, each set may
    therefore leave out its ``spare`` last ones: the rarest key that a linked pair shares is in the prefix of both.
    """

    def __init__(self, percent: int):
        self.percent, self.lows, self.cuts = percent, size_classes(percent, 1 << 12), {}

    def reach(self, size: int) -> None:
        """Makes classes for sizes up to ``size``."""
        if size >= self.lows[-1]:
            self.lows = size_classes(self.percent, 2 * size)

    def needed(self, tag: int) -> int:
        """d + 1 of a class."""
        while tag + 1 >= len(self.lows):
            self.reach(int(self.lows[-1]))
        return (100 - self.percent) * (int(self.lows[tag + 1]) - 1) // self.percent + 1

    def spare(self, tag: int) -> int:
        return self.needed(tag) // 2

    def of(self, tokens: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(class, keys) for the set's own class and for the one below, whose members it may link with."""
        self.reach(len(tokens))
        own = int(np.searchsorted(self.lows, len(tokens), side="right")) - 1
        sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(mixed(tokens + _C), out=sums[1:])
        out = []
        for tag in (own, own - 1) if own else (own,):
            m = self.needed(tag) + self.spare(tag)
            if m not in self.cuts:
                self.cuts[m] = np.array([(i << 64) // m for i in range(m)], np.uint64)
            ends = np.append(np.searchsorted(tokens, self.cuts[m]), len(tokens))
            out.append((tag, mixed((sums[ends[1:]] - sums[ends[:-1]]) * _A + np.arange(m, dtype=np.uint64) * _B + np.uint64(tag * int(_SALT) & _ALL))))
        return out


def _starts(*cols: np.ndarray) -> np.ndarray:
    """Where sorted rows begin a new group."""
    if not len(cols[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in cols], axis=0)))


def _roots(n: int, pairs) -> list[int]:
    root = list(range(n))
    for a, b in pairs:
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[max(a, b)] = min(a, b)
    return root


def _sets_of(batches: Iterator, n: int) -> Iterator:
    forget_tokens()
    for batch in batches:
        data, offsets = batch_bytes(batch.column(batch.num_columns - 1))
        for a, b in chunks_of(offsets):
            yield batch.slice(a, b - a), shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)


def allowed(percent: int, both: np.ndarray | int) -> np.ndarray | int:
    """Largest symmetric difference of linked sets whose sizes sum to ``both``."""
    return both * (100 - percent) // (100 + percent)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exactly: 100 * intersection >= percent * union."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    same = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * same >= percent * (len(a) + len(b) - same)


def links_of_block(ids: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the documents of a block (or of the first side with those of the second) as far as they reach.

    Every pair is filtered by its sizes and by parity sketches: each differing shingle flips one bit, so sketches
    that differ in more bits than a linked pair may have differing shingles exclude a link. What passes is verified
    on the sets, nearest first, unless its two documents are joined already.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    side = sides[order]
    sketch = np.zeros((len(sets), SKETCH_BITS // 64), np.uint64)
    for row, i in enumerate(order):
        bit = (sets[i] & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
        odd = np.bincount(bit, minlength=SKETCH_BITS) & 1
        sketch[row] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
    comp = np.arange(len(sets))
    both = len(np.unique(side)) > 1
    out = []
    for x in range(len(sets)):
        end = int(np.searchsorted(sizes, sizes[x] * 100 // percent, side="right"))
        if end <= x + 1:
            continue
        y = np.arange(x + 1, end)
        if both:
            y = y[side[y] != side[x]]
        y = y[comp[y] != comp[x]]
        if not len(y):
            continue
        apart = np.bitwise_count(sketch[y] ^ sketch[x]).sum(axis=1, dtype=np.int64)
        near = apart <= allowed(percent, sizes[y] + sizes[x])
        y, apart = y[near], apart[near]
        for z in y[np.argsort(apart, kind="stable")].tolist():
            if comp[z] != comp[x] and linked(sets[order[x]], sets[order[z]], percent):
                out.append((int(ids[order[x]]), int(ids[order[z]])))
                comp[comp == comp[z]] = comp[x]
    return out


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links, itself included).

    Two documents link when the Jaccard similarity of their sets of word n-grams is at least ``percent`` / 100.
    Words are runs of bytes other than ASCII white space, A-Z in lower case.

    1. Documents with the same size and the same elements (see ``Cells``), and so with the same prefix, are one
       group: their sets are equal, and one document stands for all, found by a pre-aggregated grouping on 128 bits.
    2. The elements are counted over all groups, and each group keeps the rarest as its prefix. Groups meet where a
       prefix element agrees. A bucket sends one edge from each member to its least member, so
       its size only counts once; the components of these edges are families, and all links lie within families.
    3. A family is dealt into blocks of bounded size, and each pair of blocks meets in a task of its own. There
       pairs of groups are filtered by size and sketch, and what passes is verified on the whole sets.
    4. A document whose texts lie in several groups joins these. Members take over their group's component.

    Sets are held as 64-bit hashes, so a pair is decided wrongly only if two of its own shingles collide.

    Null and empty texts, and those of white space only, have no shingles and no links. Rows without an id have
    shingles, but link with nothing, and their component is null. Rows that repeat an id are texts of one document,
    which has the links of them all. An empty table gives no rows. Further columns are ignored.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for rows, sets in _sets_of(batches, n):
            found = [(len(s), *digest(s)) for s in sets]
            cols = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "n_shingles", "d1", "d2"])

    def cells(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cells, out = Cells(percent), set()
        for rows, sets in _sets_of(batches, n):
            keys, owners, tags = [], [], []
            for known, s in zip(rows.column(0).is_valid().to_pylist(), sets, strict=True):
                if len(s) and known:
                    d = digest(s)
                    if d not in out:
                        if len(out) < REMEMBERED:
                            out.add(d)
                        for tag, k in cells.of(s):
                            keys.append(k)
                            owners.append(np.full(len(k), d[0], np.int64))
                            tags.append(np.full(len(k), tag, np.int16))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(tags))], names=["key", "d", "tag"])

    def stars(batches: Iterator) -> Iterator:
        """Of rows sorted by (key, d): edges from each d to the least d of its key, thinned out to a forest now and then."""
        import pyarrow as pa

        def forest(k, d, key, least):
            first = _starts(k)
            head = d[first]
            if len(k) and k[0] == key:
                head[0] = least
            low = np.repeat(head, np.diff(np.append(first, len(k))))
            pairs = np.unique(np.stack([d, low], 1)[d != low], axis=0)
            nodes, at = np.unique(pairs, return_inverse=True)
            root = np.array(_roots(len(nodes), at.reshape(-1, 2).tolist()), np.int64)
            while (root != root[root]).any():
                root = root[root]
            far = root != np.arange(len(nodes))
            return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], names=["u", "v"]), (k[-1], head[-1])

        held, n, last = [], 0, (None, None)
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in (0, 1)])
            n += len(batch)
            if n >= HELD_ROWS:
                out, last = forest(*map(np.concatenate, zip(*held, strict=True)), *last)
                yield out
                held, n = [], 0
        if n:
            yield forest(*map(np.concatenate, zip(*held, strict=True)), *last)[0]

    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def done(rows):
            ids, sides, sets = [], [], []
            for i, side, size, d1, text in rows:
                data = np.frombuffer(text, np.uint8)
                s = next(iter(shingle_sets(data, np.array([0, len(data)]), n)))
                if (len(s), digest(s)[0]) == (size, d1):
                    ids.append(i)
                    sides.append(side)
                    sets.append(s)
            return links_of_block(np.array(ids), np.array(sides), sets, percent) if len(sets) > 1 else []

        at, rows, links = None, [], []
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(7)]
            for *key, i, side, size, d1, text in zip(*cols, batch.column(7).to_pylist(), strict=True):
                if key != at:
                    links += done(rows)
                    at, rows = key, []
                rows.append((i, side, size, d1, text))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["u", "v"])
                links = []
        if links := links + done(rows):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["u", "v"])

    measured = staged(ids.mapInArrow(measure, "doc_id long, n_shingles long, d1 long, d2 long"), "ngram-sizes")
    sizes = Cells(percent)
    sizes.reach(measured.agg(F.max("n_shingles")).first()[0] or 1)
    spare = F.get(F.lit([sizes.spare(tag) for tag in range(len(sizes.lows))]), F.col("tag").cast("int"))
    # Counted, ordered and cut on the JVM's side, where a key or a set of any size spills.
    keys = ids.mapInArrow(cells, "key long, d long, tag short").repartition("key").dropDuplicates(["key", "d"])
    shared = keys.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("n > 1")
    of_set = Window.partitionBy("d", "tag")
    ranked = shared.withColumn("i", F.row_number().over(of_set.orderBy("n", "key"))).withColumn("all", F.count(F.lit(1)).over(of_set))
    prefix = ranked.filter(F.col("i") <= F.col("all") - spare).select("key", "d")
    edges = prefix.repartition("key").sortWithinPartitions("key", "d").mapInArrow(stars, "u long, v long")
    families = connected_components(edges, "ngram-families").select(F.col("node").alias("d1"), F.col("component").alias("family"))
    named = measured.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    groups = named.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("gid"))
    standing = staged(groups.join(families, "d1"), "ngram-groups")
    blocks = standing.groupBy("family").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    dealt = standing.join(blocks, "family").withColumn("block", F.expr("cast(pmod(xxhash64(gid), blocks) as int)"))
    meets = dealt.select("family", "gid", "n_shingles", "d1", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    raw = ids.select(F.col("doc_id").alias("gid"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    # The texts are dealt by id at every size; no sort of them is needed, as an id's rows in ``meets`` are few.
    met = raw.join(meets.hint("shuffle_hash"), "gid").select(
        "family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "gid", "block", "n_shingles", "d1", "raw"
    )
    met = met.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    links = met.mapInArrow(verify, "u long, v long")
    of_text = F.struct("n_shingles", "d1", "d2")
    several = named.groupBy("doc_id").agg(F.min(of_text).alias("least"), F.max(of_text).alias("most")).filter("least <> most")
    own = named.join(several, "doc_id", "left_semi").join(groups, ["n_shingles", "d1", "d2"]).select(F.col("doc_id").alias("u"), F.col("gid").alias("v"))
    joined = connected_components(links.union(own), "ngram-links")
    of = groups.join(joined.withColumnRenamed("node", "gid"), "gid", "left").select(
        "n_shingles", "d1", "d2", F.least("gid", F.coalesce("component", "gid")).alias("component_id")
    )
    empty = measured.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    full = named.join(of, ["n_shingles", "d1", "d2"]).select("doc_id", "n_shingles", "component_id")
    return full.union(empty).withColumnRenamed("doc_id", id_col)
