"""Long repeated byte strings: a run-length index over the places where documents may agree, and what remains without them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import _BYTE, _powers, batch_bytes, chunks_of, mixed, staged

#: Bytes of contexts that an index takes in before the next anchor, those that one anchor may bring, and those for each
#: task of indexes.
INDEX_BYTES, ANCHOR_BYTES, TASK_BYTES = 1 << 22, 1 << 24, 1 << 26
#: Bytes of texts that are looked at together.
PIECE = 1 << 19


class Hashes:
    """Hashes of any slices of a byte array, from one pass over it."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers(n), out=self.prefix[1:])
        self.inverse = _powers(n + 1, True)

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.prefix[ends] - self.prefix[starts]) * self.inverse[starts]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed(self.raw(starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_of(length: int) -> int:
    """Bytes of the anchor string of a window: about a third, so that windows have few anchors and short common lines none."""
    return max(1, length * 8 // 25)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, place, anchor hash, left end, right end, context hash) of the anchors of a batch; places count in ``data``.

    Of every window of ``length`` bytes the leftmost string with the least hash is its anchor, so equal windows have
    their anchor at the same offset. The context of an anchor is all bytes that a window with it may cover.
    """
    gram = gram_of(length)
    w = length - gram + 1
    n = len(data)
    sizes = np.diff(offsets)
    none = np.zeros(0, np.int64)
    if not (sizes >= length).any():
        return none, none, none.view(np.uint64), none, none, none.view(np.uint64)
    h = Hashes(data)
    spots = np.arange(n - gram + 1)
    g = h.of(spots, spots + gram)
    key = (g >> np.uint64(24) << np.uint64(24)) | spots.astype(np.uint64)
    pad = -len(key) % w
    grid = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    left = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(grid, axis=1).ravel()
    least = np.minimum(left[: len(key) - w + 1], right[w - 1 : len(key)])
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    s = np.arange(len(least))
    ok = s + length <= offsets[1:][row_of[: len(least)]]
    place = np.unique(least[ok] & np.uint64((1 << 24) - 1)).astype(np.int64)
    row = row_of[place]
    a, b = np.maximum(place - (w - 1), offsets[row]), np.minimum(place + length, offsets[row + 1])
    context = mixed(h.of(a, b) * np.uint64(0x9FB21C651E98DF25) + (place - a).astype(np.uint64))
    return row, place, g[place], a, b, context


class RunColumns:
    """A run-compressed positional Burrows-Wheeler transform of strings that are aligned by columns.

    At every column the strings are in the order of what stands to the left, read backwards, and ``match`` has the
    bytes up to there in which each agrees with the one before it. A column's transform is its bytes in that order. It
    falls into runs, and strings that follow each other within a run still do so at the next column, with a match one
    longer; only where a run begins is the match looked up, as the least one since the last run of the same byte.
    So matching statistics are streamed from column to column, and nothing is held but the columns and one order.
    """

    def __init__(self, strings: list[bytes], begins: np.ndarray, width: int):
        grid = np.zeros((len(strings), width), np.uint16)  # 0: the string has no byte in the column
        for row, begin, s in zip(grid, begins.tolist(), strings, strict=True):
            row[begin : begin + len(s)] = np.frombuffer(s, np.uint8)
            row[begin : begin + len(s)] += 1
        self.columns = np.ascontiguousarray(grid.T)

    def statistics(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """After each column: the order, and for each string in it the longest match with any other that ends there."""
        n = self.columns.shape[1]
        order, match = np.arange(n), np.zeros(n + 1, np.int64)
        for column in self.columns:
            byte = column[order]
            to = np.argsort(byte, kind="stable")
            byte = byte[to]
            before, now = to[:-1], to[1:]
            same = byte[1:] == byte[:-1]
            grown = np.zeros(n + 1, np.int64)
            grown[1:-1] = np.where(same, match[now] + 1, 0)
            runs = np.flatnonzero(same & (now != before + 1))
            if len(runs):
                since = np.stack([before[runs] + 1, now[runs] + 1], axis=1).ravel()
                grown[runs + 1] = np.minimum.reduceat(match, since)[::2] + 1
            grown[: int(np.searchsorted(byte, 1))] = 0
            order, match = order[to], grown
            yield order, np.maximum(match[:-1], match[1:])

    def repeated(self, length: int) -> np.ndarray:
        """For each string and column: a string of ``length`` bytes begins there that stands in another one at the same columns."""
        width, n = self.columns.shape
        out = np.zeros((n, max(0, width - length + 1)), bool)
        for k, (order, longest) in enumerate(self.statistics()):
            if k >= length - 1:
                out[order[longest >= length], k - length + 1] = True
        return out


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as maximal runs."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.append(True, s[1:] > e[:-1]) if len(s) else np.zeros(0, bool)
    return s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)] if len(s) else e


def repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, spans (start, end in UTF-8 bytes) and kept, the bytes outside of them.

    A byte is in a span if a string of ``length`` bytes that covers it also starts at another place of any document.

    1. Every window of that length has an anchor that depends on its bytes alone; equal windows share it. An anchor's
       context is all that its windows may cover.
    2. Equal contexts of an anchor are one, with a weight, pre-aggregated. A context of weight two or more matches
       itself from end to end and is marked whole; an anchor whose contexts are all of that kind, or that has one
       context only, needs nothing more. What is left are contexts that agree in the anchor but not in all.
    3. Of those, each distinct one is cut out of a text once and sent to its anchor's task, which streams them, sorted
       by anchor, through run-length indexes (see ``RunColumns``). Windows of the same anchor can only be equal at the
       same offset from it, so contexts are aligned there. Places with a match of ``length`` are marked.
    4. An anchor whose contexts don't fit in a task's memory is split by its windows: they are grouped by their hash,
       so no group grows with the anchor, and equal windows are pre-aggregated.

    Contexts are told apart by 64-bit hashes and compared by bytes within an index; documents are told apart by 128 bits. Null texts are empty; texts shorter than ``length`` keep all. Rows that repeat id and text are
    two places and repeat each other. An empty table gives no rows; further columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    reach = length - gram_of(length)  # columns of a context before its anchor
    most_contexts = max(1, ANCHOR_BYTES // (length + reach))
    rows = docs.select(F.col(id_col).alias("id"), F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("raw"))
    rows = rows.select(F.xxhash64("id", "raw").alias("r1"), F.xxhash64("raw", F.lit(7), "id").alias("r2"), "id", "raw")

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def part(row, r1, r2, place, base, g, a, b, context):
            """Neighbouring places of a row with the same anchor and context, as in periodic texts, are one: ``n`` of them, whose contexts reach from a to ``upto``."""
            new = np.append(True, (g[1:] != g[:-1]) | (context[1:] != context[:-1]) | (row[1:] != row[:-1])) if len(g) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(g)))
            cols = (g.view(np.int64)[first], context.view(np.int64)[first], r1[first], r2[first], place[first] + base, a[first] + base, b[first] + base, b[first + n - 1] + base, n)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["anchor", "context", "r1", "r2", "place", "a", "b", "upto", "n"])

        for batch in batches:
            r1, r2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = batch_bytes(batch.column(2))
            for x, y in chunks_of(offsets, PIECE):
                if y - x > 1 or offsets[y] - offsets[x] <= PIECE:
                    off = offsets[x : y + 1] - offsets[x]
                    row, place, g, a, b, context = anchors(data[offsets[x] : offsets[y]], off, length)
                    yield part(row, r1[x:y][row], r2[x:y][row], place - off[row], 0, g, a - off[row], b - off[row], context)
                    continue
                done, end = np.zeros(0, np.int64), int(offsets[y] - offsets[x])
                for s in range(0, end, PIECE):  # pieces reach over so far that each window and its context is whole in one
                    lo, hi = max(0, s - length), min(end, s + PIECE + 2 * length)
                    row, place, g, a, b, context = anchors(data[offsets[x] + lo : offsets[x] + hi], np.array([0, hi - lo]), length)
                    own = ((a > 0) | (lo == 0) | (place >= length)) & ((b < hi - lo) | (hi == end)) & ~np.isin(place + lo, done)
                    n = int(own.sum())
                    yield part(row[own], np.full(n, r1[x]), np.full(n, r2[x]), place[own], lo, g[own], a[own], b[own], context[own])
                    done = (place + lo)[own]

    found = staged(rows.select("r1", "r2", "raw").mapInArrow(find, "anchor long, context long, r1 long, r2 long, place long, a long, b long, upto long, n long"), "repeat-anchors")
    groups = found.groupBy("anchor", "context").agg(F.sum("n").alias("n"), F.min(F.struct("r1", "r2", "place", "a", "b")).alias("one"))
    groups = staged(groups, "repeat-groups")
    wanted = groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts"), F.min("n").alias("least")).filter("contexts > 1 AND least = 1")
    equal = found.join(groups.filter("n > 1").select("anchor", "context"), ["anchor", "context"]).select("r1", "r2", "a", F.col("upto").alias("b"))
    doubtful = groups.join(wanted, "anchor").select("anchor", (F.col("contexts") > most_contexts).alias("split"), "one.*")
    doubtful = staged(doubtful, "repeat-doubtful")
    volume = doubtful.agg(F.sum(F.col("b") - F.col("a"))).first()[0] or 0
    lists = doubtful.groupBy("r1", "r2").agg(F.collect_list(F.struct("anchor", "place", "a", "b", "split")).alias("cuts"))

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for r1, r2, raw, cuts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                view, all_ = memoryview(raw.as_buffer()), cuts.values
                for k in range(0, len(all_), 512):
                    anchor, place, a, b, split = (all_.slice(k, 512).field(c) for c in range(5))
                    n = len(anchor)
                    parts = [bytes(view[x:y]) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([anchor, pa.array([r1] * n, pa.int64()), pa.array([r2] * n, pa.int64()), place, a, split, pa.array(parts, pa.binary())], names=["anchor", "r1", "r2", "place", "a", "split", "raw"])

    contexts = rows.select("r1", "r2", "raw").join(lists, ["r1", "r2"]).select("r1", "r2", "raw", "cuts").mapInArrow(cut, "anchor long, r1 long, r2 long, place long, a long, split boolean, raw binary")
    contexts = staged(contexts, "repeat-contexts")

    def mark(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def marks(held: list):
            r1, r2, place, a = (np.array(c, np.int64) for c in list(zip(*held, strict=True))[:4])
            index = RunColumns([x[4] for x in held], a - (place - reach), length + reach)
            found_ = np.pad(index.repeated(length), ((0, 0), (1, 1)))  # neighbouring starts are one run
            row, first = np.nonzero(found_[:, 1:] & ~found_[:, :-1])
            _, last = np.nonzero(found_[:, :-1] & ~found_[:, 1:])
            start = place[row] - reach
            return pa.RecordBatch.from_arrays([pa.array(r1[row]), pa.array(r2[row]), pa.array(start + first), pa.array(start + last - 1 + length)], names=["r1", "r2", "a", "b"])

        held, size, at = [], 0, None
        for batch in batches:
            for k in range(0, len(batch), 1024):
                for anchor, *row in zip(*(c.slice(k, 1024).to_pylist() for c in batch.columns), strict=True):
                    if anchor != at and size >= INDEX_BYTES:
                        yield marks(held)
                        held, size = [], 0
                    at = anchor
                    held.append(row)
                    size += len(row[-1])
        if held:
            yield marks(held)

    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-volume // TASK_BYTES))
    near = contexts.filter("NOT split").select("anchor", "r1", "r2", "place", "a", "raw").repartition(tasks, "anchor").sortWithinPartitions("anchor").mapInArrow(mark, "r1 long, r2 long, a long, b long")

    def windows(batches: Iterator) -> Iterator:
        """The distinct windows of each context, with the first and the last place; equal ones overlap, as a context is short."""
        import pyarrow as pa

        for batch in batches:
            for r1, r2, a, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                s = np.arange(len(raw.as_buffer()) - length + 1)
                h = Hashes(np.frombuffer(raw.as_buffer(), np.uint8)).of(s, s + length)
                one, first = np.unique(h, return_index=True)
                last = len(h) - 1 - np.unique(h[::-1], return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), *(pa.array(np.full(len(one), r)) for r in (r1, r2)), pa.array(first + a), pa.array(last + a)], names=["window", "r1", "r2", "a", "z"])

    each = contexts.filter("split").select("r1", "r2", "a", "raw").mapInArrow(windows, "window long, r1 long, r2 long, a long, z long")
    places = [F.struct("r1", "r2", F.col(c).alias("at")) for c in ("a", "z")]
    twice = each.groupBy("window").agg(F.min(places[0]).alias("x"), F.max(places[1]).alias("y")).filter("x <> y").select("window")
    far = each.join(twice, "window").select("r1", "r2", "a", (F.col("z") + length).alias("b"))
    marks = equal.union(near).union(far).groupBy("r1", "r2").agg(F.collect_set(F.struct("a", "b")).alias("marks"))

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for row in range(0, len(batch), 256):
                part = batch.slice(row, 256)
                n, spans, kept = [], [], []
                for raw, found_ in zip(part.column(1), part.column(2), strict=True):
                    raw = raw.as_py()
                    n.append(len(raw))
                    if found_.is_valid:
                        v = found_.values
                        s, e = merged(v.field(0).to_numpy(), v.field(1).to_numpy())
                        spans.append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)])
                        kept.append(b"".join(raw[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(raw)], strict=True)))
                    else:
                        spans.append([])
                        kept.append(raw)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(spans, pair), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    out = rows.join(marks, ["r1", "r2"], "left").select("id", "raw", "marks")
    return out.mapInArrow(keep, f"id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary").withColumnRenamed("id", id_col)


def plain(texts: list[bytes], length: int) -> list[tuple[int, int, int, str]]:
    """What ``repeats`` should give, from a table of all windows: (n_bytes, n_removed, n_spans, sha256). For small inputs."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone[:-1]].tobytes()).hexdigest()))
    return out
