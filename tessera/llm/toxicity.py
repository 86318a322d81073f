"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._shared import batch_bytes, chunks_of, slice_hashes, staged

#: A word is a feature if so many documents have it and its shares of the positive and of the unlabelled
#: ones differ by so many standard errors.
MIN_DOCS, MIN_ERRORS = 4, 5.0
#: Words of a slice of a task's sums. The driver adds up one slice of each task; of more, the executors do.
SLICE_WORDS = 1 << 15
#: Folds of the ids: the first is held out, each of the others is left out by one of the classifiers.
FOLDS = 5
STEPS, RATE, DECAY = 60, 0.15, 1e-5

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fold(id_col: str) -> Column:
    """CRC-32 of the id's text modulo the folds; a missing id counts as the empty text."""
    return (F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % FOLDS).cast("int")


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of ASCII letters and digits and of bytes beyond ASCII, lower case) and the row of each."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return slice_hashes(_LOWER[data], starts, ends), np.searchsorted(offsets, starts, side="right") - 1


def _features(batches: Iterator, table: np.ndarray | None) -> Iterator:
    """For each part of a batch: the part and its distinct (row, word) pairs; words of ``table`` by their place in it."""
    for batch in batches:
        data, offsets = batch_bytes(batch.column(batch.num_columns - 1))
        for a, b in chunks_of(offsets):
            h, row = word_rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if table is not None:
                at = np.minimum(np.searchsorted(table, h), len(table) - 1)
                hit = table[at] == h
                pairs = np.unique(row[hit] * len(table) + at[hit])
                yield batch.slice(a, b - a), pairs // len(table), pairs % len(table)
            else:
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])) if len(h) else np.zeros(0, bool)
                yield batch.slice(a, b - a), row[new], h[new]


@dataclass
class Model:
    """Averages the posteriors of linear classifiers over the presence of words."""

    words: np.ndarray  # sorted hashes
    weights: np.ndarray  # classifier x word
    bias: np.ndarray

    def score(self, rows: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n)
        for w, b in zip(self.weights, self.bias, strict=True):
            out += 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[places], n) + b, -50, 50)))
        return out / max(1, len(self.bias))


def sums(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, places: np.ndarray, p: np.ndarray, folds: np.ndarray) -> np.ndarray:
    """What each classifier's risk needs of some documents, for all of them and for the positive ones: the sums, by
    word and over all, of the posteriors, then of the losses of taking them for clean."""
    n, n_words = len(p), weights.shape[1]
    out = np.zeros((len(weights), 2, n_words + 2))
    for k, (w, b) in enumerate(zip(weights, bias, strict=True)):
        g = np.bincount(rows, w[places], n) + b
        s, loss = 1 / (1 + np.exp(-np.clip(g, -50, 50))), np.logaddexp(0, g)
        for j, used in enumerate((folds != k + 1, (folds != k + 1) & (p > 0))):
            if j == 0 or used.any():
                out[k, j, :n_words] = np.bincount(places, (s * used)[rows], n_words)
                out[k, j, n_words:] = (s @ used, loss @ used)
    return out


def nn_pu(step, n_u: np.ndarray, n_p: np.ndarray, prior: float, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases that minimise the non-negative risk (Kiryo et al., 2017) under the logistic loss, by Adam.

    ``step`` gives ``sums`` over all documents for the weights so far. The risk of taking a document for clean is
    estimated on the unlabelled ones, less the prior's share as the positive ones show it. Where that estimate is below
    zero, the classifier has begun to learn the documents by heart; the step then only takes it back above zero.
    """
    x = np.zeros((len(n_u), n_words + 1))
    x[:, -1] = start = float(np.log(prior / (1 - prior)))
    m, v = np.zeros_like(x), np.zeros_like(x)
    u, p, words_of_p = 1 / n_u[:, None], prior / n_p[:, None], None
    for t in range(1, STEPS + 1):
        total = step(x[:, :-1], x[:, -1])
        found_u, found_p = total[:, 0] * u, total[:, 1] * p
        if words_of_p is None:  # all posteriors are the prior as yet
            words_of_p = found_p[:, :-1] * (1 + np.exp(-start))
        clean = found_u[:, -1:] - found_p[:, -1:]
        grad = np.where(clean < 0, found_p[:, :-1] - found_u[:, :-1], found_u[:, :-1] - words_of_p)
        grad[:, :-1] += DECAY * x[:, :-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        x -= RATE * (1 - (t - 1) / STEPS) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x[:, :-1], x[:, -1]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Classifiers from all documents of the folds 1.. alone; None without a confirmed toxic one.

    Words are counted over all of them, and every step of the fit adds up all of them: those confirmed as toxic, and
    all whatever their label. The prior is the share of toxic ones among all labelled rows of the folds.
    """
    known = labels.select(F.col(id_col).alias("id"), "toxic").filter("id IS NOT NULL AND toxic IS NOT NULL").withColumn("fold", fold("id")).filter("fold > 0")
    n, toxic = known.agg(F.count(F.lit(1)), F.sum((F.col("toxic") == 1).cast("long"))).first()
    if not toxic:
        return None
    prior = min(max(toxic / n, 1e-3), 0.9)
    confirmed = known.filter("toxic = 1").select("id", F.lit(1).alias("p")).distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("raw")).filter("id IS NOT NULL").withColumn("fold", fold("id")).filter("fold > 0")
    rows = rows.join(F.broadcast(confirmed), "id", "left").select(F.coalesce("p", F.lit(0)).alias("p"), "fold", "raw")
    by_fold = {r["fold"]: (r["u"], r["p"]) for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("u"), F.sum("p").alias("p")).collect()}
    n_u, n_p = (sum(c[k] for c in by_fold.values()) for k in (0, 1))
    if not n_p or not n_u:
        return None

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part, row, h in _features(batches, None):
            words, at = np.unique(h, return_inverse=True)
            p = part.column(0).to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.bincount(at, p, len(words)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(words)))], names=["w", "p", "u"])

    counts = rows.mapInArrow(count, "w long, p long, u long").groupBy("w").agg(F.sum("p").alias("p"), F.sum("u").alias("n"))
    counts = counts.select("w", "n", (F.col("p") / n_p).alias("in_p"), (F.col("n") / n_u).alias("in_u"), ((F.col("p") + F.col("n")) / (n_p + n_u)).alias("share"))
    errors = F.abs(F.col("in_p") - F.col("in_u")) / F.sqrt(F.greatest(F.col("share") * (1 - F.col("share")), F.lit(1e-9)) * (1 / n_p + 1 / n_u))
    counts = counts.filter(F.col("n") >= MIN_DOCS).withColumn("errors", errors).filter(F.col("errors") >= MIN_ERRORS)
    words = np.sort(np.array([r["w"] for r in counts.select("w").collect()], np.int64).view(np.uint64))
    if not len(words):
        return None

    def place(batches: Iterator) -> Iterator:
        """A row for each part of a batch: its documents' marks, folds and numbers of words, and the places of the words."""
        import pyarrow as pa

        for part, row, at in _features(batches, words):
            cols = (part.column(0).to_numpy().astype("u1"), part.column(1).to_numpy().astype("u1"), np.bincount(row, minlength=part.num_rows).astype("<u4"), at.astype("<u4"))
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cols], names=["p", "fold", "n", "at"])

    seen = staged(rows.mapInArrow(place, "p binary, fold binary, n binary, at binary"), "toxicity-words")
    seen = seen.coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)
    # a classifier needs documents of both kinds outside the fold that it leaves out
    use = [k for k in range(1, FOLDS) if sum(c[0] for f, c in by_fold.items() if f != k) and sum(c[1] for f, c in by_fold.items() if f != k)]
    if not use:
        return None
    out_u, out_p = (np.array([sum(c[j] for f, c in by_fold.items() if f != k) or 1 for k in range(1, FOLDS)], float) for j in (0, 1))

    def step(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        now = docs.sparkSession.sparkContext.broadcast((weights, bias))

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            total, first = 0.0, b""
            for batch in batches:
                for r in range(batch.num_rows):
                    p, fold_, n, at = (np.frombuffer(batch.column(c)[r].as_py(), t).astype(np.int64) for c, t in enumerate(("u1", "u1", "<u4", "<u4")))
                    first = first or at[:64].tobytes()
                    total = total + sums(*now.value, np.repeat(np.arange(len(n)), n), at, p, fold_)
            if isinstance(total, np.ndarray):
                for k in range(0, total.shape[2], SLICE_WORDS):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([first], pa.binary()), pa.array([total[:, :, k : k + SLICE_WORDS].tobytes()], pa.binary())], names=["k", "first", "total"])

        def add(batches: Iterator) -> Iterator:
            """Of slices sorted by (k, first): one for each k."""
            import pyarrow as pa

            def out(k, total):
                return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([b""], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["k", "first", "total"])

            at, total = None, 0.0
            for batch in batches:
                for k, raw in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                    if at is not None and k != at:
                        yield out(at, total)
                        total = 0.0
                    at, total = k, total + np.frombuffer(raw.as_buffer())
            if at is not None:
                yield out(at, total)

        kind = "k long, first binary, total binary"
        found = seen.mapInArrow(run, kind)
        if weights.shape[1] + 2 > SLICE_WORDS:
            found = found.repartition("k").sortWithinPartitions("k", "first").mapInArrow(add, kind)
        slices: dict[int, np.ndarray | float] = {}
        for r in sorted(found.collect(), key=lambda r: (r["k"], r["first"])):
            slices[r["k"]] = slices.get(r["k"], 0.0) + np.frombuffer(r["total"])
        now.destroy()
        return np.concatenate([x.reshape(len(weights), 2, -1) for x in slices.values()], axis=2)

    weights, bias = nn_pu(step, out_u, out_p, prior, len(words))
    keep = [k - 1 for k in use]
    return Model(words, weights[keep], bias[keep])


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, in a column ``given``, with held_out, score (0 to 1) and predicted (1 from 0.5 on).

    The table is scored where it is read, without an exchange or a join, so rows are told apart whatever their ids.
    See ``toxicity`` for the cases.
    """
    model = fit(docs, labels, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            given = batch.column(0)
            texts = pa.RecordBatch.from_arrays([given, batch.column(1), given.field(at)], names=["given", "held_out", "text"])
            if model is None:
                yield pa.RecordBatch.from_arrays([given, batch.column(1), pa.array(np.zeros(batch.num_rows))], names=["given", "held_out", "score"])
            else:
                for part, row, place in _features([texts], model.words):
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(model.score(row, place, part.num_rows))], names=["given", "held_out", "score"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("given"), (fold(id_col) == 0).alias("held_out"))
    made = T.StructType([rows.schema["given"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, made).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    A score depends on the whole text alone, by the presence of words. The table is scored where it is read, without
    an exchange. Null and empty texts get the score of a text without known words. Without a confirmed toxic
    document in the folds that may be learned, all scores are 0. A row with a null id counts as held out; rows that
    repeat an id get a row each; labels that are null teach nothing. An empty table gives no rows; further columns
    are not read.
    """
    found = scored(docs.select(id_col, text_col), labels, id_col, text_col)
    return found.select(F.col(f"given.{id_col}").alias(id_col), "held_out", "score", "predicted")
