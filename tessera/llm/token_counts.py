"""Greedy word-piece lengths by a linear longest-match automaton."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose counts a worker keeps; further words are counted each time they come.
KEEP = 400_000


class PieceCounter:
    """How many pieces greedy longest-match-first splitting of a word gives, in time linear in the word.

    A trie holds the pieces that may begin a word and, under a root of its own, those that may continue one. Where
    a node has no child for the next byte, its failure link leads to the node that stands for what remains after
    the longest pieces were taken off, and ``pops`` says how many pieces those were, so no piece is ever built and
    no byte read twice. A word that the pieces cannot spell counts as one unknown piece.
    """

    def __init__(self, initial: Iterable[bytes], following: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]
        self.fail: list[int] = [-1, -1]
        self.pops: list[int] = [0, 0]
        ends = set()
        for root, pieces in ((0, initial), (1, following)):
            for piece in pieces:
                if piece:
                    at = root
                    for b in piece:
                        step = self.next[at].get(b)
                        if step is None:
                            step = self.next[at][b] = len(self.next)
                            self.next.append({})
                            self.fail.append(-1)
                            self.pops.append(0)
                        at = step
                    ends.add(at)
        queue = deque([0, 1])
        while queue:
            at = queue.popleft()
            for b, to in self.next[at].items():
                if to in ends:
                    self.fail[to], self.pops[to] = 1, 1
                else:
                    z, n = self.fail[at], self.pops[at]
                    while z >= 0 and b not in self.next[z]:
                        n += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[to], self.pops[to] = self.next[z][b], n
                queue.append(to)

    def count(self, word: bytes) -> int:
        step, fail, pops = self.next, self.fail, self.pops
        at = total = 0
        for b in word:
            to = step[at].get(b)
            while to is None:
                if fail[at] < 0:
                    return 1
                total += pops[at]
                at = fail[at]
                to = step[at].get(b)
            at = to
        while at > 1:
            if fail[at] < 0:
                return 1
            total += pops[at]
            at = fail[at]
        return total


def byte_alphabet() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in plain):
        out[chr(256 + i)] = b
    return out


def pieces_of(vocabulary: str) -> tuple[list[bytes], list[bytes]]:
    """Initial and following pieces of a byte-level vocabulary file: what begins with its space sign begins a word. Bytes by themselves may do either."""
    with open(vocabulary) as f:
        vocab = json.load(f)["model"]["vocab"]
    alphabet = byte_alphabet()
    space = next(c for c, b in alphabet.items() if b == 32)
    single = [bytes([b]) for b in range(256)]
    first, after = list(single), list(single)
    for piece in vocab:
        to = first if piece[0] == space else after
        raw = piece[1:] if piece[0] == space else piece
        if raw and all(c in alphabet and alphabet[c] != 32 for c in raw):
            to.append(bytes(alphabet[c] for c in raw))
    return first, after


class _Counts(dict):
    def __init__(self, counter: PieceCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        n = self.counter.count(word)
        if len(self) < KEEP:
            self[word] = n
        return n


_workers: dict[str, _Counts] = {}


def _counts(vocabulary: str) -> _Counts:
    if vocabulary not in _workers:
        _workers[vocabulary] = _Counts(PieceCounter(*pieces_of(vocabulary)))
    return _workers[vocabulary]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_tokens, n_bytes of the whole text.

    Words are runs of bytes other than space, \\t, \\n, \\v, \\f and \\r of the UTF-8 text, case kept. A table is
    read once, rows stay where they are, nothing is shuffled; a worker holds one text beside its automaton.
    Null and empty texts have no words and no tokens; rows with a null or repeated id keep a row each. An empty
    table gives no rows. Extra columns are not read.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = _counts(vocabulary)
        for batch in batches:
            n_words, n_tokens, n_bytes = [], [], []
            for value in batch.column(1):
                raw = value.as_py() or b""
                found = raw.split()
                n_words.append(len(found))
                n_tokens.append(sum(map(counts.__getitem__, found)))
                n_bytes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_bytes))], names=["id", "n_words", "n_tokens", "n_bytes"])

    ids = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("raw"))
    return rows.mapInArrow(run, f"id {ids}, n_words long, n_tokens long, n_bytes long").withColumnRenamed("id", id_col)
