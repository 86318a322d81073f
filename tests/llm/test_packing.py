"""Lexical retrieval packing: every id once, no padding, neighbours by score."""

import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def holds(rows, docs, window):
    """rows: (doc_id, start, length, crc, doc_tokens, sequence, offset); docs: ids by doc_id."""
    at, seqs = {}, {}
    for d, start, n, crc, total, seq, offset in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        assert start == at.get(d, 0)
        assert n > 0
        at[d] = start + n
        assert total == len(docs[d])
        assert crc == zlib.crc32(np.array(docs[d][start : start + n], "<u4").tobytes())
        seqs.setdefault(seq, []).append((offset, n))
    assert at == {d: len(x) for d, x in docs.items()}
    for parts in seqs.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= window
        assert end & (end - 1) == 0  # full windows and remainders alike


def made(key, ids):
    return P.Doc(key, len(ids), *P.terms_of(np.array(ids, np.uint16)))


class Noise:
    """Scores that mean nothing, the same for the same seed."""

    def __init__(self, pool):
        self.n = len(pool)

    def query(self, terms):
        return np.random.default_rng(int(terms[0])).random(self.n)


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("most", [1, 300, 1 << 30])
def test_fill(seed, most):
    rnd = random.Random(seed)
    sizes = [rnd.choice([1, 2, 5, 30, 64, 65, 200, 1000]) for _ in range(rnd.randint(0, 80))]
    docs = {d: list(range(d, d + n)) for d, n in enumerate(sizes)}
    pieces = list(P.fill((made(d, x) for d, x in docs.items()), 64, Noise, most))
    holds([(d.key, s, n, zlib.crc32(np.array(docs[d.key][s : s + n], "<u4").tobytes()), d.size, q, o) for d, s, n, q, o in pieces], docs, 64)


def plain_packing(docs, window, score):
    """The rule of the windows, word for word: all documents are looked at for each place."""
    unused, out, sequence, left, parts = list(range(len(docs))), [], 0, window, []

    def put(d, start, n):
        nonlocal sequence, left, parts
        out.append((d, start, n, sequence, window - left))
        left -= n
        if not left:
            sequence, left = sequence + 1, window

    rest = None
    while unused or rest:
        seed, at = rest or (unused.pop(0), 0)
        rest = None
        while at < len(docs[seed]):
            n = min(left, len(docs[seed]) - at)
            put(seed, at, n)
            at += n
        began = sequence
        while left < window and unused and sequence == began:
            ranked = sorted(unused, key=lambda d: (-score(seed, d), d))
            d = next((d for d in ranked if len(docs[d]) <= left), ranked[0])
            unused.remove(d)
            n = min(left, len(docs[d]))
            put(d, 0, n)
            if n < len(docs[d]):
                rest = d, n
    return out


@pytest.mark.parametrize("seed", range(6))
def test_fill_is_the_plain_packing(seed):
    """With all documents in the index, up to the last sequence, which is cut into powers of two."""
    rnd = random.Random(seed)
    docs = [[rnd.randint(0, 60) for _ in range(rnd.choice([1, 3, 8, 20, 33, 70]))] for _ in range(60)]
    df = np.zeros(61)
    for d in docs:
        df[sorted(set(d))] += 1
    mean, idf = np.mean([len(d) for d in docs]), P.idf_of(df, len(docs))
    index = P.Index([made(k, d) for k, d in enumerate(docs)], idf, mean)
    got = [(d.key, *x) for d, *x in P.fill((made(k, d) for k, d in enumerate(docs)), 32, lambda pool: P.Index(pool, idf, mean), 1 << 30)]
    want = plain_packing(docs, 32, lambda q, d: index.query(np.unique(np.array(docs[q], np.uint16)))[d])
    full = sum(map(len, docs)) // 32
    assert [x for x in got if x[3] < full] == [x for x in want if x[3] < full]
    assert full > 20


def bm25(query, doc, docs, df):
    mean = np.mean([len(d) for d in docs])
    return sum(max(0, np.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5))) * doc.count(t) * (P.K1 + 1) / (doc.count(t) + P.K1 * (1 - P.B + P.B * len(doc) / mean)) for t in set(query))


def test_scores_are_bm25():
    docs = [[1, 2, 2, 3], [2, 3, 4], [5, 6], [1, 1, 5, 7], [8], [9, 9]]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs])).astype(float)
    index = P.Index([made(k, d) for k, d in enumerate(docs)], P.idf_of(df, len(docs)), np.mean([len(d) for d in docs]))
    for q in docs:
        assert index.query(np.unique(np.array(q, np.uint16))) == pytest.approx([bm25(q, d, docs, df) for d in docs], rel=1e-6)


def test_neighbours_share_a_window():
    a, b = [f"{'alpha beta gamma delta'} a{i}" for i in range(6)], [f"{'one two three four'} b{i}" for i in range(6)]
    lib = Tokenizer.from_file(PATH)
    docs = [made(k, lib.encode(t, add_special_tokens=False).ids + [1]) for k, t in enumerate(t for p in zip(a, b) for t in p)]
    df = np.zeros(50_000)
    for d in docs:
        df[d.terms] += 1
    kinds = {}
    for d, _, _, q, _ in P.fill(docs, 8, lambda pool: P.Index(pool, P.idf_of(df, 24), 6)):
        kinds.setdefault(q, set()).add(d.key % 2)
    assert sum(len(k) == 1 for k in kinds.values()) > len(kinds) * 0.8


def test_like_documents_share_a_place():
    """Topics of their own words, and near copies with a tenth of the words changed."""
    rnd = random.Random(4)
    docs = []
    for _ in range(80):
        base = rnd.randrange(4) * 100
        x = [rnd.randrange(base, base + 100) for _ in range(60)]
        docs += [x, [t if rnd.random() < 0.9 else rnd.randrange(400, 500) for t in x]]
    sample = [P.terms_of(np.array(x, np.uint16)) for x in docs]
    routing = P.Routing(sample, 500)
    where = [routing.place(*t, len(x)) for t, x in zip(sample, docs, strict=True)]
    order = sorted(range(160), key=lambda k: where[k])
    at = {d: k for k, d in enumerate(order)}
    apart = [abs(at[2 * k] - at[2 * k + 1]) for k in range(80)]
    assert np.median(apart) < 8  # 53 if dealt by chance
    assert routing.place(np.zeros(0, np.uint16), np.zeros(0, np.int64), 0)[1:] == (-1, -1, -1, -1)


@pytest.mark.parametrize("shard", [1 << 30, 1 << 8])
def test_table(spark, monkeypatch, shard):
    monkeypatch.setattr(P, "SHARD_BYTES", shard)
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(["Foo", "bar", "baz.", "l'eau", "12", "<|endoftext|>", "ñu"]) for _ in range(rnd.choice([0, 1, 9, 300])))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "word " * 30_000), (None, "x y")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int")
    got = [tuple(r) for r in P.pack(df, PATH, 1, 256).collect()]
    lib = Tokenizer.from_file(PATH)
    holds(got, {d: lib.encode(t or "", add_special_tokens=False).ids + [1] for d, t in rows}, 256)


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), PATH, 1).count() == 0


def test_neighbours_meet_in_a_shard(spark, monkeypatch):
    """Two documents of each topic, far apart in the table; a window holds two, and the index a few at a time."""
    monkeypatch.setattr(P, "POOL_IDS", 64)
    monkeypatch.setattr(P, "CORE_SHARDS", 0)
    lib = Tokenizer.from_file(PATH)
    words = [w for w in ("".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=2)) for i in range(4000)) if len(lib.encode(" " + w, add_special_tokens=False).ids) == 1]
    words = sorted(set(words))[:240]
    rows = [(i + 1000 * half, "".join(f" {w}" for w in words[4 * i : 4 * i + 4]) * 3 + " the" * 3) for i in range(60) for half in range(2)]
    assert {len(lib.encode(t, add_special_tokens=False).ids) for _, t in rows} == {15}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    windows = {}
    for r in P.pack(df, PATH, 1, 32).collect():
        windows.setdefault(r["sequence_id"], set()).add(r["doc_id"])
    assert sorted(map(sorted, windows.values())) == [[i, i + 1000] for i in range(60)]


def test_sequences_follow_an_order(spark):
    rows = [(i, f"word{i} " * 9, 500 - i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mix long")
    got = [tuple(r) for r in P.pack(df, PATH, 1, 64, order=("mix",)).collect()]
    lib = Tokenizer.from_file(PATH)
    holds(got, {d: lib.encode(t, add_special_tokens=False).ids + [1] for d, t, _ in rows}, 64)
    seeds = [d for d, _, _, _, _, q, offset in sorted(got, key=lambda r: r[5]) if offset == 0]
    assert seeds == sorted(seeds, reverse=True)
