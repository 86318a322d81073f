"""Token store, encoding, wavelet matrix and word-piece counts against plain versions."""

import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import token_counts, token_store, wavelet
from tessera.llm.encoding import Encoder

ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n\nb c", "it's we'll 's 't", " 's", "x<|endoftext|>y <|endoftext|> z", "1 22 333", "é è  ñ ́a b",
    "\ta b\x85c \x1c d", "a b c　d", "a  b", "tab\t tab", "!!! ??? ...a b", "naïve Ünïcode ΣΑΣ Σ", "🙂 🙂🙂 x", "a b " * 50, "\r\n a", "a' s", "ℌ ﬁ Å", "don't CAN'T ß ſ ŉ ǅ ª º ² ¼ ½x x² İstanbul ˈa ʰ ª1 _a_ a_b 1a a1", "it''s 'tis 'the 'LL",
]


def texts(n=300, seed=5):
    rnd = random.Random(seed)
    bits = ["foo", "bar,", "Baz.", " ", "\n", "  ", "12", "l'eau", "ñ", "\t", "<|", "it's", "🙂", "́", "\x1d", "İ", "ß"]
    return ODD + ["".join(rnd.choice(bits) + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(1, 30))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_librarys_ids(name):
    path = public_tokenizers.path(name)
    enc, lib = Encoder(path), Tokenizer.from_file(path)
    got = enc.encode(texts())
    for t, raw in zip(texts(), got, strict=True):
        assert raw.tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_chunks_beyond_what_is_kept(monkeypatch):
    from tessera.llm import encoding

    monkeypatch.setattr(encoding, "KEEP_BYTES", 500)
    monkeypatch.setattr(encoding, "GROUP", 200)
    monkeypatch.setattr(encoding, "_TOGETHER", 3)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        enc, lib = Encoder(path), Tokenizer.from_file(path)
        for part in (texts(40), texts(40, 6), [None, "", "a"]):
            for t, raw in zip(part, enc.encode(part), strict=True):
                assert raw.tolist() == lib.encode(t or "", add_special_tokens=False).ids
        assert len(enc.units) < 40


@pytest.mark.parametrize("n", [0, 1, 7, 70_000])
def test_wavelet_matrix(n):
    rnd = np.random.default_rng(n)
    ids = rnd.choice([0, 1, 5, 77, 50_256], n).astype(np.uint16) if n < 100 else rnd.integers(0, 300, n).astype(np.uint16)
    s = wavelet.Shard(wavelet.pack(ids, np.array([4, 9]), np.array([n // 2, n - n // 2])))
    assert (s.ids() == ids).all()
    for i in rnd.integers(0, n, 20).tolist() if n else []:
        t = int(ids[i])
        assert s.access(i) == t
        assert s.count(t) == int((ids == t).sum())
        assert s.count(t, i) == int((ids[:i] == t).sum())
        assert s.find(t, s.count(t, i)) == i
    assert s.count(60_000) == 0
    assert [d for d, _, _ in s.documents()] == [4, 9]


def test_store_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_IDS", 100)
    rows = [(i * 3 % 101, t, "x") for i, t in enumerate(texts(70))] + [(7, None, None), (-(1 << 63), "least", "z"), (None, "null id", "y"), (3, "a", None), (3, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_store.write_store(df, path, str(tmp_path / "s"), 0)
    got = [tuple(r) for r in token_store.read_documents(spark, str(tmp_path / "s")).orderBy("start").collect()]
    lib = Tokenizer.from_file(path)
    at, want = 0, []
    hashed = df.selectExpr("doc_id", "text", "xxhash64(text) h").collect()
    for d, t, _ in sorted(hashed, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    total = sum(r["n"] for r in token_store.token_counts(spark, str(tmp_path / "s"), 0).collect())
    assert total == len(rows) + sum(lib.encode(t or "", add_special_tokens=False).ids.count(0) for _, t, _ in rows)


def test_empty_store(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    token_store.write_store(df, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "e"), 0)
    assert token_store.read_documents(spark, str(tmp_path / "e")).count() == 0


def greedy(word, first, after):
    n, at = 0, 0
    while at < len(word):
        pool = first if at == 0 else after
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pool), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


def test_automaton_is_greedy():
    rnd = random.Random(3)
    for _ in range(60):
        make = lambda k: {bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 5))) for _ in range(k)}
        first, after = make(8), make(8)
        counter = token_counts.PieceCounter(first, after)
        for _ in range(60):
            w = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 12)))
            assert counter.count(w) == greedy(w, first, after), (w, first, after)


def test_token_counts_table(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    first, after = (set(x) for x in token_counts.pieces_of(path))
    rows = [(i, t, i) for i, t in enumerate(texts(60))] + [(None, None, 1), (3, "a", None), (3, "a", None), (9, "word " * 30_000, 2)]
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens long"), path).collect()
    want = [(d, len((t or "").encode().split()), sum(greedy(w, first, after) for w in (t or "").encode().split()), len((t or "").encode())) for d, t, _ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
