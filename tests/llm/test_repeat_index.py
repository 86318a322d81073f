"""Run-length index and repeated strings against tables of all windows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import repeat_index as R
from tessera.tables import table


def digest(df):
    return df.select(
        "doc_id", "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda x, s: x + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@pytest.mark.parametrize("seed", range(12))
def test_statistics(seed):
    rnd = random.Random(seed)
    width = rnd.randint(1, 30)
    strings, begins = [], []
    for _ in range(rnd.randint(1, 25)):
        if strings and rnd.random() < 0.5:
            k = rnd.randrange(len(strings))
            s, begin = bytearray(strings[k]), begins[k]
            if s and rnd.random() < 0.8:
                s[rnd.randrange(len(s))] = rnd.choice(b"ab\x00")
        else:
            begin = rnd.randint(0, width)
            s = bytes(rnd.choice(b"ab\x00") for _ in range(rnd.randint(0, width - begin)))
        strings.append(bytes(s))
        begins.append(begin)
    index = R.RunColumns(strings, np.array(begins), width)

    def match(i, j, k):
        n = 0
        while all(b <= k - n < b + len(s) for s, b in ((strings[i], begins[i]), (strings[j], begins[j]))) and strings[i][k - n - begins[i]] == strings[j][k - n - begins[j]]:
            n += 1
        return n

    for k, (order, longest) in enumerate(index.statistics()):
        assert sorted(order.tolist()) == list(range(len(strings)))
        for i, n in zip(order.tolist(), longest.tolist(), strict=True):
            assert n == max((match(i, j, k) for j in range(len(strings)) if j != i), default=0)


def test_memory_of_a_task():
    """What a task holds for a piece, for a full index, and for an anchor that just fits, in Python and numpy."""
    import tracemalloc

    rnd = np.random.default_rng(3)
    data = rnd.integers(97, 123, R.PIECE, dtype=np.uint8)
    some, hot = ([data[k % 5000 : k % 5000 + 672].tobytes() for k in range(n // 672)] for n in (R.INDEX_BYTES, R.ANCHOR_BYTES))
    for make, most in (
        (lambda: R.anchors(data, np.arange(0, R.PIECE + 1, R.PIECE // 64), 400), 100e6),
        (lambda: R.RunColumns(some, np.zeros(len(some), np.int64), 672).repeated(400), 60e6),
        (lambda: R.RunColumns(hot, np.zeros(len(hot), np.int64), 672).repeated(400), 250e6),
    ):
        tracemalloc.start()
        make()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most


def texts(seed, n=60):
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choice("abcdeé ") for _ in range(k))
    passages = [word(rnd.randint(20, 120)) for _ in range(6)]
    out = []
    for _ in range(n):
        t = "".join(rnd.choice([word(rnd.randint(1, 90)), rnd.choice(passages)]) for _ in range(rnd.randint(0, 5)))
        if rnd.random() < 0.2 and out:
            t = rnd.choice(out)
            k = rnd.randrange(len(t) + 1)
            t = t[:k] + word(rnd.randint(0, 2)) + t[k:]
        if rnd.random() < 0.1:
            t += "xy" * rnd.randint(5, 60)
        out.append(t)
    return out


@pytest.mark.parametrize(("seed", "length", "index", "most", "piece"), [(1, 40, 1 << 22, 1 << 24, 1 << 22), (2, 25, 2000, 1 << 24, 300), (3, 30, 1 << 22, 60, 1 << 22), (4, 2, 500, 20, 64)])
def test_against_all_windows(spark, monkeypatch, seed, length, index, most, piece):
    monkeypatch.setattr(R, "INDEX_BYTES", index)
    monkeypatch.setattr(R, "ANCHOR_BYTES", most)
    monkeypatch.setattr(R, "PIECE", piece)
    rows = list(enumerate(texts(seed))) + [(1000, None), (1001, ""), (None, "null id " * 3), (1002, "same row twice " * 4), (1002, "same row twice " * 4)]
    rows += [(2000 + k, "x" * k + "yz" * 90 + "w" * k) for k in range(4)] + [(2010, "q" * 300), (2011, "q" * 120 + "r")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, raw int")
    got = sorted((str(tuple(r)) for r in digest(R.repeats(df, length)).collect()))
    want = R.plain([(t or "").encode() for _, t in rows], length)
    assert got == sorted(str((d, *w)) for (d, _), w in zip(rows, want, strict=True))


def test_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted(tuple(r) for r in digest(R.repeats(docs)).collect())
    want = R.plain([(t or "").encode() for _, t in rows], 400)
    assert got == sorted((d, *w) for (d, _), w in zip(rows, want, strict=True))
    assert sum(w[1] for w in want) > 0


def test_empty(spark):
    assert R.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
