"""Grouped prefix join against all pairs."""

import random
import re

import numpy as np
import pytest

from tessera.llm import ngram_join as N
from tessera.tables import table


def components(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, n):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets = {d: shingles(t, n) for d, t in rows}
    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    pairs = {(a, b) for v in by.values() for a in v for b in v if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components(sets, links)
    return sorted((d, len(s), comp[d]) for d, s in sets.items())


def near_copies(seed, count=250):
    rnd = random.Random(seed)
    pool = [f"w{i}" for i in range(400)]
    bases = [[rnd.choice(pool) for _ in range(rnd.choice([1, 2, 3, 5, 9, 30, 60, 200]))] for _ in range(25)]
    passage = [rnd.choice(pool) for _ in range(40)]
    rows = []
    for i in range(count):
        w = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, 4) if len(w) > 20 else rnd.randint(0, 1)):
            w[rnd.randrange(len(w))] = rnd.choice(pool)
        if rnd.random() < 0.3:
            w += passage
        rows.append((i * 7 % 1009, rnd.choice([" ", "\n", "  \t"]).join(x.upper() if rnd.random() < 0.1 else x for x in w)))
    return rows + [(2000, None), (2001, ""), (2002, " \n "), (2003, "a"), (2004, "A "), (2005, "é x")]


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 1 << 20), (5, 80, 300), (1, 50, 700)])
def test_against_all_pairs(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(N, "BLOCK_SHINGLES", block)
    rows = near_copies(n)
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_shingles int")
    got = sorted(tuple(r) for r in N.ngram_join(df, n, percent).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows, n, percent)


def test_query_on_the_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    got = sorted(tuple(r) for r in N.ngram_join(docs, 3, 90).collect())
    assert got == brute([tuple(r) for r in docs.collect()], 3, 90)


def test_odd_tables(spark):
    assert N.ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d e f"), (None, None), (4, "a b c d e f"), (4, "a b c d e f"), (5, "A b c d e f"), (6, "x " * 50_000)]
    got = sorted(map(str, (tuple(r) for r in N.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert got == sorted(map(str, [(None, 2, None), (None, 0, None), (4, 2, 4), (4, 2, 4), (5, 2, 4), (6, 1, 6)]))


def test_texts_of_one_id_join_their_groups(spark):
    """Document 70 has the sets of 60 and of 65, 30 near copies of two others; a null text beside a text with candidates."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    rows = [(60, a), (65, b), (70, a), (70, b), (80, c), (82, d), (30, c + " once more"), (30, d + " once more"), (90, e), (91, e + " more"), (90, None), (91, " ")]
    got = {}
    for r in N.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], set()).update({r["component_id"]} if r["n_shingles"] else ())
    assert got == {60: {60}, 65: {60}, 70: {60}, 80: {30}, 82: {30}, 30: {30}, 90: {90}, 91: {90}}


def test_classes_reach_all_linked_sizes():
    for percent in (50, 80, 90, 95):
        lows = N.size_classes(percent, 5000)
        of = lambda x: int(np.searchsorted(lows, x, side="right")) - 1
        for a in range(1, 2000):
            assert of(a * 100 // percent) - of(a) <= 1
