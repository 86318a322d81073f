"""The queries themselves on the smallest tables, against the SQL or a plain version of each."""

import heapq
import json
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import mixing, queries, repeat_index, token_counts
from tessera.tables import table
from tests.llm.test_packing import holds
from tests.llm.test_tokens import greedy

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(names).collect()), key=str) == sorted(found.fetchall(), key=str)


def test_op5(spark, texts):
    want = repeat_index.plain([t.encode() for t in texts.values()], 400)
    assert sorted(map(tuple, queries.op5_repeats(spark, SF).collect())) == sorted((d, *w) for d, w in zip(texts, want, strict=True))


def test_op6(spark, texts):
    lib, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for d in sorted(texts):
        ids = [*lib.encode(texts[d], add_special_tokens=False).ids, 0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op6_token_store(spark, SF).collect())) == want


def test_op7(spark, texts):
    got = queries.op7_toxicity(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    toxic = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    right = [r["predicted"] == toxic[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in toxic]
    assert sum(right) >= 0.9 * len(right)


def plain_mix(spark):
    """Positions slot by slot: of the released blocks, that with the earliest deadline; a source that can't fill a period leaves after it."""
    rows = table(spark, SF, "documents").selectExpr("doc_id", "source", "xxhash64(17, doc_id) AS h").collect()
    queue = {}
    for r in sorted(rows, key=lambda r: ((r["h"] >> 54) & 1023, r["h"], r["doc_id"])):
        queue.setdefault(r["source"] if r["source"] in queries.WEIGHTS else mixing.REST, []).append(r["doc_id"])
    blocks = {s: [d[k : k + 16] for k in range(0, len(d), 16)] for s, d in queue.items()}
    weights, place = {**queries.WEIGHTS, mixing.REST: 1}, {}
    while blocks:
        period = {s: weights[s] for s in blocks}
        if any(len(blocks[s]) < c for s, c in period.items()):
            period = {s: min(len(blocks[s]), c) for s, c in period.items()}
        slots, done = sum(period.values()), dict.fromkeys(period, 0)
        for now in range(slots):
            ready = []
            for s, c in period.items():
                i = done[s] + 1
                if i <= c and Fraction((i - 1) * slots, c) // 1 <= now:
                    heapq.heappush(ready, (-(-i * slots // c), s))
            s = heapq.heappop(ready)[1]
            done[s] += 1
            for d in blocks[s].pop(0):
                place[d] = len(place)
        blocks = {s: b for s, b in blocks.items() if b}
    return place


def test_op8(spark):
    got = {r["doc_id"]: r["position"] for r in queries.op8_mix(spark, SF).collect()}
    assert got == plain_mix(spark)


def test_op9(spark, texts):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    holds([tuple(r) for r in queries.op9_packing(spark, SF).collect()], {d: [*lib.encode(t, add_special_tokens=False).ids, 1] for d, t in texts.items()}, 2048)


def test_op10(spark, texts):
    first, after = (set(x) for x in token_counts.pieces_of(public_tokenizers.path("byte_bpe_50k.json")))
    some = {d: t for d, t in texts.items() if len(t) < 3000}
    got = {r["doc_id"]: tuple(r)[1:4] for r in queries.op10_token_counts(spark, SF).collect()}
    assert len(got) == len(texts)
    for d, t in some.items():
        words = t.encode().split()
        assert got[d] == (len(words), sum(greedy(w, first, after) for w in words), len(t.encode())), json.dumps(t[:50])
