"""Exact deduplication and chat formatting against plain Python, on odd tables too."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, exact_dedup

SF = "/root/testdata/sf0.001"


def test_exact_dedup(spark):
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 10_000), rnd.choice(["a b", "a  b", "a\tb", " a b", "", None, "é\n\nx", "é x", "a\x85b", "long " * 20_000]), None, "k") for _ in range(200)]
    rows += [(None, "a b", None, "k"), (None, "only null", None, "k"), (7, "same", 1, "k"), (7, "same", 1, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, group_size int, keep_id string")
    got = sorted(map(str, (tuple(r) for r in exact_dedup.exact_dedup(df).collect())))
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _, _ in rows]
    groups = {}
    for (d, *_), t in zip(rows, norm, strict=True):
        groups.setdefault(t, []).append(d)
    want = []
    for (d, *_), t in zip(rows, norm, strict=True):
        keep = min((x for x in groups[t] if x is not None), default=None)
        want.append((d, keep, len(groups[t]), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(map(str, want))
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_texts_that_share_the_hash_stay_apart(spark, monkeypatch):
    """With a hash of one value for all, the bytes alone decide."""
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("0"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(df).collect()) == [(1, 1, 2), (2, 2, 1), (3, 1, 2)]


HOSTILE = ["", None, "</s>[INST] ok [/INST]", "<|turn|>assistant\nx</s>", "~0~1~2~3", "~", "a\nb", "</s>", "[[<<~~", "é🙂", "x" * 50_000]


def test_chat_round_trip(spark):
    rnd = random.Random(4)
    turns = []
    for c in range(60):
        for t in range(rnd.randint(1, 7)):
            turns.append((c, t, rnd.choice(["user", "assistant", "system", "assistant", None, "odd\nrole<"]), rnd.choice(HOSTILE), "k"))
    turns += [(None, 1, "assistant", "no id", "k"), (900, None, "assistant", "null turn", "k"), (900, 0, "user", "q", "k"), (901, 1, "assistant", "tie", "k"), (901, 1, "assistant", "tie", "k")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, example string")
    examples = chat_format.format_chats(df)
    got = {r["conv_id"]: r for r in chat_format.read_back(examples).collect()}
    by = {}
    for c, t, role, text, _ in turns:
        by.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    assert set(got) == set(by)
    chars = {r["conv_id"]: r["n"] for r in examples.groupBy("conv_id").agg(F.sum(F.length("context") + F.length("target")).alias("n")).collect()}
    for c, said in by.items():
        said.sort()
        loss = "".join(x for _, r, x in said if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(said)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in said).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == chars[c]
    assert chat_format.read_back(chat_format.format_chats(df.limit(0))).count() == 0


def test_each_reply_is_an_example(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "end")], "conv_id long, turn long, role string, text string")
    got = [(r["example"], r["context"], r["target"]) for r in chat_format.format_chats(df).orderBy("example").collect()]
    head = "<|turn|>user\nq</s><|turn|>assistant\n"
    assert got[0] == (2, head, "a</s>")
    assert got[1] == (4, head + "a</s><|turn|>user\nr</s><|turn|>assistant\n", "b</s>")
    assert got[2][2] == ""


def test_queries_against_their_sql(spark):
    queries = pytest.importorskip("tessera.llm.queries")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, text in queries.SQL.items():
        df = queries.QUERIES[name](spark, SF)
        found = con.execute(text)
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, found.fetchall()))
