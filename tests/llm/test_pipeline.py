"""The stages of the pipeline against plain versions, each on its own input."""

import re
import zlib

import pytest

pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")
import corpus_pipeline as C
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import mixing, toxicity
from tessera.tables import table
from tests.llm.test_ngram_join import brute
from tests.llm.test_packing import holds

SF = "/root/testdata/sf0.001"


def test_every_stage(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        scores = toxicity.toxicity(docs, table(spark, SF, "labels")) if name == "toxicity" else None
        order = mixing.mix(docs, C.WEIGHTS) if name == "mixing" else None
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name == "packing":
            lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            holds([tuple(r) for r in docs.collect()], {d: lib.encode(t or "", add_special_tokens=False).ids + [1] for d, t in rows.items()}, 2048)
            break
        assert docs.columns == columns
        stored = [r["doc_id"] for r in docs.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
        kept = set(stored)
        if name == "toxicity":
            assert kept == {r["doc_id"] for r in scores.collect() if not r["predicted"]}
        elif name == "exact dedup":
            first = {}
            for d in sorted(rows):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[d] or ""), d)
            assert kept == set(first.values())
        elif name == "n-gram join":
            assert kept == {d for d, _, c in brute(list(rows.items()), 5, 80) if d == c}
        else:
            assert stored == [r["doc_id"] for r in order.orderBy("position").collect()]
        rows = {d: rows[d] for d in kept}
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == rows


def test_mix_is_pfair(spark):
    for counts in ({"a": 1, "b": 2, "c": 7}, {"x": 50, **{f"s{i}": 1 for i in range(50)}}, {"a": 3}):
        total = sum(counts.values())
        got = mixing.pfair(counts)
        for t in range(1, total + 1):
            for s, c in counts.items():
                assert abs(got[:t].count(s) - t * c / total) < 1


def test_mix_table(spark):
    rows = [(i, "ab"[i % 7 == 0]) for i in range(500)] + [(1000 + i, None) for i in range(5)] + [(None, "c"), (3, "a")]
    df = spark.createDataFrame([(d, s, 9) for d, s in rows], "doc_id long, source string, slot int")
    got = mixing.mix(df, {"a": 3, "b": 2}, block_docs=4).collect()
    assert sorted(r["position"] for r in got) == list(range(len(rows)))
    slots = {}
    for r in got:
        slots.setdefault(r["slot"], set()).add((r["mix_source"], r["block"]))
    assert all(len(x) == 1 for x in slots.values())
    assert sorted(slots) == list(range(len(slots)))
    order = [next(iter(slots[s]))[0] for s in sorted(slots)]
    plan = mixing.plan({s: len({b for n, b in (next(iter(x)) for x in slots.values()) if n == s}) for s in set(order)}, {"a": 3, "b": 2, mixing.REST: 1})
    for at, size, times, _, period in plan:
        part = order[at : at + size * times]
        for t in range(1, len(part) + 1):
            for s, c in period.items():
                assert abs(part[:t].count(s) - t * c / size) < 1
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string"), {"a": 1}).count() == 0


def test_toxicity_learns_and_holds_out(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 6 == 0
        w = list(rng.choice(words, 40)) + (list(rng.choice(["vile", "nasty", "rotten"], 2)) if toxic else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w), "x"))
        if i // 6 % 2 == 0:
            labels.append((i, int(toxic)))
    df = spark.createDataFrame([*rows, (None, "vile nasty", "x"), (5000, None, "x"), (5001, "", "x"), (7, rows[7][1], "y")], "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1), (9, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(df, lab).collect()
    assert len(got) == 1204
    import zlib

    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
        assert r["predicted"] == (r["score"] >= 0.5)
    known = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1200 and r["held_out"]]
    right = [r["predicted"] == (r["doc_id"] % 6 == 0) for r in known]
    assert sum(right) > 0.9 * len(right), [(r["doc_id"], r["score"]) for r in known if r["predicted"] != (r["doc_id"] % 6 == 0)]
    # labels of the held-out fold change nothing
    flipped = lab.filter("doc_id IS NOT NULL").withColumn("toxic", F.expr("if(crc32(encode(string(doc_id), 'UTF-8')) % 5 = 0, 1 - toxic, toxic)"))
    again = {str(r["doc_id"]): r["score"] for r in toxicity.toxicity(df, flipped).collect()}
    assert all(again[str(r["doc_id"])] == r["score"] for r in got if r["doc_id"] != 7)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(df, none).collect()} == {0.0}
    assert toxicity.toxicity(df.limit(0), lab).count() == 0


def odd_rows():
    """Nulls, empty texts, repeated rows and ids, toxic and near copies without an id; columns with the stages' own names."""
    base = "the quick brown fox jumps over the lazy dog and runs through the green field to the old barn by the river ".split()
    near = " ".join(base * 6)
    rows = [(i, f"w{i} " * 30 + " ".join(f"v{i}x{j}" for j in range(30)), f"src{i % 4}") for i in range(40)]
    rows += [(50, near, "src0"), (51, near + "once more", "src1"), (None, near + "again", None), (60, "same text", "src0"), (60, "same text", "src0"), (61, "same  text", "src1"), (None, "same text", "src1")]
    rows += [(None, "no id at all", None), (None, "no id at all", None), (70, "first of two", "src2"), (70, "second of two", "src2"), (71, None, "src2"), (72, "", None), (73, "   ", "src3"), (None, None, None)]
    return [(d, t, "en", s, len(t or ""), 7, "p", i, {"a": i}) for i, (d, t, s) in enumerate(rows)]


ODD = "doc_id long, text string, lang string, source string, n_chars long, position int, mix_source string, score int, given map<string,int>"


@pytest.mark.parametrize("written", [True, False])
def test_stages_on_odd_tables(spark, tmp_path, written):
    labels = tmp_path / "in"
    spark.createDataFrame([(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(labels / "labels.parquet"))
    docs = spark.createDataFrame(odd_rows(), ODD)
    rows = odd_rows()
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, str(labels))
        if written:
            out.write.parquet(str(tmp_path / str(k)))
            out = spark.read.parquet(str(tmp_path / str(k)))
        got = [tuple(r) for r in out.collect()]
        if name == "packing":
            lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            totals = sorted((r[0] is not None, r[0] or 0, r[4]) for r in got if r[1] == 0)
            assert totals == sorted((d is not None, d or 0, len(lib.encode(t or "", add_special_tokens=False).ids) + 1) for d, t, *_ in rows)
            break
        assert out.columns == docs.columns
        if name == "exact dedup":
            best = {}
            for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
                best.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
            assert sorted((r[:2] for r in got), key=str) == sorted((r[:2] for r in best.values()), key=str)
            rows = got
        elif name == "n-gram join":
            kept = [r for r in rows if r[0] != 51]
            assert sorted(got, key=str) == sorted(kept, key=str)
            rows = kept
        else:
            assert sorted(got, key=str) == sorted(rows, key=str)
        docs = out


def test_toxic_rows_without_an_id_go(spark, tmp_path):
    words = [f"w{i}" for i in range(200)]
    rnd = np.random.default_rng(2)
    rows = [(i, " ".join(rnd.choice(words, 30)) + (" vile rotten" if i % 5 == 0 else ""), "x", "s", 1) for i in range(900)]
    spark.createDataFrame([(i, 0, int(i % 5 == 0)) for i in range(0, 900, 3)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows += [(None, "vile rotten " + rows[1][1], "x", "s", 1), (None, rows[2][1], "x", "s", 1), (1, "vile rotten w1", "x", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {(r["doc_id"], r["text"]) for r in C.clean(spark, docs, str(tmp_path)).collect()}
    assert {r[:2] for r in rows[-3:]} & kept == {rows[-2][:2]}
    assert rows[1][:2] in kept


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


def test_run_leaves_its_result_only(spark, tmp_path, monkeypatch):
    import os

    from tessera.llm import _shared

    monkeypatch.setattr(_shared, "shared_dir", lambda spark: str(tmp_path))
    found = C.run(spark, SF)
    assert found.count() > 0
    assert [d.rsplit("-", 1)[0] for d in os.listdir(tmp_path)] == ["pipeline-packing"]


def test_toxicity_learns_from_every_row(spark, monkeypatch):
    """More toxic and other documents than a sample of the fit once held: all of the folds are counted."""
    n = 20_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat(if(id % 3 = 0, 'vile slur', 'kind word'), ' w', id % 7) AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "CAST(id % 3 = 0 AS INT) AS toxic")
    folds = [zlib.crc32(str(i).encode()) % 5 for i in range(n)]
    seen = {}
    fitted = toxicity.nn_pu
    monkeypatch.setattr(toxicity, "STEPS", 2)
    monkeypatch.setattr(toxicity, "nn_pu", lambda step, n_u, n_p, *rest: seen.update(u=n_u.tolist(), p=n_p.tolist(), sums=step(np.zeros((4, rest[1])), np.zeros(4))) or fitted(step, n_u, n_p, *rest))
    assert toxicity.fit(docs, labels) is not None
    assert seen["u"] == [sum(f not in (0, k) for f in folds) for k in range(1, 5)]
    assert seen["p"] == [sum(f not in (0, k) and i % 3 == 0 for i, f in enumerate(folds)) for k in range(1, 5)]
    assert np.allclose(seen["sums"][:, 0, -2], np.array(seen["u"]) / 2)
    assert np.allclose(seen["sums"][:, 1, -2], np.array(seen["p"]) / 2)


def test_toxicity_learns_every_word_that_differs(spark, monkeypatch):
    """More words that tell toxic documents apart than a classifier once took, in slices and as one."""
    bad = " ".join(f"bad{i}" for i in range(40_000))
    docs = spark.createDataFrame([(i, bad if i % 5 == 0 else f"kind word w{i % 7}") for i in range(120)], "doc_id long, text string").repartition(3)
    labels = spark.range(120).selectExpr("id AS doc_id", "CAST(id % 5 = 0 AS INT) AS toxic")
    monkeypatch.setattr(toxicity, "STEPS", 2)
    model = toxicity.fit(docs, labels)
    assert len(model.words) >= 40_000
    monkeypatch.setattr(toxicity, "SLICE_WORDS", 1 << 20)
    whole = toxicity.fit(docs, labels)
    assert (model.words == whole.words).all()
    assert np.allclose(model.weights, whole.weights)
    assert np.allclose(model.bias, whole.bias)


def test_groups_take_all_texts_of_an_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(60, a), (65, b), (70, a), (70, b), (75, "no copy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, C.distinct_groups(spark, docs, SF).collect())) == [rows[0], rows[4]]
