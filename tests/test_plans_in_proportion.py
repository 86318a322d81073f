"""Operators whose plans avoid pairs or rounds over everything, against brute force on small tables."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import joins as J
from tessera.operators import optimise
from tessera.operators import text as X

DAY = datetime.datetime(2024, 1, 1)


@pytest.mark.parametrize(("seed", "closed"), [(1, True), (2, False), (3, True)])
def test_depth(spark, seed, closed):
    rnd = random.Random(seed)
    at = lambda m: DAY + datetime.timedelta(minutes=m)
    spans = [(rnd.choice("ab"), at(s), at(s + rnd.choice([0, 5, 90, 700]))) for s in (rnd.randrange(0, 2000, 5) for _ in range(60))] + [("a", None, at(3)), ("a", at(3), None)]
    points = [(i, rnd.choice("abc"), at(rnd.randrange(0, 2500, 5))) for i in range(80)]
    got = J.depth(spark.createDataFrame(points, "i int, k string, t timestamp"), spark.createDataFrame(spans, "k string, s timestamp, e timestamp"), "t", "s", "e", ["k"], closed)
    held = lambda t, s, e: s is not None and e is not None and (s <= t <= e if closed else s <= t < e)
    want = [(i, k, t, sum(k == g and held(t, s, e) for g, s, e in spans)) for i, k, t in points]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_peeling_and_closure(spark, monkeypatch):
    monkeypatch.setattr(G, "RESTAGE", 2)
    rnd = random.Random(4)
    pairs = sorted({(a, b) for a, b in ((rnd.randrange(20), rnd.randrange(20)) for _ in range(40)) if a < b})
    below = {n: {b for a, b in pairs if a == n} for n in range(20)}

    def depth(a, b):
        return max((1 if c == b else 0) or (1 + depth(c, b) if depth(c, b) else 0) for c in below[a]) if below[a] else 0

    level = {n: max([0, *(depth(a, n) for a in range(20))]) for n in {x for p in pairs for x in p}}
    assert {r["node"]: r["level"] for r in G.levels(edges(spark, pairs)).collect()} == level
    found = {(r["root"], r["node"]) for r in G.closure(edges(spark, pairs)).collect()}
    reach = {(a, b) for a in range(20) for b in range(20) if depth(a, b)}
    assert found == reach
    assert not G.has_cycle(edges(spark, pairs))
    assert G.has_cycle(edges(spark, [*pairs, (19, 0), (0, 19)]))
    with pytest.raises(ValueError, match="cycle"):
        G.levels(edges(spark, [(1, 2), (2, 1)]))
    with pytest.raises(ValueError, match="cycle"):
        G.closure(edges(spark, [(1, 2), (2, 1)]))


def test_a_long_chain_has_an_end(spark):
    chain = [(i, i + 1) for i in range(25)]
    assert G.levels(edges(spark, chain)).agg(F.max("level")).first()[0] == 25
    assert G.reachable(edges(spark, chain), spark.createDataFrame([(0,)], "node long")).count() == 26


def test_paths(spark):
    weighted = spark.createDataFrame([(1, 2, 5.0), (1, 3, 1.0), (3, 2, 1.0), (2, 4, 1.0), (3, 4, 9.0), (7, 8, 1.0)], "src long, dst long, weight double")
    got = {r["node"]: r["cost"] for r in G.shortest_paths(weighted, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {1: 0, 3: 1, 2: 2, 4: 3}
    work = spark.createDataFrame([(n, float(n)) for n in (1, 2, 3, 4, 7, 8)], "node long, weight double")
    got = {r["node"]: (r["cost"], r["before"]) for r in G.longest_paths(weighted, work).collect()}
    assert got == {1: (1, None), 3: (4, 1), 2: (6, 3), 4: (10, 2), 7: (7, None), 8: (15, 7)}


def test_greedy_dedup_is_the_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(4).tolist(), i % 2) for i in range(60)]
    kept = []
    for i, v, b in rows:
        near = lambda w: np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.8  # noqa: E731, B023
        if not any(c == b and near(w) for _, w, c in kept):
            kept.append((i, v, b))
    got = X.greedy_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id", "embedding", "label", 0.8)
    assert {r["vec_id"] for r in got.filter("kept").collect()} == {i for i, _, _ in kept}


@pytest.mark.parametrize("name", optimise.OPTIMISERS)
def test_optimisers_keep_items_and_help(name):
    rng = np.random.default_rng(6)
    w, at = rng.exponential(1, 200), rng.integers(0, 5, 200) // 2
    new = optimise.OPTIMISERS[name](w, at, 5, np.random.default_rng(1))
    assert len(new) == 200
    assert np.var(np.bincount(new, w, 5)) <= np.var(np.bincount(at, w, 5))


def test_balance_merges_back(spark):
    rows = [(i, float(i % 7 + 1), i % 3, "x") for i in range(40)]
    got = optimise.balance(spark.createDataFrame(rows, "k long, w double, c int, other string"), "k", "w", "c")
    assert got.columns == ["k", "w", "c", "other", "new_cluster"]
    assert sorted(tuple(r)[:4] for r in got.collect()) == rows


def test_tf_idf_queries(spark):
    docs = spark.createDataFrame([(0, "red green blue"), (1, "red green"), (2, "blue red"), (3, "green red"), (100, "red green blue sky")], "d long, t string")
    got = {(r["d"], r["other"]) for r in X.tf_idf_neighbours(docs, "d", "t", 1, F.col("d") % 100 == 0).collect()}
    assert got == {(0, 100), (100, 0)}
    assert X.tf_idf_neighbours(docs, "d", "t", 2).count() == 10


def test_months_without_orders_are_filled(spark, tmp_path):
    from tessera import catalog

    spark.sql("SELECT 1L AS o_orderkey, TIMESTAMP '1995-03-05' AS o_orderdate, '1-URGENT' AS o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    rows = catalog.QUERIES["a23_gap_filled_pivot"](spark, str(tmp_path)).collect()
    assert len(rows) == 80
    assert [(str(r["month"]), r["urgent"], r["low"]) for r in rows if r["urgent"] or r["low"]] == [("1995-03-01", 1, 0)]


def test_wide_rows_of_a_day_that_adds_up_to_zero(spark, tmp_path):
    """0 / 0, 5 / 0 and -5 / 0 are what they are in the SQL, not an error; a day without values has none."""
    import duckdb

    from tessera import catalog

    at = lambda d: f"TIMESTAMP '2024-01-0{d} 03:04:05'"
    days = [(1, 0.0), (2, 5.0), (2, -5.0), (3, 2.0), (3, 6.0), (4, None), (5, 0.0), (5, None), (6, float("nan")), (6, 1.0)]
    text = " UNION ALL ".join(f"SELECT {i}L AS event_id, {at(d)} AS ts, 7L AS user_id, 'view' AS event_type, {'CAST(NULL AS DOUBLE)' if v is None else f'double({str(v)!r})'} AS value" for i, (d, v) in enumerate(days))
    spark.sql(text).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.QUERIES["p16_wide_rows"](spark, str(tmp_path)).select("event_id", "share", "n_in_day").orderBy("event_id").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"SELECT event_id, share, n_in_day FROM ({catalog.SQL['p16_wide_rows']}) ORDER BY event_id").fetchall()
    assert [str(tuple(r)) for r in got] == [str(r) for r in want]
