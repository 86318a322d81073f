"""Operators without SQL of their own."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import balancing, graph, orchestration, paging, spatial, text, timeseries
from tessera.sources import files
from tessera.streaming import events as S
from tessera.tables import table

SF = "/root/testdata/sf0.001"


def test_pages(spark):
    o = table(spark, SF, "orders").select("o_orderdate", "o_orderkey")
    seen = [r["o_orderkey"] for p in paging.pages(o, ["o_orderdate", "o_orderkey"], 400) for r in p]
    assert seen == [r["o_orderkey"] for r in o.orderBy("o_orderdate", "o_orderkey").collect()]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1;x\x00y\nq;z\n")
    good, bad = files.split_bad(files.read_delimited(spark, str(tmp_path / "*.csv"), ["k", "v"]), {"k": "int"})
    assert [tuple(r) for r in good.collect()] == [(1, "xy")]
    assert [tuple(r) for r in bad.collect()] == [("q", "z")]
    (tmp_path / "s.json").write_text(json.dumps({"A": ["1", "2"], "B": ["2"]}))
    assert sorted(tuple(r) for r in files.read_sets(spark, str(tmp_path / "s.json")).collect()) == [("A", "1"), ("A", "2"), ("B", "2")]
    lines = spark.createDataFrame([('Jan 1 host: {"appname": "a", "severity": "x", "timestamp": "t"}',), ("junk",)], "value string")
    ok, rest = files.parse_log_lines(lines)
    assert [r["appname"] for r in ok.collect()] == ["a"]
    assert rest.count() == 1
    html = spark.createDataFrame([(1, "<table><tr><th>a</th><th> b </th></tr><tr><td>1</td><td><b>2</b></td></tr><tr><td>3</td></tr></table>")], "id int, html string")
    assert [r["cells"] for r in files.html_rows(html, "id", "html", 2).orderBy("row").collect()] == [["a", "b"], ["1", "2"]]
    o = table(spark, SF, "orders")
    files.write_layout(o, str(tmp_path / "flat"))
    files.write_layout(o.withColumn("y", F.year("o_orderdate")), str(tmp_path / "by"), ["y"])
    assert spark.read.parquet(str(tmp_path / "flat")).count() == spark.read.parquet(str(tmp_path / "by")).count() == o.count()
    d = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "v int, d string")
    files.overwrite_days(d, str(tmp_path / "days"), "d")
    files.overwrite_days(d.filter("v = 2").withColumn("v", F.lit(5)), str(tmp_path / "days"), "d")
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "days")).collect()) == [1, 5]


def stream(spark, tmp_path, df):
    df.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))


def run(df, tmp_path, mode="complete"):
    spark, name = df.sparkSession, f"q{abs(hash(str(tmp_path)))}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_tumbling_stream_equals_batch(spark, tmp_path):
    e = table(spark, SF, "events")
    got = {(r["start"], r["event_type"]): r["n"] for r in run(S.tumbling(stream(spark, tmp_path, e), "ts", "event_type"), tmp_path).collect()}
    want = {(r["d"], r["event_type"]): r["count"] for r in e.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("d"), "event_type").count().collect()}
    assert got == want


def test_sessions_and_once(spark, tmp_path):
    e = table(spark, SF, "events").limit(300)
    got = run(S.sessions(stream(spark, tmp_path, e), "ts", "user_id"), tmp_path)
    assert got.agg(F.sum("n")).first()[0] == 300
    twice = e.union(e)
    (tmp_path / "b").mkdir()
    assert run(S.once(stream(spark, tmp_path / "b", twice), "ts", "event_id"), tmp_path / "b", "append").count() == 300


def test_cooldown(spark, tmp_path):
    at = [dt.datetime(2024, 1, 1, 0, m) for m in (0, 5, 20, 21, 50)]
    df = spark.createDataFrame([("a", t) for t in at], "k string, ts timestamp")
    got = sorted(r["ts"].minute for r in run(S.cooled_down(stream(spark, tmp_path, df), "k", "ts", 900), tmp_path, "append").collect())
    assert got == [0, 20, 50]


def test_rice_and_beta(spark):
    assert spatial.rice_cdf(1.5, 0.0) == pytest.approx(1 - math.exp(-1.125), abs=1e-9)
    rnd = np.random.default_rng(1)
    for b, x in ((0.5, 1.0), (3.0, 2.5), (8.0, 9.0), (40.0, 40.5)):
        r = np.hypot(b + rnd.standard_normal(400_000), rnd.standard_normal(400_000))
        assert spatial.rice_cdf(x, b) == pytest.approx((r <= x).mean(), abs=4e-3)
    assert spatial.beta_quantile(0.5, 1, 1) == pytest.approx(0.5)
    assert spatial.beta_quantile(0.975, 6, 5) == pytest.approx(0.8129, abs=1e-3)
    lo, hi = spatial.clopper_pearson(5, 10)
    assert (lo, hi) == (pytest.approx(0.1871, abs=1e-3), pytest.approx(0.8129, abs=1e-3))
    p, lo, hi = spatial.monte_carlo_within(spark, 100.0, 50.0, 120.0, 50_000)
    assert lo <= spatial.rice_cdf(120 / 50, 100 / 50) + 0.01
    assert hi >= spatial.rice_cdf(120 / 50, 100 / 50) - 0.01
    d = spatial.within_probability(spark.createDataFrame([(100.0, 30.0, 40.0)], "d double, s double, t double"), "d", "s", "t", 120.0).first()["p"]
    assert d == pytest.approx(float(spatial.rice_cdf(2.4, 2.0)))


def test_grid_and_pairs(spark):
    g = spatial.grid(spark, -1, 1, -1, 1, 40)
    p = spatial.region_probability(g, F.lit(1.0), F.col("lon") < 0).first()[0]
    assert p == pytest.approx(0.5)
    pts = spark.createDataFrame([(i, (i * 37 % 120 - 60) * 1.0, (i * 91 % 340 - 170) * 1.0) for i in range(200)], "k long, lat double, lon double")
    got = {(r["k"], r["k2"]) for r in spatial.near_pairs(pts, pts, 900_000.0).collect()}
    both = pts.crossJoin(pts.select(F.col("k").alias("k2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")))
    want = {(r["k"], r["k2"]) for r in both.filter(scalar.haversine(*map(F.col, ("lat", "lon", "lat2", "lon2"))) <= 900_000).collect()}
    assert got == want


def test_balance_conserves_items(spark):
    items = table(spark, SF, "part").select("p_partkey", "p_retailprice")
    got = balancing.lpt(items, "p_partkey", "p_retailprice", 5)
    assert got.select("p_partkey").distinct().count() == items.count() == got.count()
    load = [r["w"] for r in got.groupBy("bin").agg(F.sum("p_retailprice").alias("w")).collect()]
    assert len(load) == 5
    assert max(load) / min(load) < 1.1


def test_graph_cycle_and_levels(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "src int, dst int")
    assert {r["node"]: r["level"] for r in graph.levels(e).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    assert not graph.has_cycle(e)
    loop = e.union(spark.createDataFrame([(4, 1)], "src int, dst int"))
    assert graph.has_cycle(loop)
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(loop)


def test_chunks_cover_sentences(spark):
    t = " ".join(f"Word{i} is here." for i in range(900))
    got = text.sentence_chunks(spark.createDataFrame([(1, t), (2, None)], "d int, t string"), "d", "t", 60, 10).orderBy("chunk").collect()
    assert all(r["words"] <= 60 for r in got)
    assert {w for r in got for w in r["text"].split()} == set(t.split())


def test_backtest_closes_by_stop(spark):
    bars = spark.createDataFrame([("a", i, p, s) for i, (p, s) in enumerate([(100.0, 1), (101.0, 0), (90.0, 1), (90.0, 0)])], "k string, t int, p double, s int")
    got = timeseries.backtest(bars, "k", "t", "p", "s").orderBy("t").collect()
    assert got[2]["trades"] == 1
    assert got[2]["position"] == 0
    assert got[2]["equity"] == pytest.approx(10_000 * 0.999 / (100 * 1.0005) * 90 * 0.9995 * 0.999)


def test_semver(spark):
    d = spark.createDataFrame([("v1.2.3",), ("1.10.0",), ("x",)], "t string").select("t", scalar.semver(F.col("t")).alias("v"))
    assert [r["t"] for r in d.filter("v IS NOT NULL").orderBy("v").collect()] == ["v1.2.3", "1.10.0"]
    assert d.filter("v IS NULL").count() == 1


def test_deep_chains_are_not_cut(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(5)], "src long, dst long").coalesce(1)
    roots = spark.createDataFrame([(0,)], "node long")
    assert sorted(tuple(r) for r in graph.reachable(e, roots).collect()) == [(i, i) for i in range(6)]
    assert graph.reachable(e, roots, most=5).count() == 6
    with pytest.raises(ValueError, match="hops"):
        graph.reachable(e, roots, most=3)
    edges = e.selectExpr("dst AS task", "src AS dep")
    tasks = edges.select("task").union(edges.select("dep"))
    none = tasks.limit(0)
    assert {r["status"] for r in orchestration.simulate(tasks, edges, none).collect()} == {"SUCCESS"}
    with pytest.raises(ValueError, match="waves"):
        orchestration.simulate(tasks, edges, none, most=3)
