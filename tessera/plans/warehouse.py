"""Warehouse queries over the event stream and the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import bitmaps
from tessera.operators import warehouse as W
from tessera.registry import query, sql
from tessera.tables import table

MODAL = """day AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type, count(*) AS n FROM events GROUP BY ALL),
     modal AS (SELECT user_id, d, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, d ORDER BY n DESC, event_type) AS r FROM day) WHERE r = 1)"""


def modal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's most frequent event type per day, ties by name: user_id, valid_from (the day), event_type."""
    n = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("valid_from"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct(-F.col("n"), F.col("event_type")))
    return n.groupBy("user_id", "valid_from").agg(best.alias("b")).select("user_id", "valid_from", F.col("b.event_type").alias("event_type"))


@query("w03_gap_and_island",
       f"""WITH {MODAL}, f AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY d) THEN 0 ELSE 1 END AS new FROM modal),
           i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY d)::BIGINT AS version FROM f)
           SELECT user_id, event_type, version, min(d) AS valid_from, CASE WHEN max(d) < (SELECT max(d) FROM modal) THEN max(d) END AS valid_to FROM i GROUP BY user_id, event_type, version""")
def w03(spark, sf_dir):
    return W.islands(modal_states(spark, sf_dir).withColumnRenamed("valid_from", "d"), ["user_id"], "d", ["event_type"])


@query("w04_streaks",
       """WITH e AS (SELECT user_id, event_id, ts, event_type = 'error' AS bad FROM events), f AS (SELECT *, CASE WHEN bad = lag(bad) OVER w THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
               i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS streak FROM f)
          SELECT user_id, bad, min(event_id) AS first_event, count(*) AS length, streak = max(streak) OVER (PARTITION BY user_id) AS is_current FROM i GROUP BY user_id, bad, streak""")
def w04(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("bad"))
    e = e.withColumn("new", (~F.col("bad").eqNullSafe(F.lag("bad").over(w))).cast("int")).withColumn("streak", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = e.groupBy("user_id", "bad", "streak").agg(F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("length"))
    return s.select("user_id", "bad", "first_event", "length", (F.col("streak") == F.max("streak").over(Window.partitionBy("user_id"))).alias("is_current"))


def _halves(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    new = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 5000, F.lit("GOLD")).otherwise(F.col("c_mktsegment")).alias("v"))
    return old, new


HALVES = """o AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 <> 0),
            n AS (SELECT c_custkey AS k, CASE WHEN c_acctbal > 5000 THEN 'GOLD' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 2 = 0)"""


@query("u01_scd1_upsert", f"WITH {HALVES} SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.v ELSE o.v END AS v FROM o FULL JOIN n ON o.k = n.k")
def u01(spark, sf_dir):
    return W.scd1(*_halves(spark, sf_dir), ["k"])


@query("u02_scd2_load",
       f"""WITH {HALVES}, d AS (SELECT n.k, n.v, o.k IS NULL AS fresh FROM n LEFT JOIN o ON o.k = n.k WHERE o.k IS NULL OR o.v IS DISTINCT FROM n.v)
           SELECT o.k, o.v, DATE '2024-05-04' AS valid_from, CASE WHEN d.k IS NOT NULL THEN DATE '2024-05-04' END AS valid_to, 1::BIGINT AS version, d.k IS NULL AS active FROM o LEFT JOIN d ON d.k = o.k
           UNION ALL SELECT k, v, DATE '2024-05-05', NULL, CASE WHEN fresh THEN 1 ELSE 2 END, true FROM d""")
def u02(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    dim = old.select("k", "v", F.lit("2024-05-04").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(1).cast("long").alias("version"), F.lit(True).alias("active"))
    return W.scd2(dim, new, ["k"], ["v"], F.lit("2024-05-05").cast("date"))


@query("u03_scd3_upsert", f"WITH {HALVES} SELECT coalesce(o.k, n.k) AS k, coalesce(n.v, o.v) AS v, CASE WHEN n.v <> o.v THEN o.v END AS previous FROM o FULL JOIN n ON o.k = n.k")
def u03(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return W.scd3(old.withColumn("previous", F.lit(None).cast("string")), new, ["k"], "v")


@query("u04_scd6_current_value",
       f"""WITH {MODAL}, f AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY d) THEN 0 ELSE 1 END AS new FROM modal), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY d)::BIGINT AS version FROM f),
           v AS (SELECT user_id, event_type, version, min(d) AS valid_from FROM i GROUP BY ALL)
           SELECT user_id, version, event_type, valid_from, last_value(event_type) OVER (PARTITION BY user_id ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS current_value FROM v""")
def u04(spark, sf_dir):
    v = W.islands(modal_states(spark, sf_dir).withColumnRenamed("valid_from", "d"), ["user_id"], "d", ["event_type"])
    return v.select("user_id", "version", "event_type", "valid_from", F.max_by("event_type", "version").over(Window.partitionBy("user_id")).alias("current_value"))


@query("u05_generic_upsert", """WITH s AS (SELECT * FROM (SELECT o_custkey AS k, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1)
          SELECT k, v FROM s UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT k FROM s)""")
def u05(spark, sf_dir):
    target = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(0).cast("long").alias("o"))
    source = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("o"))
    return W.upsert(target, source, ["k"], [F.desc("o")]).select("k", "v")


@query("u08_cumulative_day",
       """SELECT user_id, list_sort(list(DISTINCT CAST(ts AS DATE))) AS days,
                 sum(DISTINCT (1::BIGINT << (31 - date_diff('day', CAST(ts AS DATE), DATE '2024-01-04'))))::BIGINT AS bitmap FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-04' GROUP BY user_id""")
def u08(spark, sf_dir):
    """Four daily loads, one after the other."""
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("d"))
    state = spark.createDataFrame([], "user_id long, days array<date>, bitmap long")
    for day in range(1, 5):
        d = F.lit(f"2024-01-0{day}").cast("date")
        state = W.cumulative_day(state, events.filter(F.col("d") == d), "user_id", d)
    return state


@query("u09_monthly_arrays",
       """WITH d AS (SELECT o_custkey AS k, date_trunc('month', o_orderdate)::DATE AS month, day(o_orderdate) AS n, sum(o_totalprice) AS v FROM orders GROUP BY ALL), m AS (SELECT k, month, max(n) AS top, sum(v) AS total, sum(1::BIGINT << (32 - n))::BIGINT AS bitmap FROM d GROUP BY k, month),
               g AS (SELECT k, month, total, bitmap, unnest(range(1, top + 1)) AS i FROM m)
          SELECT g.k, g.month, list(round(coalesce(d.v, 0), 2) ORDER BY g.i) AS daily, round(total, 2) AS total, bitmap FROM g LEFT JOIN d ON g.k = d.k AND g.month = d.month AND g.i = d.n GROUP BY g.k, g.month, total, bitmap""")
def u09(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d"), "o_totalprice")
    return W.monthly_arrays(o, "k", "d", "o_totalprice").select("k", "month", F.transform("daily", lambda x: F.round(x, 2)).alias("daily"), F.round("total", 2).alias("total"), "bitmap")


GRID = """a AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events),
          g AS (SELECT user_id, CAST(unnest(generate_series(min(d), DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day FROM a GROUP BY user_id)"""


@query("u12_backfilled_bitmaps", f"WITH {GRID} SELECT g.user_id, g.day, count(a.d) AS days, coalesce(sum(1::BIGINT << (31 - date_diff('day', a.d, g.day))), 0)::BIGINT AS bitmap FROM g LEFT JOIN a ON a.user_id = g.user_id AND a.d <= g.day GROUP BY g.user_id, g.day")
def u12(spark, sf_dir):
    a = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("d"))
    return W.cumulative_grid(a, "user_id", "d", F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"))


@query("d05_retention_curve",
       f"""WITH {GRID} SELECT g.day, count(*) AS cohort, {", ".join(f"count(*) FILTER (EXISTS (SELECT 1 FROM a WHERE a.user_id = g.user_id AND a.d = g.day - {n})) AS d{n}" for n in (0, 1, 3, 7, 14, 21, 28))},
           round(100.0 * count(*) FILTER (EXISTS (SELECT 1 FROM a WHERE a.user_id = g.user_id AND a.d = g.day - 7)) / nullif(count(*), 0), 2) AS d7_pct FROM g GROUP BY g.day""")
def d05(spark, sf_dir):
    """Per day the users seen so far and how many of them were active so many days before, from bitmaps."""
    grid = u12(spark, sf_dir)
    hit = {n: F.count_if(bitmaps.active_days_ago(F.col("bitmap"), n)) for n in (0, 1, 3, 7, 14, 21, 28)}
    out = grid.groupBy("day").agg(F.count(F.lit(1)).alias("cohort"), *(c.alias(f"d{n}") for n, c in hit.items()))
    return out.withColumn("d7_pct", F.round(F.col("d7") * 100.0 / F.nullif("cohort", F.lit(0)), 2))


sql("d06_daily_gold",
    """WITH e AS (SELECT CAST(ts AS DATE) AS d, user_id, value, event_type FROM {events} JOIN {customer} ON user_id = c_custkey),
            f AS (SELECT user_id, min(d) AS first_d FROM e GROUP BY user_id), n AS (SELECT first_d AS d, count(*) AS new_users FROM f GROUP BY first_d)
       SELECT x.d, x.dau, CAST(sum(coalesce(n.new_users, 0)) OVER (ORDER BY x.d ROWS UNBOUNDED PRECEDING) AS BIGINT) AS users_so_far, round(x.revenue, 4) AS revenue
       FROM (SELECT d, count(DISTINCT user_id) AS dau, coalesce(sum(CASE WHEN event_type = 'purchase' THEN value END), 0) AS revenue FROM e GROUP BY d) x LEFT JOIN n ON n.d = x.d""")
sql("u07_snapshot", "SELECT c_custkey, c_mktsegment, DATE '2024-05-05' AS snapshot_day FROM {customer} WHERE c_acctbal > 0")
sql("u18_run_dimension",
    """SELECT DISTINCT CAST(ts AS DATE) AS run_date, CAST(extract(DAYOFWEEK FROM ts) AS INT) - 1 AS dow, CAST(month(ts) AS INT) AS month, CASE WHEN extract(DAYOFWEEK FROM ts) = 2 THEN 'monday' WHEN extract(DAYOFWEEK FROM ts) = 6 THEN 'friday' ELSE 'midweek' END AS kind FROM {events}""",
    """SELECT DISTINCT CAST(ts AS DATE) AS run_date, dayofweek(ts)::INT AS dow, month(ts)::INT AS month, CASE dayofweek(ts) WHEN 1 THEN 'monday' WHEN 5 THEN 'friday' ELSE 'midweek' END AS kind FROM events""")
sql("u20_graph_load",
    """SELECT 1000 + c_custkey AS src, 2000000 + c_nationkey AS dst, 'LIVES_IN' AS kind, 1.0 AS weight FROM {customer} UNION ALL SELECT 2000000 + n_nationkey, 3000000 + n_regionkey, 'PART_OF', 1.0 FROM {nation}
       UNION ALL SELECT 4000000 + l_suppkey, 5000000 + l_partkey, 'RECOMMENDS', round(max(l_quantity) / 50, 2) FROM {lineitem} WHERE l_quantity >= 40 GROUP BY l_suppkey, l_partkey""")
sql("u22_replace_rule", """SELECT user_id, max_by(event_type, struct(CAST(value AS INT) % 3, value, event_id)) AS chosen FROM {events} GROUP BY user_id""",
    "SELECT user_id, event_type AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY trunc(value)::INT % 3 DESC, value DESC, event_id DESC) AS r FROM events) WHERE r = 1")
sql("u23_hash_duplicates", """SELECT conv_id, turn FROM (SELECT conv_id, turn, sha2(text, 256) AS h, lag(sha2(text, 256), 1) OVER w AS h1, lag(sha2(text, 256), 2) OVER w AS h2, lag(sha2(text, 256), 3) OVER w AS h3 FROM {conversations} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE h IN (h1, h2, h3)""",
    "SELECT conv_id, turn FROM (SELECT conv_id, turn, sha256(text) AS h, lag(sha256(text), 1) OVER w AS h1, lag(sha256(text), 2) OVER w AS h2, lag(sha256(text), 3) OVER w AS h3 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE h IN (h1, h2, h3)")
sql("u24_merge_remap", "SELECT d.doc_id, coalesce(m.target, d.source) AS category FROM {documents} d LEFT JOIN (VALUES ('src1', 'src0'), ('src2', 'src0'), ('src5', 'src4')) AS m(source, target) ON d.source = m.source")
