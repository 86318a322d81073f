"""Joins."""

from pyspark.sql import functions as F

from tessera.operators import joins as J
from tessera.registry import query, sql
from tessera.tables import table

sql("j01_star_join", """SELECT p_brand, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY p_brand""")
sql("j02_bridge_join", "SELECT DISTINCT s_name, p_name FROM {supplier} JOIN {lineitem} ON s_suppkey = l_suppkey JOIN {part} ON l_partkey = p_partkey")
sql("j03_join_chain",
    """SELECT n_name, count(*) AS n FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
       WHERE l_returnflag = 'R' GROUP BY n_name""")
sql("j04_left_join_changed",
    """SELECT a.user_id, a.n AS now, b.n AS before FROM (SELECT user_id, count(*) AS n FROM {events} WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY user_id) a
       LEFT JOIN (SELECT user_id, count(*) AS n FROM {events} WHERE ts < TIMESTAMP '2024-01-16' GROUP BY user_id) b ON a.user_id = b.user_id WHERE b.user_id IS NULL OR b.n <> a.n""")
sql("j05_full_outer_days",
    """SELECT coalesce(t.user_id, y.user_id) AS user_id, t.user_id IS NOT NULL AS today, y.user_id IS NOT NULL AS yesterday
       FROM (SELECT DISTINCT user_id FROM {events} WHERE CAST(ts AS DATE) = DATE '2024-01-10') t
       FULL OUTER JOIN (SELECT DISTINCT user_id FROM {events} WHERE CAST(ts AS DATE) = DATE '2024-01-09') y ON t.user_id = y.user_id""")
sql("j06_full_outer_aggregates",
    """SELECT coalesce(a.k, b.k) AS nationkey, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers
       FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} GROUP BY c_nationkey) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} GROUP BY s_nationkey) b ON a.k = b.k""")
_PIT = """WITH day AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type, count(*) AS n FROM events GROUP BY ALL),
     modal AS (SELECT user_id, d, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, d ORDER BY n DESC, event_type) AS r FROM day) WHERE r = 1),
     dim AS (SELECT user_id, event_type, d AS valid_from, lead(d) OVER (PARTITION BY user_id ORDER BY d) - 1 AS valid_to FROM modal)"""


@query("j07_point_in_time", _PIT + """ SELECT e.event_id, dim.event_type AS state FROM events e JOIN dim ON e.user_id = dim.user_id AND CAST(e.ts AS DATE) - 1 >= valid_from AND (CAST(e.ts AS DATE) - 1 <= valid_to OR valid_to IS NULL)""")
def j07(spark, sf_dir):
    """Each event with the user's state as of the day before."""
    from tessera.plans.warehouse import modal_states

    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.date_sub(F.to_date("ts"), 1).alias("d"))
    dim = modal_states(spark, sf_dir).withColumnRenamed("event_type", "state")
    return J.as_of(events, dim, ["user_id"], "d", "valid_from").filter("state IS NOT NULL").select("event_id", "state")


sql("j09_anti_join", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)")
sql("j10_removed_added",
    """WITH a AS (SELECT DISTINCT l_partkey FROM {lineitem} WHERE l_shipdate < TIMESTAMP '1996-01-01'), b AS (SELECT DISTINCT l_partkey FROM {lineitem} WHERE l_shipdate >= TIMESTAMP '2000-06-01')
       SELECT 'REMOVED' AS change, l_partkey FROM a WHERE l_partkey NOT IN (SELECT l_partkey FROM b) UNION ALL SELECT 'ADDED', l_partkey FROM b WHERE l_partkey NOT IN (SELECT l_partkey FROM a)""")
sql("j11_semi_join", "SELECT o_orderkey FROM {orders} WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_discount > 0.09)")
sql("j12_leaves", "SELECT n_nationkey FROM {nation} WHERE NOT EXISTS (SELECT 1 FROM {supplier} WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")
sql("j13_pairs_by_day",
    """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS d, event_type FROM {events}) SELECT a.event_type AS a, b.event_type AS b, count(*) AS days FROM d a JOIN d b ON a.d = b.d AND b.event_type > a.event_type GROUP BY a.event_type, b.event_type""")
sql("j14_two_hops",
    """WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM {lineitem}) SELECT DISTINCT a.src AS supplier, b.src AS other FROM e a JOIN e b ON a.dst = b.dst AND a.src <> b.src""")
sql("j16_common_neighbours",
    """WITH e AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey)
       SELECT a.c AS a, b.c AS b, count(*) AS common FROM e a JOIN e b ON a.p = b.p AND a.c < b.c GROUP BY a.c, b.c""")
sql("j18_cross_generator", "SELECT a.id AS x, b.id AS s FROM range(60) a CROSS JOIN range(7) b WHERE (a.id * 7 + b.id * 13) % 5 < 2",
    "SELECT a.range AS x, b.range AS s FROM range(60) a CROSS JOIN range(7) b WHERE (a.range * 7 + b.range * 13) % 5 < 2")
sql("j19_scalar_params", "WITH p AS (SELECT avg(o_totalprice) AS m FROM {orders}) SELECT o_orderkey FROM {orders} CROSS JOIN p WHERE o_totalprice > 1.9 * m")
sql("j20_lateral_unnest", "SELECT r_name, x FROM {region} LATERAL VIEW explode(split(r_name, '')) AS x", "SELECT r_name, unnest(string_split(r_name, '')) AS x FROM region")


@query("j21_weighted_bridge",
       """WITH b AS (SELECT l_orderkey, l_partkey, l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey) AS w FROM lineitem)
          SELECT l_partkey, round(sum(o_totalprice * w), 2) AS allocated FROM b JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey""")
def j21(spark, sf_dir):
    """Order totals allocated to parts by the weight of their lines."""
    bridge = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    facts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return J.allocate(facts, bridge, "l_orderkey", "o_totalprice", "l_extendedprice").groupBy("l_partkey").agg(F.round(F.sum("allocated"), 2).alias("allocated"))


sql("j22_array_bridge",
    """WITH g AS (SELECT l_orderkey, array_sort(collect_list(struct(l_linenumber, l_partkey, l_quantity))) AS x FROM {lineitem} GROUP BY l_orderkey)
       SELECT part, round(sum(q), 2) AS qty FROM (SELECT inline(arrays_zip(x.l_partkey, x.l_quantity)) AS (part, q) FROM g) GROUP BY part""",
    """WITH g AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity) AS parts, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS qty FROM lineitem GROUP BY l_orderkey)
       SELECT part, round(sum(q), 2) AS qty FROM (SELECT unnest(parts) AS part, unnest(qty) AS q FROM g) GROUP BY part""")
_SESSIONS = """WITH s AS (SELECT user_id, CAST(ts AS DATE) AS d, min(ts) AS a, max(ts) AS b FROM events GROUP BY ALL)"""


@query("j23_queue_depth", _SESSIONS + " SELECT x.user_id, x.d, count(y.user_id) AS depth FROM s x JOIN s y ON x.d = y.d AND y.a <= x.a AND x.a < y.b GROUP BY x.user_id, x.d")
def j23(spark, sf_dir):
    """Sessions open at the start of each session of a day: running counts of starts and ends, not a range join."""
    s = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return J.open_at_start(s, "d", "a", "b").filter("depth > 0").select("user_id", "d", "depth")


sql("j24_first_regex_by_priority",
    """WITH r AS (SELECT * FROM (VALUES (1, 'STEEL'), (2, 'BRASS|COPPER'), (3, '.*')) AS t(prio, re)) SELECT p_partkey, min(prio) AS class FROM {part} JOIN r ON p_type RLIKE re GROUP BY p_partkey""",
    "WITH r AS (SELECT * FROM (VALUES (1, 'STEEL'), (2, 'BRASS|COPPER'), (3, '.*')) AS t(prio, re)) SELECT p_partkey, min(prio) AS class FROM part JOIN r ON regexp_matches(p_type, re) GROUP BY p_partkey")
sql("j26_k_nearest", """SELECT a, b FROM (SELECT a.s_suppkey AS a, b.s_suppkey AS b, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY abs(a.s_acctbal - b.s_acctbal), b.s_suppkey) AS r
       FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey) WHERE r <= 3""")
sql("j27_insert_update_split", """SELECT CASE WHEN EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey) THEN 'update' ELSE 'insert' END AS action, count(*) AS n FROM {customer} GROUP BY 1""",
    "SELECT CASE WHEN o.k IS NOT NULL THEN 'update' ELSE 'insert' END AS action, count(*) AS n FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c_custkey GROUP BY 1")
