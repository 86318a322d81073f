"""Graph and DAG queries."""

from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import graph as G
from tessera.registry import query, sql
from tessera.tables import table

#: A task graph derived from the keys of all parts: task n depends on n / 2 and, for every third, on n / 3. Task 1 is the root.
DAG = "(SELECT p_partkey AS dst, p_partkey // 2 AS src FROM part WHERE p_partkey >= 2 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey >= 3 AND p_partkey % 3 = 0)"


def dag(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter("p_partkey >= 2")
    return p.selectExpr("p_partkey AS dst", "p_partkey div 2 AS src").union(p.filter("p_partkey % 3 = 0").selectExpr("p_partkey", "p_partkey div 3")).distinct()


@query("g01_reachability", f"WITH RECURSIVE e AS {DAG}, r AS (SELECT 1::BIGINT AS node, 0 AS degree UNION SELECT e.dst, r.degree + 1 FROM r JOIN e ON e.src = r.node) SELECT node, min(degree)::INT AS degree FROM r GROUP BY node")
def g01(spark, sf_dir):
    return G.reachable(dag(spark, sf_dir), spark.createDataFrame([(1,)], "node long"))


@query("g02_topological_levels", f"WITH RECURSIVE e AS {DAG}, r AS (SELECT DISTINCT src AS node, 0 AS level FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.node) SELECT node, max(level)::INT AS level FROM r GROUP BY node")
def g02(spark, sf_dir):
    return G.levels(dag(spark, sf_dir))


@query("g03_cycle_check", f"""WITH RECURSIVE e AS {DAG}, c AS (SELECT dst, src FROM e UNION SELECT 9, 18), r AS (SELECT src AS root, dst AS node FROM c UNION SELECT r.root, c.dst FROM r JOIN c ON c.src = r.node),
       q AS (SELECT src AS root, dst AS node FROM e UNION SELECT q.root, e.dst FROM q JOIN e ON e.src = q.node)
       SELECT (SELECT bool_or(root = node) FROM q) AS acyclic_has, (SELECT bool_or(root = node) FROM r) AS closed_has""")
def g03(spark, sf_dir):
    """The task graph, and the same with an edge back from 18 to 9."""
    e = dag(spark, sf_dir)
    closed = e.union(e.selectExpr("9L AS dst", "18L AS src"))
    return spark.createDataFrame([(G.has_cycle(e), G.has_cycle(closed))], "acyclic_has boolean, closed_has boolean")


_EDGES = "(SELECT DISTINCT o_custkey AS src, 1000000000 + l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


@query("g04_components", f"""WITH RECURSIVE e AS {_EDGES}, b AS MATERIALIZED (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
       r(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM b UNION SELECT b.a, min(n.component) FROM r AS n JOIN b ON b.b = n.node JOIN recurring.r AS own ON own.node = b.a WHERE n.component < own.component GROUP BY b.a)
       SELECT node, component FROM r""")
def g04(spark, sf_dir):
    """Customers and the parts they bought, by who shares what."""
    e = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.expr("o_orderkey = l_orderkey")).selectExpr("o_custkey AS src", "1000000000 + l_partkey AS dst").distinct()
    return G.components(e)


@query("g05_downstream_closure", f"WITH RECURSIVE e AS {DAG}, r AS (SELECT src AS root, dst AS node, 1 AS depth FROM e UNION SELECT r.root, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node) SELECT root, count(DISTINCT node) AS downstream, max(depth)::INT AS depth, CASE WHEN count(DISTINCT node) >= 100 THEN 'HIGH' WHEN count(DISTINCT node) >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM r GROUP BY root")
def g05(spark, sf_dir):
    """Tasks below each task, the longest chain, and what a failure would cost."""
    n = F.count(F.lit(1))
    risk = F.when(n >= 100, "HIGH").when(n >= 10, "MEDIUM").otherwise("LOW")
    return G.closure(dag(spark, sf_dir)).groupBy("root").agg(n.alias("downstream"), F.max("depth").alias("depth"), risk.alias("risk"))


@query("g06_blast_radius", f"""WITH RECURSIVE e AS {DAG}, r AS (SELECT src AS root, dst AS node FROM e UNION SELECT r.root, e.dst FROM r JOIN e ON e.src = r.node),
       f AS (SELECT l_partkey AS task, count(*) FILTER (l_returnflag = 'R') AS fails FROM lineitem GROUP BY l_partkey)
       SELECT root, count(*) AS radius, sum(coalesce(v.fails, 0))::BIGINT AS victims, min(coalesce(o.fails, 0))::BIGINT AS own_fails FROM r LEFT JOIN f v ON v.task = node LEFT JOIN f o ON o.task = root GROUP BY root""")
def g06(spark, sf_dir):
    """What lies below each task, how often that failed in the past, and how often the task itself did (returned lines)."""
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("task")).agg(F.count_if(F.col("l_returnflag") == "R").alias("fails"))
    below = G.closure(dag(spark, sf_dir)).join(f.select(F.col("task").alias("node"), "fails"), "node", "left")
    out = below.groupBy("root").agg(F.count(F.lit(1)).alias("radius"), F.sum(F.coalesce("fails", F.lit(0))).alias("victims"))
    return out.join(f.select(F.col("task").alias("root"), F.col("fails").alias("own_fails")), "root", "left").fillna(0, ["own_fails"])


@query("g07_failure_cascade", f"WITH RECURSIVE e AS {DAG}, r AS (SELECT 5::BIGINT AS node UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node, CASE WHEN node = 5 THEN 'FAILED' ELSE 'UPSTREAM_FAILED' END AS status FROM r")
def g07(spark, sf_dir):
    r = G.reachable(dag(spark, sf_dir), spark.createDataFrame([(5,)], "node long"))
    return r.select("node", F.when(F.col("degree") == 0, "FAILED").otherwise("UPSTREAM_FAILED").alias("status"))


@query("g08_ready_tasks", f"WITH e AS {DAG} SELECT DISTINCT dst AS task FROM e WHERE dst % 7 <> 0 AND dst NOT IN (SELECT dst FROM e WHERE src % 7 <> 0)")
def g08(spark, sf_dir):
    """Tasks that are not done and whose dependencies all are; a task is done if 7 divides it."""
    e = dag(spark, sf_dir)
    open_ = e.filter("src % 7 <> 0").select("dst").distinct()
    return e.filter("dst % 7 <> 0").select("dst").distinct().join(open_, "dst", "left_anti").withColumnRenamed("dst", "task")


sql("g10_spec_diff", """WITH a AS (SELECT c_custkey AS k, c_mktsegment AS v FROM {customer} WHERE c_custkey % 3 > 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'X' ELSE c_mktsegment END AS v FROM {customer} WHERE c_custkey % 4 > 0)
       SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'REMOVED' WHEN a.k IS NULL THEN 'ADDED' ELSE 'CHANGED' END AS change FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v""")


@query("g11_semver", "SELECT p_partkey, 'v' || (p_partkey % 3) || '.' || (p_partkey % 5 + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END) || '.' || CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE p_partkey % 7 + 1 END AS next FROM part")
def g11(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.format_string("v%d.%d.%d", F.col("p_partkey") % 3, F.col("p_partkey") % 5, F.col("p_partkey") % 7).alias("tag"))
    bump = F.when(F.col("p_partkey") % 2 == 0, "MINOR").otherwise("PATCH")
    return p.select("p_partkey", scalar.bumped(scalar.semver(F.col("tag")), bump).alias("next"))


sql("g15_mermaid", "SELECT n_regionkey, array_join(array_sort(collect_list(concat('r', n_regionkey, ' --> n', n_nationkey))), '; ') AS lines FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(l, '; ' ORDER BY l) AS lines FROM (SELECT n_regionkey, 'r' || n_regionkey || ' --> n' || n_nationkey AS l FROM nation) GROUP BY n_regionkey")
sql("g17_hash_chunks", "SELECT pmod(CAST(conv(substr(md5(CAST(o_orderkey AS STRING)), 1, 8), 16, 10) AS BIGINT), 4) AS chunk, count(*) AS n FROM {orders} GROUP BY 1", "SELECT ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 4 AS chunk, count(*) AS n FROM orders GROUP BY 1")
@query("g11_bump_suggestion", """WITH a AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 10 > 0), b AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 9 > 0)
       SELECT CASE WHEN (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) > 0 THEN 'MAJOR' WHEN (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) > 0 THEN 'MINOR' ELSE 'PATCH' END AS bump""")
def g11b(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k")
    a, b = s.filter("k % 10 > 0").withColumn("a", F.lit(1)), s.filter("k % 9 > 0").withColumn("b", F.lit(1))
    change = F.when(F.col("b").isNull(), "REMOVED").when(F.col("a").isNull(), "ADDED")
    return G.semver_suggestion(a.join(b, "k", "full").select("k", change.alias("change")).filter("change IS NOT NULL"))


@query("g19_shortest_paths", f"""WITH RECURSIVE e AS {DAG}, w AS (SELECT src, dst, (dst % 10 + 1)::DOUBLE AS w FROM e),
       r(node, cost) USING KEY (node) AS (SELECT 1::BIGINT, 0::DOUBLE UNION SELECT w.dst, min(n.cost + w.w) FROM r AS n JOIN w ON w.src = n.node LEFT JOIN recurring.r AS own ON own.node = w.dst WHERE own.cost IS NULL OR n.cost + w.w < own.cost GROUP BY w.dst)
       SELECT node, cost FROM r""")
def g19s(spark, sf_dir):
    """Cheapest paths from the root, where an edge costs the last digit of its end and one."""
    e = dag(spark, sf_dir).withColumn("weight", F.col("dst") % 10 + 1)
    return G.shortest_paths(e, spark.createDataFrame([(1,)], "node long"))


sql("g21_influencers", "SELECT l_partkey, count(DISTINCT l_suppkey) AS in_degree FROM {lineitem} GROUP BY l_partkey ORDER BY in_degree DESC, l_partkey LIMIT 20")
sql("g22_recommendations", """WITH b AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey)
       SELECT y.p AS part, count(DISTINCT x.c) AS via FROM b m JOIN b x ON m.p = x.p AND x.c <> m.c JOIN b y ON y.c = x.c WHERE m.c = 7 AND y.p NOT IN (SELECT p FROM b WHERE c = 7) GROUP BY y.p""")
