"""Runs of task graphs, lineage, spatial and similarity queries that need more than one operator."""

from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import orchestration as O
from tessera.operators import spatial
from tessera.plans.graphs import DAG, dag
from tessera.plans.scalars import PLACE
from tessera.registry import query, sql
from tessera.tables import table


@query("g16_runner", f"""WITH RECURSIVE e AS {DAG}, t AS (SELECT src AS task FROM e UNION SELECT dst FROM e), l AS (SELECT task, 0 AS wave FROM t WHERE task NOT IN (SELECT dst FROM e) UNION SELECT e.dst, l.wave + 1 FROM l JOIN e ON e.src = l.task),
       w AS (SELECT task, max(wave) AS wave FROM l GROUP BY task), s AS (SELECT e.dst AS task FROM e WHERE e.src IN (7, 11) UNION SELECT e.dst FROM s JOIN e ON e.src = s.task)
       SELECT task, wave::INT AS wave, CASE WHEN task IN (SELECT task FROM s) THEN 'UPSTREAM_FAILED' WHEN task IN (7, 11) THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM w""")
def g16(spark, sf_dir):
    e = dag(spark, sf_dir).select(F.col("dst").alias("task"), F.col("src").alias("dep"))
    tasks = e.select("task").union(e.select("dep")).distinct()
    return O.simulate(tasks, e, spark.createDataFrame([(7,), (11,)], "task long"))


@query("u13_catch_up", """WITH d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-20', INTERVAL 1 DAY)) AS DATE) AS day), r AS (SELECT CAST(ts AS DATE) AS day, CASE WHEN day(min(ts)) = 16 THEN 'RUNNING' WHEN day(min(ts)) % 5 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM events WHERE day(ts) % 4 <> 1 GROUP BY 1)
       SELECT d.day, CASE WHEN d.day >= (SELECT min(day) FROM r WHERE status = 'RUNNING') THEN 'STOP' WHEN status = 'SUCCESS' THEN 'SKIP' WHEN status IS NULL THEN 'RUN' ELSE 'CLEAR_AND_RERUN' END AS action FROM d LEFT JOIN r ON r.day = d.day""")
def u13(spark, sf_dir):
    n = F.dayofmonth("day")
    runs = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct().filter(n % 4 != 1)
    return O.catch_up(runs.withColumn("status", F.when(n == 16, "RUNNING").when(n % 5 == 0, "FAILED").otherwise("SUCCESS")), "2024-01-01", "2024-01-20")


@query("u14_clear_runs", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 99)")
def u14(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return O.without_runs(e, e.filter("event_type = 'error' AND value > 99"), "user_id").select("event_id")


@query("u16_task_dimension", f"WITH e AS {DAG}, t AS (SELECT src AS task FROM e UNION SELECT dst FROM e) SELECT task, (SELECT count(*) FROM e WHERE dst = task) AS dependency_count, task NOT IN (SELECT dst FROM e) AS is_root, task NOT IN (SELECT src FROM e) AS is_leaf FROM t")
def u16(spark, sf_dir):
    e = dag(spark, sf_dir).select(F.col("dst").alias("task"), F.col("src").alias("dep"))
    return O.task_dimension(e.select("task").union(e.select("dep")), e)


#: Procedure texts made from all parts: what each reads and writes depends on its row.
_BODY = "concat('DELETE FROM tmp_', p_size, '; INSERT INTO ', CASE WHEN p_size % 3 = 0 THEN 'gold_' WHEN p_size % 3 = 1 THEN 'Silver_' ELSE 'out_' END, p_size % 7, ' SELECT * FROM ', CASE WHEN p_size % 2 = 0 THEN 'bronze_' ELSE 'silver_' END, p_size % 5, ' s JOIN dim_', p_size % 4, ' d ON s.k = d.k', CASE WHEN p_size % 5 = 0 THEN '; MERGE INTO gold_total USING x ON 1 = 1; UPDATE audit_log SET n = 1' ELSE '' END)"


@query("g14_table_lineage", f"""WITH b AS (SELECT p_partkey, {_BODY} AS body FROM part),
       o AS (SELECT p_partkey, 'WRITE' AS mode, unnest(regexp_extract_all(body, '(?i)(?:insert\\s+into|update|merge\\s+into|delete\\s+from)\\s+([a-z_][a-z_0-9.]*)', 1)) AS object FROM b
             UNION ALL SELECT p_partkey, 'READ', unnest(regexp_extract_all(regexp_replace(body, '(?i)delete\\s+from\\s', 'delete ', 'g'), '(?i)(?:from|join)\\s+([a-z_][a-z_0-9.]*)', 1)) FROM b)
       SELECT DISTINCT p_partkey, mode, lower(object) AS object, CASE WHEN lower(object) LIKE '%gold%' THEN 'gold' WHEN lower(object) LIKE '%silver%' THEN 'silver' WHEN lower(object) LIKE '%bronze%' THEN 'bronze' END AS layer FROM o""")
def g14(spark, sf_dir):
    return O.lineage(table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_BODY} AS body"), "p_partkey", "body")


sql("u17_execution_fact",
    """WITH x AS (SELECT event_id, event_type AS task, user_id AS run_id, CAST(ts AS DATE) AS run_date, value AS ms, event_id % 11 = 0 AS failed FROM {events})
       SELECT event_id, task, round(ms, 4) AS ms, ms > 90 AS had_retry,
              failed AND coalesce(max(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, run_date ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS victim FROM x""")
sql("u19_dependency_edges", "SELECT doc_id AS task, explode(array(doc_id - 1, doc_id - 2)) AS dep FROM {documents} WHERE doc_id >= 2", "SELECT doc_id AS task, unnest([doc_id - 1, doc_id - 2]) AS dep FROM documents WHERE doc_id >= 2")
sql("u21_derived_fines", "SELECT l_orderkey, l_linenumber, datediff(CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE)) * 0.5 AS fine FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE datediff(CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE)) > 90",
    "SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) * 0.5 AS fine FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE date_diff('day', o_orderdate::DATE, l_shipdate::DATE) > 90")
sql("u11_monthly_scores", """WITH d AS (SELECT event_type AS k, CAST(date_trunc('month', ts) AS DATE) AS month, CAST(ts AS DATE) AS d, avg(value) AS s FROM {events} WHERE day(ts) % 3 <> 0 GROUP BY 1, 2, 3) SELECT k, month, count(*) AS scored, round(min(s), 6) AS lowest, round(avg(s), 6) AS mean FROM d GROUP BY k, month""")
sql("u10_health_bitmaps", """WITH d AS (SELECT event_type AS k, CAST(ts AS DATE) AS d, count_if(event_id % 11 = 0) = 0 AS ok FROM {events} GROUP BY 1, 2) SELECT k, CAST(sum(CASE WHEN ok THEN shiftleft(1L, 31 - datediff(DATE '2024-01-30', d)) ELSE 0 END) AS BIGINT) AS bitmap FROM d GROUP BY k""",
    """WITH d AS (SELECT event_type AS k, CAST(ts AS DATE) AS d, count(*) FILTER (event_id % 11 = 0) = 0 AS ok FROM events GROUP BY 1, 2) SELECT k, sum(CASE WHEN ok THEN 1::BIGINT << (31 - date_diff('day', d, DATE '2024-01-30')) ELSE 0 END)::BIGINT AS bitmap FROM d GROUP BY k""")
sql("g09_version_tree", "WITH RECURSIVE t(v, generation, label) AS (SELECT CAST(1 AS BIGINT), 0, CAST('v1' AS STRING) UNION ALL SELECT p_partkey, generation + 1, concat(repeat('  ', generation + 1), 'v', p_partkey) FROM t JOIN {part} ON p_partkey div 3 = v) SELECT v, generation, label FROM t",
    "WITH RECURSIVE t(v, generation, label) AS (SELECT 1::BIGINT, 0, 'v1' UNION ALL SELECT p_partkey, generation + 1, repeat('  ', generation + 1) || 'v' || p_partkey FROM t JOIN part ON p_partkey // 3 = v) SELECT v, generation, label FROM t")


@query("g19_metric_graph", f"""SELECT a, b, round(d, 3) AS metres FROM (SELECT a.k AS a, b.k AS b, 2 * 6371000 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS d FROM {PLACE.format(t='supplier')} a JOIN {PLACE.format(t='supplier')} b ON a.k < b.k) WHERE d <= 1500000""")
def g19(spark, sf_dir):
    """Edges of the metric graph up to 1,500 km. In a metric graph the direct edge is the shortest path."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), ((F.col("s_suppkey") * 37 % 120 - 60) * 1.0).alias("lat"), ((F.col("s_suppkey") * 91 % 340 - 170) * 1.0).alias("lon"))
    return spatial.near_pairs(s, s, 1_500_000.0).filter("k < k2").select(F.col("k").alias("a"), F.col("k2").alias("b"), F.round("distance", 3).alias("metres"))


@query("d27_geofence_deterministic", f"SELECT k, round(2 * 6371000 * asin(sqrt(pow(sin(radians(lat) / 2), 2) + cos(radians(lat)) * pow(sin(radians(lon) / 2), 2))), 3) <= 5000000 AS inside FROM {PLACE.format(t='supplier')}")
def d27(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), ((F.col("s_suppkey") * 37 % 120 - 60) * 1.0).alias("lat"), ((F.col("s_suppkey") * 91 % 340 - 170) * 1.0).alias("lon"))
    return s.select("k", (F.round(scalar.haversine(F.lit(0.0), F.lit(0.0), F.col("lat"), F.col("lon")), 3) <= 5_000_000).alias("inside"))


@query("d27_geofence_probability", """WITH s AS (SELECT s_suppkey AS k, pow((s_suppkey % 600) / sqrt(pow(20 + s_suppkey % 80, 2) + 225), 2) / 2 AS l, pow(300 / sqrt(pow(20 + s_suppkey % 80, 2) + 225), 2) / 2 AS v FROM supplier),
       t AS (SELECT k, j, exp(-l + j * ln(greatest(l, 1e-300)) - lgamma(j + 1)) AS w, sum(exp(-v + j * ln(v) - lgamma(j + 1))) OVER (PARTITION BY k ORDER BY j ROWS UNBOUNDED PRECEDING) AS tail FROM s CROSS JOIN (SELECT range AS j FROM range(400)))
       SELECT k, round(least(1, greatest(0, sum(w * (1 - tail)))), 6) AS p FROM t GROUP BY k""")
def d27p(spark, sf_dir):
    """Chance that a place with an error is within 300 m of a fence's centre, by the Rice distribution."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 600).cast("double").alias("d"), (20 + F.col("s_suppkey") % 80).cast("double").alias("s"), F.lit(15.0).alias("t"))
    return spatial.within_probability(s, "d", "s", "t", 300.0).select("k", F.round("p", 6).alias("p"))


@query("d34_region_probability", """WITH a AS (SELECT (range + 0.5) / 200 * 0.1 - 0.05 AS v FROM range(200)), g AS (SELECT x.v AS lat, y.v AS lon FROM a x CROSS JOIN a y), d AS (SELECT cos(radians(lat)) AS w, 2 * 6371000 * asin(sqrt(pow(sin(radians(lat) / 2), 2) + cos(radians(lat)) * pow(sin(radians(lon) / 2), 2))) AS d FROM g)
       SELECT sum(exp(-pow(d / 1000.0, 2) / 2) * w) FILTER (d <= 1500) / sum(exp(-pow(d / 1000.0, 2) / 2) * w) AS probability FROM d""")
def d34(spark, sf_dir):
    """Mass of a normal density in a disc, on a grid."""
    g = spatial.grid(spark, -0.05, 0.05, -0.05, 0.05, 200)
    d = scalar.haversine(F.lit(0.0), F.lit(0.0), F.col("lat"), F.col("lon"))
    return spatial.region_probability(g, F.exp(-F.pow(d / 1000.0, F.lit(2)) / 2), d <= 1500)


sql("d31_region_distances", """WITH p AS (SELECT DISTINCT s_nationkey AS r, CAST(s_suppkey * 37 % 120 AS DOUBLE) AS x, CAST(s_suppkey * 91 % 340 AS DOUBLE) AS y FROM {supplier}), d AS (SELECT a.r AS a, b.r AS b, a.x AS ax, a.y AS ay, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS near FROM p a JOIN p b ON a.r <> b.r GROUP BY a.r, b.r, a.x, a.y)
       SELECT a, b, round(min(near), 6) AS boundary, round(max(near), 6) AS hausdorff FROM d GROUP BY a, b""")
sql("d38_representatives", """WITH e AS (SELECT vec_id, label, posexplode(embedding) AS (i, x) FROM {embeddings}), c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY label, i), s AS (SELECT vec_id, e.label, sum(x * m) / sqrt(sum(m * m)) / sqrt(sum(CAST(x AS DOUBLE) * x)) AS cos FROM e JOIN c ON c.label = e.label AND c.i = e.i GROUP BY vec_id, e.label)
       SELECT label, vec_id, round(cos, 5) AS cos FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(cos, 7) DESC, vec_id) AS r FROM s) WHERE r <= 3""",
    """WITH e AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i), s AS (SELECT vec_id, e.label, sum(x * m) / sqrt(sum(m * m)) / sqrt(sum(x * x)) AS cos FROM e JOIN c ON c.label = e.label AND c.i = e.i GROUP BY vec_id, e.label)
       SELECT label, vec_id, round(cos, 5) AS cos FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(cos, 7) DESC, vec_id) AS r FROM s) WHERE r <= 3""")
sql("f22_keyword_overlap", """WITH w AS (SELECT conv_id, turn, array_distinct(filter(split(lower(text), ' '), x -> length(x) > 3)) AS k FROM {conversations}), p AS (SELECT conv_id, turn, k, lag(k) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM w)
       SELECT conv_id, turn, round(least(1, CASE WHEN size(k) <= 3 THEN size(array_intersect(k, b)) * 1.0 / size(k) ELSE size(array_intersect(k, b)) / (0.4 * size(k)) END), 6) AS overlap FROM p WHERE b IS NOT NULL AND size(k) > 0""",
    """WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: length(x) > 3)) AS k FROM conversations), p AS (SELECT conv_id, turn, k, lag(k) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM w)
       SELECT conv_id, turn, round(least(1, CASE WHEN len(k) <= 3 THEN len(list_intersect(k, b)) * 1.0 / len(k) ELSE len(list_intersect(k, b)) / (0.4 * len(k)) END), 6) AS overlap FROM p WHERE b IS NOT NULL AND len(k) > 0""")
# Names are types, of which there are few whatever the number of parts: equal ones are compared once.
sql("f23_name_similarity", """WITH w AS (SELECT p_brand, p_type, count(*) AS parts, array_distinct(split(lower(p_type), ' ')) AS k FROM {part} GROUP BY p_brand, p_type)
       SELECT a.p_brand AS brand, a.p_type AS a, b.p_type AS b, a.parts * b.parts AS pairs, round(size(array_intersect(a.k, b.k)) * 1.0 / least(size(a.k), size(b.k)), 6) AS sim, size(array_intersect(a.k, b.k)) * 1.0 / greatest(size(a.k), size(b.k)) > 0.8 AS dup FROM w a JOIN w b ON a.p_brand = b.p_brand AND a.p_type < b.p_type""",
    """WITH w AS (SELECT p_brand, p_type, count(*) AS parts, list_distinct(string_split(lower(p_type), ' ')) AS k FROM part GROUP BY p_brand, p_type)
       SELECT a.p_brand AS brand, a.p_type AS a, b.p_type AS b, a.parts * b.parts AS pairs, round(len(list_intersect(a.k, b.k)) * 1.0 / least(len(a.k), len(b.k)), 6) AS sim, len(list_intersect(a.k, b.k)) * 1.0 / greatest(len(a.k), len(b.k)) > 0.8 AS dup FROM w a JOIN w b ON a.p_brand = b.p_brand AND a.p_type < b.p_type""")
# Categories are sources, texts their documents; similarity is the share of a text's words that its category's first one has too. Weights as for
# texts without a second model: 0.35 model, 0.25 similarity, 0.2 keywords, 0.1 maturity, 0.1 pass.
_CONFIDENCE = """WITH w AS (SELECT doc_id, source, {words} AS k FROM {documents}), n AS (SELECT source, count(*) AS n, min(doc_id) AS first FROM {documents} GROUP BY source), c AS (SELECT count(*) AS total FROM n),
            f AS (SELECT w.source, w.k FROM w JOIN n ON w.doc_id = n.first), s AS (SELECT doc_id, w.source, n.n, total, least(1e0, {size}(w.k) / 1e3) AS model, {size}({both}(w.k, f.k)) * 1e0 / greatest({size}(w.k), 1) AS sim, doc_id % 4 AS pass FROM w JOIN n ON n.source = w.source JOIN f ON f.source = w.source CROSS JOIN c)
       SELECT doc_id, round(3.5e-1 * model + 2.5e-1 * sim + 2e-1 * sim + 1e-1 * CASE WHEN total <= 1 THEN 1e0 WHEN n = 0 THEN 6e-1 WHEN n = 1 THEN 7e-1 WHEN n <= 3 THEN 8e-1 WHEN n <= 5 THEN 9e-1 ELSE 9.5e-1 END + 1e-1 * (5e-1 + 5e-1 * pass / 4e0), 9) AS confidence FROM s"""
sql("f24_confidence", _CONFIDENCE.replace("{words}", "array_distinct(split(lower(coalesce(text, '')), ' '))").replace("{size}", "size").replace("{both}", "array_intersect"),
    _CONFIDENCE.format(words="list_distinct(string_split(lower(coalesce(text, '')), ' '))", size="len", both="list_intersect", documents="documents"))
sql("f33_plane_metrics", "SELECT s_suppkey, round(sqrt(pow(s_acctbal, 2) + pow(s_nationkey, 2)), 4) AS euclid, round(abs(s_acctbal) + s_nationkey, 4) AS manhattan FROM {supplier}")
sql("f37_unit_exponents", "SELECT k, aggregate(transform(regexp_extract_all(u, 'm([-0-9]+)', 1), x -> CAST(x AS INT)), 0, (a, b) -> a + b) AS metres FROM (SELECT n_nationkey AS k, concat('kg1 m', n_nationkey % 4, ' s-2 m1') AS u FROM {nation})",
    "SELECT k, list_sum(list_transform(regexp_extract_all(u, 'm([-0-9]+)', 1), lambda x: x::INT))::INT AS metres FROM (SELECT n_nationkey AS k, 'kg1 m' || (n_nationkey % 4) || ' s-2 m1' AS u FROM nation)")
sql("f45_escape_velocity", "SELECT s_suppkey, round(sqrt(2 * 6.674e-11 * 5.972e24 / (6371000 + s_suppkey * 1000)), 4) AS v FROM {supplier}")
sql("l09_top_embedding_candidates", """WITH q AS (SELECT vec_id AS a, label, posexplode(embedding) AS (i, x) FROM {embeddings} WHERE vec_id % 100 = 0), e AS (SELECT vec_id AS b, label, posexplode(embedding) AS (i, y) FROM {embeddings}), s AS (SELECT a, b, sum(CAST(x AS DOUBLE) * y) AS cos FROM q JOIN e ON q.label = e.label AND q.i = e.i AND a <> b GROUP BY a, b)
       SELECT a, b, round(cos, 5) AS cos FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(cos, 7) DESC, b) AS r FROM s) WHERE r <= 5""",
    """WITH e AS (SELECT vec_id AS b, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS y FROM embeddings), s AS (SELECT q.b AS a, e.b, sum(q.y * e.y) AS cos FROM e q JOIN e ON q.label = e.label AND q.i = e.i AND q.b <> e.b WHERE q.b % 100 = 0 GROUP BY q.b, e.b)
       SELECT a, b, round(cos, 5) AS cos FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(cos, 7) DESC, b) AS r FROM s) WHERE r <= 5""")
sql("d45_consolidation_thresholds", """WITH p AS (SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) * 1.0 / greatest(length(a.n_name), length(b.n_name)) AS d FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name)
       SELECT round(least(0.7, greatest(0.25, percentile_cont(0.5) WITHIN GROUP (ORDER BY d) + 0.3 * (percentile_cont(0.75) WITHIN GROUP (ORDER BY d) - percentile_cont(0.5) WITHIN GROUP (ORDER BY d)))), 6) AS threshold, count(*) AS pairs FROM p""")
