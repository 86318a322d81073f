"""Fields, formulas and decisions: spatial analysis on grids, geometry, mechanics, clustering decisions, specs and arrays."""

from pyspark.sql import functions as F

from tessera.operators import optimise
from tessera.operators import text as X
from tessera.registry import query, sql
from tessera.tables import table

# Value of a day, read at its place in the user's monthly array, by the state that held on that day.
_MODAL = """day AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type, count(*) AS n FROM {events} GROUP BY 1, 2, 3), modal AS (SELECT user_id, d, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, d ORDER BY n DESC, event_type) AS r FROM day) WHERE r = 1),
       dim AS (SELECT user_id, event_type, d AS valid_from, lead(d) OVER (PARTITION BY user_id ORDER BY d) AS until FROM modal)"""
sql("j08_monthly_array_at_day", f"""WITH {_MODAL}, s AS (SELECT user_id, day(ts) AS i, sum(value) AS v FROM {{events}} GROUP BY 1, 2), m AS (SELECT user_id, map_from_entries(collect_list(struct(i, v))) AS p FROM s GROUP BY user_id), a AS (SELECT user_id, transform(sequence(1, 31), i -> coalesce(p[i], 0D)) AS daily FROM m)
       SELECT event_type AS state, round(sum(daily[14]), 4) AS revenue, count(*) AS users FROM a JOIN dim ON dim.user_id = a.user_id AND valid_from <= DATE '2024-01-15' AND (until > DATE '2024-01-15' OR until IS NULL) GROUP BY event_type""",
    f"""WITH {_MODAL.format(events='events')}, s AS (SELECT user_id, day(ts) AS i, sum(value) AS v FROM events GROUP BY 1, 2)
       SELECT event_type AS state, round(sum(coalesce(v, 0)), 4) AS revenue, count(*) AS users FROM dim LEFT JOIN s ON s.user_id = dim.user_id AND i = 15 WHERE valid_from <= DATE '2024-01-15' AND (until > DATE '2024-01-15' OR until IS NULL) GROUP BY event_type""")
sql("j15_graph_recommendation", """WITH v AS (SELECT c_custkey AS id, 'person' AS kind, c_name AS name FROM {customer} UNION ALL SELECT 1000000000 + p_partkey, 'part', p_name FROM {part}),
            e AS (SELECT c_custkey AS src, 1 + c_custkey * 7 % 97 AS dst, 'follows' AS kind FROM {customer} UNION ALL SELECT c_custkey, 1 + c_custkey * 11 % 89, 'follows' FROM {customer} UNION ALL SELECT DISTINCT o_custkey, 1000000000 + l_partkey, 'recommends' FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey)
       SELECT DISTINCT p.name AS part, w.name AS recommended_by FROM e a JOIN v f ON a.dst = f.id JOIN e r ON f.id = r.src JOIN v p ON r.dst = p.id JOIN v w ON r.src = w.id WHERE a.src = 1 AND a.kind = 'follows' AND r.kind = 'recommends' AND p.kind = 'part'""")
sql("j17_array_membership_join", """WITH r AS (SELECT user_id, collect_set(event_type) AS sets FROM {events} GROUP BY user_id, CAST(ts AS DATE)), x AS (SELECT user_id, explode(sets) AS set_key FROM r), k AS (SELECT event_type AS set_key, count(*) AS size FROM {events} GROUP BY event_type)
       SELECT k.set_key, size, count(*) AS regions, count(DISTINCT user_id) AS users FROM x JOIN k ON k.set_key = x.set_key GROUP BY k.set_key, size""",
    """WITH r AS (SELECT user_id, list(DISTINCT event_type) AS sets FROM events GROUP BY user_id, CAST(ts AS DATE)), k AS (SELECT event_type AS set_key, count(*) AS size FROM events GROUP BY event_type)
       SELECT k.set_key, size, count(*) AS regions, count(DISTINCT user_id) AS users FROM r JOIN k ON list_contains(r.sets, k.set_key) GROUP BY k.set_key, size""")
sql("p15_allowed_types", """WITH x AS (SELECT p_partkey, split(concat_ws('|', p_name, p_size, p_retailprice, CASE WHEN p_partkey % 5 = 0 THEN 'null' END), '[|]') AS v FROM {part}), t AS (SELECT p_partkey, transform(v, e -> CASE WHEN try_cast(e AS INT) IS NOT NULL AND e NOT LIKE '%.%' THEN 'int' WHEN try_cast(e AS DOUBLE) IS NOT NULL THEN 'float' WHEN e = 'null' THEN 'none' ELSE 'str' END) AS kinds FROM x)
       SELECT p_partkey, array_join(kinds, ',') AS kinds, forall(kinds, k -> k IN ('int', 'float', 'str')) AS allowed FROM t""",
    """WITH x AS (SELECT p_partkey, string_split(concat_ws('|', p_name, p_size, p_retailprice, CASE WHEN p_partkey % 5 = 0 THEN 'null' END), '|') AS v FROM part), t AS (SELECT p_partkey, list_transform(v, lambda e: CASE WHEN try_cast(e AS INT) IS NOT NULL AND e NOT LIKE '%.%' THEN 'int' WHEN try_cast(e AS DOUBLE) IS NOT NULL THEN 'float' WHEN e = 'null' THEN 'none' ELSE 'str' END) AS kinds FROM x)
       SELECT p_partkey, array_to_string(kinds, ',') AS kinds, NOT list_contains(kinds, 'none') AS allowed FROM t""")
# The bitmap moves by one bit when the month changes, and its top bit is set when there is activity: in closed form, a bit for each active month.
sql("f05_month_bitmap", """WITH m AS (SELECT DISTINCT o_custkey, (2001 - year(o_orderdate)) * 12 + 8 - month(o_orderdate) AS ago FROM {orders})
       SELECT o_custkey, CAST(sum(shiftright(2147483648L, CAST(ago AS INT))) AS BIGINT) AS bitmap FROM m WHERE ago BETWEEN 0 AND 31 GROUP BY o_custkey""",
    """WITH m AS (SELECT DISTINCT o_custkey, (2001 - year(o_orderdate)) * 12 + 8 - month(o_orderdate) AS ago FROM orders)
       SELECT o_custkey, sum(2147483648::BIGINT >> ago::INT)::BIGINT AS bitmap FROM m WHERE ago BETWEEN 0 AND 31 GROUP BY o_custkey""")
_P = "(SELECT s_suppkey AS k, CAST(s_suppkey * 37 % 120 - 60 AS DOUBLE) AS lat, CAST(s_suppkey * 91 % 340 - 170 AS DOUBLE) AS lon FROM {supplier})"
sql("f29_weighted_distance", f"""WITH p AS {_P}, d AS (SELECT k, 2 * 6371000 * asin(sqrt(pow(sin(radians(lat - 10) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * pow(sin(radians(lon - 20) / 2), 2))) AS metres, (lat + 10) / 2 AS mid FROM p)
       SELECT k, round(metres * CASE WHEN abs(mid) < 15 THEN 1 WHEN abs(mid) < 30 THEN 1.5e0 ELSE 2 END, 3) AS cost, round(metres / 1000, 6) AS custom FROM d""")
# Gravity between two bodies, three Verlet steps of a fall, a circular orbit, and drag with spin on a ball, from the parts' sizes and prices.
sql("f41_mechanics", """WITH s AS (SELECT p_partkey, p_size * 1e3 AS m, p_retailprice AS r, p_size / 1e1 AS v FROM {part}), x AS (SELECT *, 2 * r - (r - v) - 6.674e-11 * m / (r * r) AS x1 FROM s), y AS (SELECT *, 2 * x1 - r - 6.674e-11 * m / (x1 * x1) AS x2 FROM x)
       SELECT p_partkey, round(6.674e-11 * m / (r * r) * 1e12, 6) AS gravity, round(x2, 6) AS verlet, round(sqrt(6.674e-11 * m / r) * 1e6, 6) AS orbit, round(-5e-1 * 1.225e0 * 4.7e-1 * 3.8e-2 * v * abs(v), 6) AS drag, round(5e-1 * 1.225e0 * 3.8e-2 * 1.1e-1 * v * 9, 6) AS magnus FROM y""")
# The sphere's metric, its Christoffel symbols, and one step of a geodesic by the midpoint rule.
sql("f44_sphere_geodesics", f"""WITH p AS (SELECT k, radians(90 - lat) AS t, radians(lon) AS f FROM {_P}), a AS (SELECT *, pow(sin(t), 2) AS gff, -sin(t) * cos(t) AS gt_ff, cos(t) / nullif(sin(t), 0) AS gf_tf FROM p)
       SELECT k, round(gff, 9) AS g_ff, round(gt_ff, 9) AS c_t_ff, round(gf_tf, 9) AS c_f_tf, round(t + 1e-2 * (1 - 5e-3 * gt_ff), 9) AS next_t, round(f + 1e-2 * (1 - 5e-3 * 2 * gf_tf), 9) AS next_f FROM a""")
# A new spec against the stored one: what goes, comes, changes or stays, and whether all its dependencies exist.
_SPEC = """WITH old AS (SELECT p_partkey AS task, p_partkey {div} 2 AS dep, p_size AS retries FROM {part} WHERE p_partkey % 10 > 0), spec AS (SELECT p_partkey AS task, CASE WHEN p_partkey % 6 = 0 THEN p_partkey {div} 3 ELSE p_partkey {div} 2 END AS dep, CASE WHEN p_partkey % 7 = 0 THEN 9 ELSE p_size END AS retries FROM {part} WHERE p_partkey % 9 > 0)
       SELECT coalesce(s.task, o.task) AS task, CASE WHEN s.task IS NULL THEN 'DELETED' WHEN o.task IS NULL THEN 'INSERTED' WHEN s.dep <> o.dep THEN 'DEPENDENCY_CHANGED' WHEN s.retries <> o.retries THEN 'UPDATED' ELSE 'UNCHANGED' END AS action, s.task IS NOT NULL AND s.dep > 0 AND d.task IS NULL AS missing_dependency
       FROM spec s FULL OUTER JOIN old o ON s.task = o.task LEFT JOIN spec d ON d.task = s.dep"""
sql("g23_spec_load", _SPEC.replace("{div}", "div"), _SPEC.format(div="//", part="part"))
# Two discs on a grid of 1/50: membership, subset, intersection, fraction of overlap, proximity.
_GRID = "g AS (SELECT a.{id} / 5e1 - 2 AS x, b.{id} / 5e1 - 2 AS y FROM range(201) a CROSS JOIN range(201) b), d AS (SELECT n_nationkey AS k, n_nationkey / 1e1 AS cx, 5e-1 + n_nationkey / 5e1 AS r FROM {nation})"
_OVERLAP = """, m AS (SELECT k, pow(x - cx, 2) + y * y <= r * r AS ina, x * x + y * y <= 1 AS inb, cx, r FROM g CROSS JOIN d)
       SELECT k, count(*) FILTER (WHERE ina) AS cells, count(*) FILTER (WHERE ina AND inb) AS shared, round(count(*) FILTER (WHERE ina AND inb) * 1e0 / nullif(count(*) FILTER (WHERE ina), 0), 6) AS overlap, bool_and(inb OR NOT ina) AS subset, round(greatest(0, max(cx) - max(r) - 1), 6) AS gap FROM m GROUP BY k"""
sql("d30_region_relations", "WITH " + _GRID.replace("{id}", "id") + _OVERLAP, "WITH " + _GRID.format(id="range", nation="nation") + _OVERLAP)
# The cheapest strategy that can answer a spatial query: rules in order, as a table.
sql("d29_query_router", """WITH q AS (SELECT p_partkey AS k, p_size % 3 AS uncertain, p_size % 5 AS shape, p_retailprice AS tolerance, p_size % 7 = 0 AS broken FROM {part}), v AS (SELECT *, CASE WHEN broken THEN 'missing field' WHEN tolerance <= 0 THEN 'tolerance' WHEN shape = 4 AND uncertain = 2 THEN 'unsupported pair' END AS invalid FROM q)
       SELECT k, coalesce(invalid, 'ok') AS verdict, CASE WHEN invalid IS NOT NULL THEN 'none' WHEN uncertain = 0 THEN 'analytic' WHEN uncertain = 1 AND shape <= 1 THEN 'closed form' WHEN shape <= 3 AND tolerance > 1000 THEN 'grid' WHEN shape <= 3 THEN 'convolution' ELSE 'monte carlo' END AS strategy FROM v""")
# Proximity marginalised over an uncertain radius: five radii with normal weights, each by the Rayleigh tail.
sql("d33_marginal_proximity", """WITH w AS (SELECT * FROM (VALUES (-2, 5.4e-2), (-1, 2.42e-1), (0, 3.99e-1), (1, 2.42e-1), (2, 5.4e-2)) AS t(z, w)), s AS (SELECT s_suppkey AS k, 50 + s_suppkey % 100 AS sigma FROM {supplier})
       SELECT k, round(sum(w * (1 - exp(-pow(200 + 30 * z, 2) / (2 * sigma * sigma)))) / sum(w), 9) AS p FROM s CROSS JOIN w GROUP BY k""")
# A daily field smoothed with the kernel 1-2-1: directly, as a join on the distance, and the integral before and after.
sql("d35_convolution", """WITH f AS (SELECT event_type, day(ts) AS i, CAST(count(*) AS DOUBLE) AS y FROM {events} GROUP BY 1, 2), k AS (SELECT * FROM (VALUES (-1, 2.5e-1), (0, 5e-1), (1, 2.5e-1)) AS t(o, w)), c AS (SELECT event_type, i + o AS i, sum(y * w) AS y FROM f CROSS JOIN k GROUP BY 1, 2)
       SELECT event_type, i, round(y, 6) AS smooth, round(sum(y) OVER (PARTITION BY event_type), 6) AS mass FROM c""")
sql("d36_field_comparison", """WITH f AS (SELECT day(ts) AS i, user_id % 10 AS j, avg(CASE WHEN event_type IN ('view', 'click') THEN value END) AS a, avg(CASE WHEN event_type NOT IN ('view', 'click') THEN value END) AS b FROM {events} GROUP BY 1, 2)
       SELECT j, round(avg(abs(a - b)), 6) AS l1, round(sqrt(avg(pow(a - b, 2))), 6) AS l2, round(max(abs(a - b)), 6) AS top, round(corr(a, b), 6) AS r, round(regr_slope(a, b), 6) AS sensitivity FROM f GROUP BY j""")
sql("d49_recommended_config", """WITH s AS (SELECT lang, count(*) AS n, avg(length(text)) AS mean, count(DISTINCT source) AS sources, stddev_samp(length(text)) / avg(length(text)) AS spread FROM {documents} GROUP BY lang)
       SELECT lang, n, CASE WHEN n < 50 THEN 'tiny' WHEN n < 500 THEN 'small' WHEN n < 5000 THEN 'medium' ELSE 'large' END AS size_class, CASE WHEN mean < 200 THEN 50 WHEN mean < 2000 THEN 20 ELSE 5 END AS batch, least(5, 2 + CAST(spread > 1 AS INT) + CAST(sources > 10 AS INT)) AS passes, CASE WHEN spread > 1 THEN 'chunked' ELSE 'whole' END AS mode FROM s""")
sql("d63_inter_arrival", """WITH g AS (SELECT event_type AS app, {gap} AS gap FROM {events}) SELECT app, count(*) AS n, round(avg(gap), 4) AS mean, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY gap), 4) AS p50, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY gap), 4) AS p95, count(*) FILTER (WHERE gap < 60) AS under_a_minute FROM g WHERE gap IS NOT NULL GROUP BY app""".replace("{gap}", "(unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(CAST(lag(ts) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS TIMESTAMP))) / 1e6"),
    """WITH g AS (SELECT event_type AS app, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id))) / 1e6 AS gap FROM events) SELECT app, count(*) AS n, round(avg(gap), 4) AS mean, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY gap), 4) AS p50, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY gap), 4) AS p95, count(*) FILTER (WHERE gap < 60) AS under_a_minute FROM g WHERE gap IS NOT NULL GROUP BY app""")
# Versions sorted as text, so v10 comes before v9: not the order of semantic versions.
sql("d64_latest_versions", """WITH v AS (SELECT p_brand AS workflow, concat('v', p_size, '.', p_partkey % 3) AS version FROM {part}) SELECT workflow, max(version) AS latest, count(DISTINCT version) AS versions FROM v GROUP BY workflow""")
sql("a16_corr_with_run_total", """WITH d AS (SELECT user_id AS run, event_type AS k, sum(value) AS v FROM {events} GROUP BY 1, 2), t AS (SELECT run, sum(v) AS total FROM d GROUP BY run) SELECT k, count(*) AS n, round(corr(v, total), 6) AS r FROM d JOIN t ON t.run = d.run GROUP BY k HAVING count(*) >= 5""")
sql("u05_upsert_counts", """WITH s AS (SELECT DISTINCT o_custkey AS k FROM {orders}) SELECT CASE WHEN c_custkey IS NULL THEN 'insert' WHEN k IS NULL THEN 'keep' ELSE 'update' END AS action, count(*) AS n FROM s FULL OUTER JOIN {customer} ON k = c_custkey GROUP BY 1""")
sql("u14_refused_clears", """WITH r AS (SELECT user_id AS run_id, max_by(event_type, event_id) AS last FROM {events} GROUP BY user_id) SELECT run_id, CASE WHEN last = 'view' THEN 'REFUSED_RUNNING' ELSE 'CLEARED' END AS result FROM r""", """WITH r AS (SELECT user_id AS run_id, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id) SELECT run_id, CASE WHEN last = 'view' THEN 'REFUSED_RUNNING' ELSE 'CLEARED' END AS result FROM r""")
sql("g17_time_chunks", """SELECT floor(datediff(CAST(o_orderdate AS DATE), DATE '1995-01-01') / 90) AS chunk, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day, count(*) AS n FROM {orders} GROUP BY 1""", """SELECT floor(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 90)::BIGINT AS chunk, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day, count(*) AS n FROM orders GROUP BY 1""")
sql("f38_growth_rates", """SELECT c_custkey, round(pow((c_acctbal + 20000) / 10000, 1 / 5e0) - 1, 9) AS cagr, round(c_acctbal + 20000 - 10000, 4) AS profit, round(100 * (pow(1 + 5e-3, 36) - 1) / 5e-3, 6) AS future_value FROM {customer}""")
sql("f36_polygons", """WITH p AS (SELECT n_nationkey AS k, n_nationkey % 6 + 2e0 AS w, n_nationkey % 4 + 1e0 AS h FROM {nation}), q AS (SELECT s_suppkey AS i, s_nationkey AS k, s_suppkey % 9 * 1e0 AS x, s_suppkey % 7 * 1e0 AS y FROM {supplier})
       SELECT i, round(w * h / 2, 6) AS area, round(w / 3, 6) AS cx, round(h / 3, 6) AS cy, x >= 0 AND y >= 0 AND x / w + y / h <= 1 AS inside FROM q JOIN p ON p.k = q.k""")


@query("d40_online_assignment", """WITH e AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e WHERE vec_id % 2 = 0 GROUP BY label, i),
            s AS (SELECT vec_id, c.label, sum(x * m) / sqrt(sum(m * m)) / sqrt(sum(x * x)) AS cos FROM e JOIN c ON c.i = e.i GROUP BY vec_id, c.label)
       SELECT vec_id, CASE WHEN cos >= 0.2 THEN label END AS cluster, round(cos, 5) AS cos FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(cos, 9) DESC, label) AS r FROM s) WHERE r = 1""")
def d40(spark, sf_dir):
    """Every vector against the centres of the labels' even ids."""
    e = table(spark, sf_dir, "embeddings")
    parts = e.filter("vec_id % 2 = 0").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = parts.groupBy(F.col("label").alias("cluster")).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v")).select("cluster", F.col("v.m").alias("centre"))
    return X.assign_online(e, centres, "vec_id", "embedding", 0.2).select("vec_id", "cluster", F.round("cos", 5).alias("cos"))


@query("d46_greedy_dedup")
def d46(spark, sf_dir):
    """An ordered fold, which SQL can't say; the tests hold it against a plain loop."""
    return X.greedy_dedup(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 0.3)


@query("d55_balanced_clusters")
def d55(spark, sf_dir):
    """Suppliers' balances as loads of nations, moved and swapped; the optimisers are random searches, tested for what they keep."""
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "abs(s_acctbal) AS load", "s_nationkey")
    return optimise.balance(s, "s_suppkey", "load", "s_nationkey", ("migration", "swaps", "annealing"))


@query("d57_conservation", "SELECT count(*) AS items, round(sum(abs(s_acctbal)), 2) AS load, count(DISTINCT s_nationkey) AS clusters, true AS no_worse FROM supplier")
def d57(spark, sf_dir):
    """What every pipeline of optimisers keeps, and that loads lie no further apart after heaviest-first than before."""
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "abs(s_acctbal) AS load", "s_nationkey")
    new = optimise.balance(s, "s_suppkey", "load", "s_nationkey", ("heaviest first", "swaps"))
    gap = lambda c: new.groupBy(c).agg(F.sum("load").alias("l")).agg((F.max("l") - F.min("l")).alias("gap"))
    both = gap("new_cluster").withColumnRenamed("gap", "after").crossJoin(gap("s_nationkey"))
    return new.agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("load"), 2).alias("load"), F.countDistinct("s_nationkey").alias("clusters")).crossJoin(both).select("items", "load", "clusters", (F.col("after") <= F.col("gap") + 1e-6).alias("no_worse"))


@query("j25_merged_back", "SELECT s_suppkey, s_name, s_nationkey, (s_suppkey % 5)::INT AS new_cluster FROM supplier")
def j25(spark, sf_dir):
    """An optimiser's answer, by id only, merged back to the whole rows."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return s.join(s.select("s_suppkey", (F.col("s_suppkey") % 5).cast("int").alias("new_cluster")), "s_suppkey", "left")


sql("s04_generated_amounts", "SELECT id % 10 AS region_id, CAST(year(date_add(DATE '2023-07-01', CAST(id % 365 AS INT))) AS INT) AS y, CAST(month(date_add(DATE '2023-07-01', CAST(id % 365 AS INT))) AS INT) AS m, count(*) AS n, round(sum(id * 7919 % 100003 / 1e2), 2) AS amount FROM range(500000) GROUP BY 1, 2, 3",
    "SELECT range % 10 AS region_id, year(DATE '2023-07-01' + CAST(range % 365 AS INT))::INT AS y, month(DATE '2023-07-01' + CAST(range % 365 AS INT))::INT AS m, count(*) AS n, round(sum(range * 7919 % 100003 / 1e2), 2) AS amount FROM range(500000) GROUP BY 1, 2, 3")
sql("s23_capped_trajectory", "SELECT user_id, step, value FROM (SELECT user_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS step FROM {events}) WHERE step % 5 = 0 AND step < 50")
sql("p02_validity", f"WITH {_MODAL} SELECT user_id, event_type FROM dim WHERE valid_from <= DATE '2024-01-12' AND (until > DATE '2024-01-12' OR until IS NULL)", f"WITH {_MODAL.format(events='events')} SELECT user_id, event_type FROM dim WHERE valid_from <= DATE '2024-01-12' AND (until > DATE '2024-01-12' OR until IS NULL)")
_WIDE = """WITH x AS (SELECT event_id, user_id AS run_id, event_type AS task, value AS ms, CAST(ts AS DATE) AS d, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS mi FROM {events})
       SELECT event_id, run_id, task, concat(task, '_', CAST(run_id % 4 AS {s})) AS chunk_name, CAST(run_id % 4 AS INT) AS chunk_index, d AS run_date, CAST(year(d) AS INT) AS y, CAST(month(d) AS INT) AS m, CAST(day(d) AS INT) AS dd, CAST(quarter(d) AS INT) AS q, {week} AS week_label, {dow} AS dow, {dow} >= 6 AS is_weekend, d = last_day(d) AS is_month_end, day(d) = 1 AS is_month_start, last_day(d) AS month_end, CAST(date_trunc('month', d) AS DATE) AS month_start, CAST(date_trunc('week', d) AS DATE) AS week_start, {age} AS age_days, h, mi, h * 60 + mi AS minute_of_day, CASE WHEN h < 6 THEN 'night' WHEN h < 12 THEN 'morning' WHEN h < 18 THEN 'afternoon' ELSE 'evening' END AS part_of_day,
              round(ms, 4) AS ms, round(ms / 1000, 6) AS seconds, ms > 90 AS is_slow, CASE WHEN ms < 25 THEN 'fast' WHEN ms < 75 THEN 'normal' ELSE 'slow' END AS band, task = 'error' AS is_failure, event_id = max(event_id) OVER (PARTITION BY task) AS is_latest, row_number() OVER (PARTITION BY run_id, d ORDER BY event_id) AS n_in_day, count(*) OVER (PARTITION BY run_id, d) AS day_total, round(ms - avg(ms) OVER (PARTITION BY task), 4) AS off_mean, round(100 * ms / sum(ms) OVER (PARTITION BY run_id, d), 4) AS share, upper(task) AS label, length(task) AS task_length FROM x"""
# Spark's division by zero is an error, so a day whose values add up to zero takes what IEEE division gives.
_SHARE = "100 * ms / sum(ms) OVER (PARTITION BY run_id, d)"
_IEEE_SHARE = "CASE WHEN sum(ms) OVER (PARTITION BY run_id, d) <> 0 THEN 100 * ms / nullif(sum(ms) OVER (PARTITION BY run_id, d), 0) WHEN ms IS NULL THEN NULL WHEN ms = 0 OR isnan(ms) THEN DOUBLE('NaN') WHEN ms > 0 THEN DOUBLE('Infinity') ELSE DOUBLE('-Infinity') END"
sql("p16_wide_rows", _WIDE.replace(_SHARE, _IEEE_SHARE).replace("{s}", "STRING").replace("{week}", "concat(extract(YEAROFWEEK FROM d), '-W', lpad(CAST(weekofyear(d) AS STRING), 2, '0'))").replace("{dow}", "CAST(weekday(d) + 1 AS INT)").replace("{age}", "datediff(DATE '2024-02-01', d)"),
    _WIDE.format(s="VARCHAR", week="isoyear(d) || '-W' || lpad(weekofyear(d)::VARCHAR, 2, '0')", dow="isodow(d)::INT", age="date_diff('day', d, DATE '2024-02-01')::INT", events="events"))
sql("j26_nearest_places", f"""WITH p AS (SELECT k, k % 25 AS g, lat, lon FROM {_P}), d AS (SELECT a.k AS a, b.k AS b, 2 * 6371 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS km FROM p a JOIN p b ON a.g = b.g AND a.k <> b.k)
       SELECT a, b, round(km, 3) AS km FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(km, 6), b) AS r FROM d) WHERE r <= 3""")
sql("u04_other_types", f"WITH {_MODAL}, v AS (SELECT user_id, event_type, valid_from, row_number() OVER (PARTITION BY user_id ORDER BY valid_from) AS version, count(*) OVER (PARTITION BY user_id) AS versions, last_value(event_type) OVER (PARTITION BY user_id ORDER BY valid_from ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS now FROM dim) SELECT user_id, version, version = versions AS in_current_table, event_type AS history_value, now AS mini_dimension_key, concat(user_id, '-', version) AS version_key, user_id AS durable_key FROM v",
    f"WITH {_MODAL.format(events='events')}, v AS (SELECT user_id, event_type, valid_from, row_number() OVER (PARTITION BY user_id ORDER BY valid_from) AS version, count(*) OVER (PARTITION BY user_id) AS versions, last_value(event_type) OVER (PARTITION BY user_id ORDER BY valid_from ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS now FROM dim) SELECT user_id, version, version = versions AS in_current_table, event_type AS history_value, now AS mini_dimension_key, user_id || '-' || version AS version_key, user_id AS durable_key FROM v")
# Bitmaps of a task's healthy days by version; a day without a version is left out, backfills (odd users) don't count.
sql("u10_health_by_version", """WITH d AS (SELECT event_type AS k, day(ts) % 3 AS version, datediff(DATE '2024-01-30', CAST(ts AS DATE)) AS ago, count(*) FILTER (WHERE event_id % 11 = 0) = 0 AS ok FROM {events} WHERE user_id % 2 = 0 AND day(ts) % 5 > 0 GROUP BY 1, 2, 3) SELECT k, version, CAST(sum(CASE WHEN ok THEN shiftleft(1L, 31 - ago) ELSE 0 END) AS BIGINT) AS bitmap FROM d GROUP BY k, version""",
    """WITH d AS (SELECT event_type AS k, day(ts) % 3 AS version, date_diff('day', CAST(ts AS DATE), DATE '2024-01-30')::INT AS ago, count(*) FILTER (event_id % 11 = 0) = 0 AS ok FROM events WHERE user_id % 2 = 0 AND day(ts) % 5 > 0 GROUP BY 1, 2, 3) SELECT k, version::INT AS version, sum(CASE WHEN ok THEN 1::BIGINT << (31 - ago) ELSE 0 END)::BIGINT AS bitmap FROM d GROUP BY k, version""")
sql("g09_version_runs", "SELECT p_partkey div 3 AS parent, count(*) AS versions, sum(n) AS runs FROM {part} JOIN (SELECT l_partkey, count(*) AS n FROM {lineitem} GROUP BY l_partkey) ON l_partkey = p_partkey GROUP BY 1", "SELECT p_partkey // 3 AS parent, count(*) AS versions, sum(n)::BIGINT AS runs FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey GROUP BY 1")
sql("g15_styled_mermaid", """SELECT n_regionkey, array_join(array_sort(collect_list(concat('n', n_nationkey, '[', n_name, ']:::', CASE WHEN n_nationkey % 3 = 0 THEN 'failed' WHEN n_nationkey % 3 = 1 THEN 'running' ELSE 'success' END))), '; ') AS lines, 'classDef failed fill:#f66; classDef running fill:#ff9; classDef success fill:#6f6' AS styles FROM {nation} GROUP BY n_regionkey""",
    """SELECT n_regionkey, string_agg(l, '; ' ORDER BY l) AS lines, 'classDef failed fill:#f66; classDef running fill:#ff9; classDef success fill:#6f6' AS styles FROM (SELECT n_regionkey, 'n' || n_nationkey || '[' || n_name || ']:::' || CASE WHEN n_nationkey % 3 = 0 THEN 'failed' WHEN n_nationkey % 3 = 1 THEN 'running' ELSE 'success' END AS l FROM nation) GROUP BY n_regionkey""")
# Attempts of a task with delays that grow by one each time, until one succeeds or the retries are used up.
sql("g16_retries", """WITH t AS (SELECT p_partkey AS task, CAST(p_size % 4 AS INT) AS retries, CAST(p_partkey % 6 AS INT) AS fails FROM {part}), a AS (SELECT task, retries, fails, {n} AS attempt FROM t {x})
       SELECT task, attempt, attempt * (attempt + 1) / 2 * 30 AS starts_after, CASE WHEN attempt < fails AND attempt < retries THEN 'RETRY' WHEN attempt < fails THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM a""".replace("{n}", "attempt").replace("{x}", "LATERAL VIEW explode(sequence(0, least(retries, fails))) AS attempt"),
    """WITH t AS (SELECT p_partkey AS task, CAST(p_size % 4 AS INT) AS retries, CAST(p_partkey % 6 AS INT) AS fails FROM part), a AS (SELECT task, retries, fails, unnest(range(least(retries, fails) + 1))::INT AS attempt FROM t)
       SELECT task, attempt, attempt * (attempt + 1) / 2 * 30 AS starts_after, CASE WHEN attempt < fails AND attempt < retries THEN 'RETRY' WHEN attempt < fails THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM a""")
sql("f31_ecef_jacobian", f"SELECT k, round(-6371000 * sin(radians(lat)) * cos(radians(lon)), 3) AS dx_dlat, round(-6371000 * cos(radians(lat)) * sin(radians(lon)), 3) AS dx_dlon, round(-6371000 * sin(radians(lat)) * sin(radians(lon)), 3) AS dy_dlat, round(6371000 * cos(radians(lat)) * cos(radians(lon)), 3) AS dy_dlon, round(6371000 * cos(radians(lat)), 3) AS dz_dlat FROM {_P}")
sql("f33_great_circle_space", f"SELECT k, round(6371000 * acos(least(1, greatest(-1, sin(radians(lat)) * sin(radians(10)) + cos(radians(lat)) * cos(radians(10)) * cos(radians(lon - 20))))), 2) AS metres, round(pow(6371000 * radians(1), 2) * cos(radians(lat)), 2) AS area_element FROM {_P}")
sql("f34_more_kernels", "SELECT s_suppkey AS k, CASE WHEN d <= 1 THEN 1e0 ELSE 0e0 END AS uniform, round(exp(-d), 9) AS matern12, round((1 + sqrt(5) * d + 5 * d * d / 3) * exp(-sqrt(5) * d), 9) AS matern52 FROM (SELECT s_suppkey, (s_suppkey % 40) / 1e1 AS d FROM {supplier})")
sql("f35_wasserstein", """WITH c AS (SELECT day(ts) AS i, count(*) FILTER (WHERE event_type = 'view') * 1e0 AS a, count(*) FILTER (WHERE event_type = 'click') * 1e0 AS b FROM {events} GROUP BY 1), p AS (SELECT i, a / sum(a) OVER () AS a, b / sum(b) OVER () AS b FROM c), f AS (SELECT sum(a - b) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS d FROM p) SELECT round(sum(abs(d)), 9) AS wasserstein FROM f""")
sql("f45_rotating_frame", """SELECT p_partkey, round(p_retailprice * cos(1e-1 * p_size) + p_size * sin(1e-1 * p_size), 6) AS x, round(-p_retailprice * sin(1e-1 * p_size) + p_size * cos(1e-1 * p_size), 6) AS y, round(384400e3 * (1 - pow(1.2e-2 / 3, 1 / 3e0)), 3) AS l1, CASE WHEN p_size < 5 THEN 0 WHEN p_size < 20 THEN 1 ELSE -1 END AS body_hit FROM {part}""")
sql("d26_months_and_trend", """WITH b AS (SELECT event_type AS k, CAST(ts AS DATE) AS d, max_by(value, struct(ts, event_id)) AS c FROM {events} GROUP BY 1, 2), m AS (SELECT k, d, c, avg(c) OVER (PARTITION BY k ORDER BY d ROWS 4 PRECEDING) AS ma FROM b) SELECT k, round(max_by(c, d) / nullif(min_by(c, d), 0) - 1, 6) AS month_return, round(100 * avg(CASE WHEN c > ma + 1e-9 THEN 1e0 ELSE 0e0 END), 4) AS above_pct FROM m GROUP BY k""",
    """WITH b AS (SELECT event_type AS k, CAST(ts AS DATE) AS d, arg_max(value, (ts, event_id)) AS c FROM events GROUP BY 1, 2), m AS (SELECT k, d, c, avg(c) OVER (PARTITION BY k ORDER BY d ROWS 4 PRECEDING) AS ma FROM b) SELECT k, round(arg_max(c, d) / nullif(arg_min(c, d), 0) - 1, 6) AS month_return, round(100 * avg(CASE WHEN c > ma + 1e-9 THEN 1e0 ELSE 0e0 END), 4) AS above_pct FROM m GROUP BY k""")
_BARS = "b AS (SELECT event_type AS k, CAST(ts AS DATE) AS d, avg(value) AS c FROM {events} GROUP BY 1, 2)"
sql("d21_momentum_rule", f"WITH {_BARS}, m AS (SELECT k, d, c / lag(c, 3) OVER (PARTITION BY k ORDER BY d) - 1 AS r FROM b) SELECT k, d, CASE WHEN r > 2e-2 THEN 1 WHEN r < -2e-2 THEN -1 ELSE 0 END AS signal FROM m")
sql("d21_cross_rule", f"WITH {_BARS}, m AS (SELECT k, d, avg(c) OVER (PARTITION BY k ORDER BY d ROWS 2 PRECEDING) - avg(c) OVER (PARTITION BY k ORDER BY d ROWS 6 PRECEDING) AS x FROM b), l AS (SELECT k, d, round(x, 9) AS x, round(lag(x) OVER (PARTITION BY k ORDER BY d), 9) AS y FROM m) SELECT k, d, CASE WHEN x > 0 AND y <= 0 THEN 1 WHEN x < 0 AND y >= 0 THEN -1 ELSE 0 END AS signal FROM l")
sql("d21_reversion_rule", f"WITH {_BARS}, g AS (SELECT k, d, c - lag(c) OVER (PARTITION BY k ORDER BY d) AS x FROM b), r AS (SELECT k, d, avg(greatest(x, 0)) OVER w AS up, avg(greatest(-x, 0)) OVER w AS down FROM g WINDOW w AS (PARTITION BY k ORDER BY d ROWS 6 PRECEDING)) SELECT k, d, CASE WHEN up / nullif(up + down, 0) < 3e-1 THEN 1 WHEN up / nullif(up + down, 0) > 7e-1 THEN -1 ELSE 0 END AS signal FROM r")
sql("d21_breakout_rule", f"WITH {_BARS}, m AS (SELECT k, d, c, max(c) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS hi, min(c) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS lo FROM b) SELECT k, d, CASE WHEN c > hi THEN 1 WHEN c < lo THEN -1 ELSE 0 END AS signal FROM m")
sql("d31_centroid_distances", "WITH p AS (SELECT s_nationkey AS r, avg(s_suppkey * 37 % 120) AS x, avg(s_suppkey * 91 % 340) AS y FROM {supplier} GROUP BY s_nationkey) SELECT a.r AS a, b.r AS b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS centroid FROM p a JOIN p b ON a.r <> b.r")
_BASKETS = "b AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d, event_type AS i FROM {events})"
sql("d04_abandoned", f"WITH {_BASKETS}, s AS (SELECT user_id, d, bool_or(i = 'click') AS clicked, bool_or(i = 'purchase') AS bought, count(*) AS kinds FROM b GROUP BY user_id, d) SELECT kinds, count(*) FILTER (WHERE clicked AND NOT bought) AS abandoned, count(*) FILTER (WHERE clicked AND bought) AS closed FROM s GROUP BY kinds")
sql("d04_cross_sell", f"WITH {_BASKETS} SELECT x.i AS have, y.i AS offer, count(*) AS together FROM b x JOIN b y ON x.user_id = y.user_id AND x.d = y.d AND x.i <> y.i GROUP BY x.i, y.i")
sql("d04_top_combos", f"WITH {_BASKETS}, s AS (SELECT user_id, d, {{agg}} AS combo FROM b GROUP BY user_id, d) SELECT combo, count(*) AS n FROM s GROUP BY combo ORDER BY n DESC, combo LIMIT 10".replace("{agg}", "array_join(array_sort(collect_set(i)), ',')"),
    f"WITH {_BASKETS.format(events='events')}, s AS (SELECT user_id, d, string_agg(i, ',' ORDER BY i) AS combo FROM b GROUP BY user_id, d) SELECT combo, count(*) AS n FROM s GROUP BY combo ORDER BY n DESC, combo LIMIT 10")


@query("d48_merge_tree", "SELECT label, count(*) AS n, round(sum(embedding[1]::DOUBLE), 5) AS first, max(vec_id) AS last FROM embeddings GROUP BY label")
def d48(spark, sf_dir):
    """Partial clusterings of eight shards, merged two by two until one is left."""
    part = table(spark, sf_dir, "embeddings").groupBy((F.col("vec_id") % 8).alias("shard"), "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("embedding")[0].cast("double")).alias("first"), F.max("vec_id").alias("last"))
    for _ in range(3):
        part = part.groupBy(F.floor(F.col("shard") / 2).alias("shard"), "label").agg(F.sum("n").alias("n"), F.sum("first").alias("first"), F.max("last").alias("last"))
    return part.select("label", "n", F.round("first", 5).alias("first"), "last")


@query("g18_critical_path", """WITH RECURSIVE e AS (SELECT p_partkey AS dst, p_partkey // 2 AS src FROM part WHERE p_partkey >= 2 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey >= 3 AND p_partkey % 3 = 0), w AS (SELECT p_partkey AS node, p_size::DOUBLE AS w FROM part UNION SELECT 1, 1 WHERE 1 NOT IN (SELECT p_partkey FROM part)),
       r(node, cost) USING KEY (node) AS (SELECT node, w FROM w WHERE node = 1 UNION SELECT e.dst, max(n.cost + w.w) FROM r AS n JOIN e ON e.src = n.node JOIN w ON w.node = e.dst LEFT JOIN recurring.r AS own ON own.node = e.dst WHERE own.cost IS NULL OR n.cost + w.w > own.cost GROUP BY e.dst)
       SELECT node, cost FROM r""")
def g18(spark, sf_dir):
    """The slowest chain that ends in each task of the graph, by the parts' sizes as durations."""
    from tessera.operators import graph as G
    from tessera.plans.graphs import dag

    return G.longest_paths(dag(spark, sf_dir), table(spark, sf_dir, "part").selectExpr("p_partkey AS node", "p_size AS weight")).select("node", "cost")
