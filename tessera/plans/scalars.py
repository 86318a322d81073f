"""Scalar functions applied to the tables."""

from pyspark.sql import functions as F

from tessera.functions import bitmaps, scalar
from tessera.registry import query, sql
from tessera.tables import table

BM = "(SELECT user_id, sum(DISTINCT 1::BIGINT << (31 - date_diff('day', CAST(ts AS DATE), DATE '2024-01-30')))::BIGINT AS b FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2023-12-30' AND DATE '2024-01-30' GROUP BY user_id)"


def _bitmaps(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.to_date("ts")).alias("d"))
    return days.select("user_id", bitmaps.from_days(F.col("d"), F.lit("2024-01-30").cast("date")).alias("b"))


@query("f01_shift_bitmap", f"SELECT user_id, (b >> 1) | (1::BIGINT << 31) AS b FROM {BM}")
def f01(spark, sf_dir):
    return _bitmaps(spark, sf_dir).filter("b > 0").select("user_id", bitmaps.shifted(F.col("b"), F.lit(True)).alias("b"))


@query("f02_active_days_ago", f"SELECT user_id, b & (1::BIGINT << 24) > 0 AS active FROM {BM}")
def f02(spark, sf_dir):
    return _bitmaps(spark, sf_dir).filter("b > 0").select("user_id", bitmaps.active_days_ago(F.col("b"), 7).alias("active"))


@query("f03_bitmap_text", f"SELECT user_id, lpad(format('{{:b}}', b), 32, '0') AS bits FROM {BM}")
def f03(spark, sf_dir):
    return _bitmaps(spark, sf_dir).filter("b > 0").select("user_id", bitmaps.as_bits(F.col("b")).alias("bits"))


@query("f04_day_bit", "SELECT o_orderkey, 1::BIGINT << (32 - day(o_orderdate)) AS bit FROM orders")
def f04(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", bitmaps.day_of_month_bit(F.dayofmonth("o_orderdate")).alias("bit"))


@query("f06_json_diff", """SELECT a.c_custkey, CASE WHEN a.c_mktsegment = b.c_mktsegment THEN '{}' ELSE '{"seg":{"from":"' || b.c_mktsegment || '","to":"' || a.c_mktsegment || '"}}' END AS diff FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey - 1""")
def f06(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.create_map(F.lit("seg"), "c_mktsegment").alias("m"))
    old = c.select((F.col("c_custkey") + 1).alias("c_custkey"), F.col("m").alias("o"))
    return c.join(old, "c_custkey").select("c_custkey", scalar.json_diff(F.col("o"), F.col("m")).alias("diff"))


sql("f07_json_build", "SELECT n_nationkey, to_json(named_struct('k', n_nationkey, 'n', n_name)) AS j FROM {nation}", """SELECT n_nationkey, '{"k":' || n_nationkey || ',"n":"' || n_name || '"}' AS j FROM nation""")
sql("f08_elements_with_ordinality", "SELECT o_custkey, pos + 1 AS i, p FROM (SELECT o_custkey, array_sort(collect_set(o_orderpriority)) AS a FROM {orders} GROUP BY o_custkey) LATERAL VIEW posexplode(a) AS pos, p",
    "SELECT o_custkey, i::INT AS i, a[i] AS p FROM (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS a FROM orders GROUP BY o_custkey), LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i)")
sql("f09_array_functions", "SELECT n_nationkey, concat(array_append(split(n_name, 'A'), 'x'), array_repeat('0', 2)) AS a, slice(split(n_name, ''), 1, 3) AS s, cardinality(split(n_name, 'A')) AS n FROM {nation}",
    "SELECT n_nationkey, list_concat(list_append(string_split(n_name, 'A'), 'x'), ['0', '0']) AS a, string_split(n_name, '')[1:3] AS s, len(string_split(n_name, 'A')) AS n FROM nation")
sql("f10_array_to_string", "SELECT n_nationkey, array_join(split(n_name, ''), '-') AS s FROM {nation}", "SELECT n_nationkey, array_to_string(string_split(n_name, ''), '-') AS s FROM nation")
sql("f11_date_parts", "SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS wk, CAST(day(o_orderdate) AS INT) AS d, CAST(dayofweek(o_orderdate) - 1 AS INT) AS dow, unix_timestamp(o_orderdate) AS epoch FROM {orders}",
    "SELECT o_orderkey, date_trunc('week', o_orderdate)::DATE AS wk, day(o_orderdate)::INT AS d, dayofweek(o_orderdate)::INT AS dow, epoch(o_orderdate)::BIGINT AS epoch FROM orders")
sql("f12_date_text", "SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM') AS m, date_format(o_orderdate, 'EEEE') AS day FROM {orders}", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS m, strftime(o_orderdate, '%A') AS day FROM orders")
sql("f13_cron_start", "SELECT n_nationkey, TIMESTAMP '2024-05-05 00:00:00' + make_dt_interval(0, CAST(split_part(cron, ' ', 2) AS INT), CAST(split_part(cron, ' ', 1) AS INT)) AS planned FROM (SELECT n_nationkey, concat(n_nationkey, ' 6 * * *') AS cron FROM {nation})",
    "SELECT n_nationkey, TIMESTAMP '2024-05-05 00:00:00' + to_hours(split_part(cron, ' ', 2)::INT) + to_minutes(split_part(cron, ' ', 1)::INT) AS planned FROM (SELECT n_nationkey, n_nationkey || ' 6 * * *' AS cron FROM nation)")


@query("f14_previous_weekday", "SELECT DISTINCT o_orderdate::DATE AS d, o_orderdate::DATE - CASE WHEN dayofweek(o_orderdate) = 1 THEN 3 ELSE 1 END AS before FROM orders")
def f14(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return d.select("d", scalar.previous_weekday(F.col("d")).alias("before"))


sql("f15_regex_functions", "SELECT p_partkey, regexp_replace(p_name, '[0-9]+$', '') AS base, regexp_extract(p_name, '([0-9]+)$', 1) AS suffix, p_name RLIKE '[0-9]$' AS numbered FROM {part}",
    "SELECT p_partkey, regexp_replace(p_name, '[0-9]+$', '') AS base, regexp_extract(p_name, '([0-9]+)$', 1) AS suffix, regexp_matches(p_name, '[0-9]$') AS numbered FROM part")
sql("f16_text_functions", "SELECT n_nationkey, left(n_name, 3) AS l, repeat('ab', 2) AS r, lpad(CAST(n_nationkey AS STRING), 4, '0') AS p, coalesce(nullif(n_regionkey, 0), -1) AS c FROM {nation}")
sql("f17_weighted_categories", "SELECT event_id, CASE WHEN h < 50 THEN 'a' WHEN h < 80 THEN 'b' ELSE 'c' END AS category FROM (SELECT event_id, pmod(CAST(conv(substr(md5(CAST(event_id AS STRING)), 1, 8), 16, 10) AS BIGINT), 100) AS h FROM {events})",
    "SELECT event_id, CASE WHEN h < 50 THEN 'a' WHEN h < 80 THEN 'b' ELSE 'c' END AS category FROM (SELECT event_id, ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % 100 AS h FROM events)")
sql("f18_hash_buckets", "SELECT c_custkey, pmod(CAST(conv(substr(md5(c_name), 1, 12), 16, 10) AS BIGINT), 16) AS bucket FROM {customer}", "SELECT c_custkey, ('0x' || substr(md5(c_name), 1, 12))::BIGINT % 16 AS bucket FROM customer")


@query("f19_slugs", "SELECT p_partkey, left(lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')), 24) || '-' || left(sha1(p_name), 6) AS slug FROM part")
def f19(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalar.slug(F.col("p_name")).alias("slug"))


sql("f20_content_hash", "SELECT doc_id, sha2(text, 256) AS h FROM {documents}", "SELECT doc_id, sha256(text) AS h FROM documents")


@query("f21_jaccard_of_turns", r"""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS s FROM conversations), p AS (SELECT conv_id, turn, s, lag(s) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM w)
          SELECT conv_id, turn, round(len(list_intersect(s, b)) / len(list_distinct(list_concat(s, b))), 6) AS jaccard FROM p WHERE b IS NOT NULL""")
def f21(spark, sf_dir):
    """Each turn against the one before (also the repetition report of conversations)."""
    from pyspark.sql.window import Window

    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", scalar.word_set(F.col("text")).alias("s"))
    w = w.withColumn("b", F.lag("s").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("b IS NOT NULL")
    return w.select("conv_id", "turn", F.round(scalar.jaccard(F.col("s"), F.col("b")), 6).alias("jaccard"))


sql("f25_text_complexity", r"""SELECT doc_id, round(0.4 * least(1, length(text) / 200) + 0.3 * size(array_distinct(w)) / size(w) + 0.3 * least(1, aggregate(w, 0, (s, x) -> s + length(x)) / size(w) / 10), 6) AS score FROM (SELECT doc_id, text, split(text, ' ') AS w FROM {documents})""",
    "SELECT doc_id, round(0.4 * least(1, length(text) / 200) + 0.3 * len(list_distinct(w)) / len(w) + 0.3 * least(1, list_sum(list_transform(w, lambda x: length(x))) / len(w) / 10), 6) AS score FROM (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents)")
sql("f26_keywords", "SELECT doc_id, array_join(slice(filter(split(lower(text), ' '), x -> length(x) >= 3 AND NOT x RLIKE '[0-9]'), 1, 5), ' ') AS keywords FROM {documents}",
    "SELECT doc_id, array_to_string(list_filter(string_split(lower(text), ' '), lambda x: length(x) >= 3 AND NOT regexp_matches(x, '[0-9]'))[1:5], ' ') AS keywords FROM documents")
sql("f38_compound_interest", "SELECT m AS month, round(1000 * pow(1.01, m) + 100 * (pow(1.01, m) - 1) / 0.01, 6) AS value FROM (SELECT explode(sequence(1, 60)) AS m)", "SELECT range::INT AS month, round(1000 * pow(1.01, range) + 100 * (pow(1.01, range) - 1) / 0.01, 6) AS value FROM range(1, 61)")
sql("f39_palindromes", "SELECT word FROM (SELECT DISTINCT explode(split(lower(text), '[^a-z]+')) AS word FROM {documents}) WHERE length(word) > 2 AND reverse(word) = word", "SELECT word FROM (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents) WHERE length(word) > 2 AND reverse(word) = word")
sql("f40_token_estimate", "SELECT doc_id, greatest(CAST(length(text) AS BIGINT) div 4, 10) AS tokens FROM {documents}", "SELECT doc_id, greatest(length(text) // 4, 10) AS tokens FROM documents")
sql("f42_regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity * l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity * l_quantity), 4) AS intercept FROM {lineitem} GROUP BY l_returnflag")
sql("f43_json_repair", "SELECT event_id, try_parse_json(CASE WHEN event_id % 7 = 0 THEN left(props, length(props) - 1) ELSE props END) IS NULL AS broken FROM {events}",
    "SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN left(props, length(props) - 1) ELSE props END AS JSON) IS NULL AS broken FROM events")

#: Places derived from keys, as the tables have none.
PLACE = "(SELECT s_suppkey AS k, s_nationkey AS g, (s_suppkey * 37 % 120 - 60) * 1.0 AS lat, (s_suppkey * 91 % 340 - 170) * 1.0 AS lon FROM {t})"


def _pairs(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("g"), ((F.col("s_suppkey") * 37 % 120 - 60) * 1.0).alias("lat"), ((F.col("s_suppkey") * 91 % 340 - 170) * 1.0).alias("lon"))
    b = s.select(F.col("k").alias("k2"), "g", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return s.join(b, "g").filter("k < k2")


_PAIR = f"SELECT a.k, b.k AS k2, {{e}} AS d FROM {PLACE.format(t='supplier')} a JOIN {PLACE.format(t='supplier')} b ON a.g = b.g AND a.k < b.k"


@query("f27_haversine", _PAIR.format(e="round(2 * 6371000 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))), 3)"))
def f27(spark, sf_dir):
    return _pairs(spark, sf_dir).select("k", "k2", F.round(scalar.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 3).alias("d"))


@query("f28_tangent_plane", _PAIR.format(e="round(sqrt(pow((b.lat - a.lat) * 111132.954, 2) + pow((b.lon - a.lon) * 111132.954 * cos(radians((a.lat + b.lat) / 2)), 2)), 3)"))
def f28(spark, sf_dir):
    return _pairs(spark, sf_dir).select("k", "k2", F.round(scalar.tangent_plane(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 3).alias("d"))


@query("f31_ecef", f"SELECT k, round(6371000 * cos(radians(lat)) * cos(radians(lon)), 3) AS x, round(6371000 * cos(radians(lat)) * sin(radians(lon)), 3) AS y, round(6371000 * sin(radians(lat)), 3) AS z FROM {PLACE.format(t='supplier')}")
def f31(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), scalar.ecef((F.col("s_suppkey") * 37 % 120 - 60) * 1.0, (F.col("s_suppkey") * 91 % 340 - 170) * 1.0).alias("p"))
    return s.select("k", *(F.round(f"p.{c}", 3).alias(c) for c in "xyz"))


@query("f34_kernels", "SELECT s_suppkey AS k, round(CASE WHEN d <= 3 THEN exp(-0.5 * d * d) ELSE 0 END, 9) AS gaussian, round(CASE WHEN d <= 1 THEN 1 - d * d ELSE 0 END, 9) AS epanechnikov, round(CASE WHEN d <= 1 THEN 1 - d ELSE 0 END, 9) AS triangular, round(CASE WHEN d <= 1 THEN 15.0 / 16 * pow(1 - d * d, 2) ELSE 0 END, 9) AS quartic, round((1 + sqrt(3) * d) * exp(-sqrt(3) * d), 9) AS matern32 FROM (SELECT s_suppkey, (s_suppkey % 40) / 10.0::DOUBLE AS d FROM supplier)")
def f34(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), ((F.col("s_suppkey") % 40) / 10.0).alias("d"))
    return d.select("k", *(F.round(scalar.kernel(n, F.col("d"), 1.0), 9).alias(n) for n in ("gaussian", "epanechnikov", "triangular", "quartic", "matern32")))


sql("f35_distribution_distances",
    """WITH c AS (SELECT event_type AS k, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15') AS a, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS b FROM {events} GROUP BY event_type),
            p AS (SELECT k, a * 1.0 / sum(a) OVER () + 1e-12 AS p, b * 1.0 / sum(b) OVER () + 1e-12 AS q FROM c)
       SELECT round(sum(p * ln(p / q)), 9) AS kl, round(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2, 9) AS js, round(sum(abs(p - q)) / 2, 9) AS tv, round(sqrt(sum(pow(sqrt(p) - sqrt(q), 2)) / 2), 9) AS hellinger FROM p""")


@query("f36_shoelace", "SELECT user_id, round(abs(sum(x * ny - nx * y)) / 2, 4) AS area FROM (SELECT user_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM (SELECT user_id, event_id, value AS x, (event_id % 100) * 1.0 AS y FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY user_id")
def f36(spark, sf_dir):
    p = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("p"))
    xs, ys = F.transform("p", lambda e: e["value"]), F.transform("p", lambda e: (e["event_id"] % 100).cast("double"))
    return p.select("user_id", F.round(scalar.shoelace(xs, ys), 4).alias("area"))
