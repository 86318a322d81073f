"""Baskets, intervals, text and balance."""

from pyspark.sql import functions as F

from tessera.operators import balancing as B
from tessera.operators import intervals as I
from tessera.operators import joins as J
from tessera.operators import text as X
from tessera.registry import query, sql
from tessera.tables import table

sql("d01_baskets", "SELECT user_id, CAST(ts AS DATE) AS d, array_sort(collect_set(event_type)) AS items FROM {events} GROUP BY user_id, CAST(ts AS DATE)", "SELECT user_id, CAST(ts AS DATE) AS d, list_sort(list(DISTINCT event_type)) AS items FROM events GROUP BY ALL")
RULES = """WITH b AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d, event_type AS i FROM {events}), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT user_id, d FROM b)), s AS (SELECT i, count(*) AS c FROM b GROUP BY i),
            p AS (SELECT x.i AS a, y.i AS c, count(*) AS pairs FROM b x JOIN b y ON x.user_id = y.user_id AND x.d = y.d AND x.i <> y.i GROUP BY x.i, y.i)
       SELECT p.a AS antecedent, p.c AS consequent, round(pairs * 1.0 / n, 6) AS support, round(pairs * 1.0 / sa.c, 6) AS confidence, round(pairs * 1.0 * n / sa.c / sc.c, 6) AS lift FROM p CROSS JOIN n JOIN s sa ON sa.i = p.a JOIN s sc ON sc.i = p.c"""
sql("d02_pair_rules", RULES + " WHERE pairs >= 0.01 * n")
sql("d03_dynamic_thresholds", """WITH b AS (SELECT event_type AS i, count(DISTINCT struct(user_id, CAST(ts AS DATE))) AS c FROM {events} GROUP BY event_type), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) FROM {events}))
       SELECT round(greatest(0.02 * min(c) / n, 0.01), 6) AS min_support, round(greatest(0.05, least(0.3, 50.0 / n)), 6) AS min_confidence FROM b CROSS JOIN n GROUP BY n""",
    """WITH b AS (SELECT event_type AS i, count(DISTINCT (user_id, CAST(ts AS DATE))) AS c FROM events GROUP BY event_type), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) FROM events))
       SELECT round(greatest(0.02 * min(c) / n, 0.01), 6) AS min_support, round(greatest(0.05, least(0.3, 50.0 / n)), 6) AS min_confidence FROM b CROSS JOIN n GROUP BY n""")
sql("d04_next_item", RULES + " WHERE p.a = 'view' ORDER BY lift DESC, consequent LIMIT 5")
sql("l10_top_rules", RULES + " ORDER BY lift DESC, antecedent, consequent LIMIT 5")


@query("d02_frequent_itemsets", """WITH k AS (SELECT event_type AS i, 1 << (row_number() OVER (ORDER BY event_type) - 1)::INT AS bit FROM (SELECT DISTINCT event_type FROM events)), b AS (SELECT user_id, CAST(ts AS DATE) AS d, sum(DISTINCT bit)::INT AS mask FROM events JOIN k ON i = event_type GROUP BY 1, 2),
            s AS (SELECT range::INT AS s FROM range(1, 1 << (SELECT count(*) FROM k)::INT)), f AS (SELECT s, count(*) AS freq FROM s JOIN b ON mask & s = s GROUP BY s) SELECT (SELECT list(i ORDER BY i) FROM k WHERE bit & s > 0) AS items, freq FROM f WHERE freq >= 0.05 * (SELECT count(*) FROM b)""")
def d02(spark, sf_dir):
    """Itemsets of any size by FP-growth."""
    from pyspark.ml.fpm import FPGrowth

    baskets = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts")).agg(F.collect_set("event_type").alias("items"))
    return FPGrowth(itemsCol="items", minSupport=0.05, minConfidence=0.3).fit(baskets).freqItemsets.select(F.array_sort("items").alias("items"), "freq")


def _spans(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))


SPANS = "s AS (SELECT user_id, CAST(ts AS DATE) AS d, min(ts) AS a, max(ts) AS b FROM events GROUP BY ALL)"


@query("d51_interval_predicates", "WITH s AS (SELECT user_id, event_type AS k, min(ts) AS a, max(ts) AS b FROM events GROUP BY ALL) SELECT x.user_id AS u, x.k AS x, y.k AS y, x.a <= y.a AND y.b <= x.b AS holds, greatest(x.a, y.a) AS start, least(x.b, y.b) AS stop, least(x.a, y.a) AS u_start, greatest(x.b, y.b) AS u_stop FROM s x JOIN s y ON x.user_id = y.user_id AND x.k < y.k AND x.a <= y.b AND y.a <= x.b")
def d51(spark, sf_dir):
    """How the times in which a user does one thing and another meet: few intervals for each user, so pairs are in proportion to the users."""
    s = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("k")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    x, y = s.select(F.col("user_id").alias("u"), F.col("k").alias("x"), F.col("a").alias("a0"), F.col("b").alias("a1")), s.select(F.col("user_id").alias("u"), F.col("k").alias("y"), F.col("a").alias("b0"), F.col("b").alias("b1"))
    ends = [F.col(c) for c in ("a0", "a1", "b0", "b1")]
    p = x.join(y, "u").filter(F.col("x") < F.col("y")).filter(I.overlaps(*ends))
    p = p.select("u", "x", "y", I.contains(*ends).alias("holds"), I.intersection(*ends).alias("i"), F.least("a0", "b0").alias("u_start"), F.greatest("a1", "b1").alias("u_stop"))
    return p.select("u", "x", "y", "holds", F.col("i.start").alias("start"), F.col("i.end").alias("stop"), "u_start", "u_stop")


@query("d52_merged_intervals", f"""WITH {SPANS}, f AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY d ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s), i AS (SELECT *, sum(new) OVER (PARTITION BY d ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM f)
       SELECT d, min(a) AS a, max(b) AS b, count(*) AS n FROM i GROUP BY d, i""")
def d52(spark, sf_dir):
    return I.merged(_spans(spark, sf_dir), ["d"], "a", "b")


@query("d53_stabbing", f"WITH {SPANS} SELECT e.event_id, count(*) AS open_sessions FROM events e JOIN s ON e.ts BETWEEN s.a AND s.b GROUP BY e.event_id")
def d53(spark, sf_dir):
    """Sessions open at each event, by running sums over starts and ends."""
    return J.depth(table(spark, sf_dir, "events").select("event_id", "ts"), _spans(spark, sf_dir), "ts", "a", "b").select("event_id", F.col("depth").alias("open_sessions"))


@query("d53_first_interval", "WITH s AS (SELECT event_type AS k, CAST(ts AS DATE) AS d, min(ts) AS a, max(ts) AS b FROM events GROUP BY ALL) SELECT e.event_id, min(s.k) AS first_kind, count(*) AS n FROM events e JOIN s ON CAST(e.ts AS DATE) = s.d AND e.ts BETWEEN s.a AND s.b GROUP BY e.event_id")
def d53f(spark, sf_dir):
    """The first interval in order of its kind that holds each event: five intervals a day, so a point meets five."""
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    s = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("k"), F.to_date("ts").alias("d")).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).drop("d")
    return J.stab(e, s, "ts", "a", "b").groupBy("event_id").agg(F.min("k").alias("first_kind"), F.count(F.lit(1)).alias("n"))


sql("d56_balance_objective", """WITH l AS (SELECT s_nationkey AS cluster, sum(s_acctbal) AS load FROM {supplier} GROUP BY s_nationkey), m AS (SELECT median(load) AS m FROM l) SELECT round(CASE WHEN m = 0 THEN 0 ELSE median(abs(load - m)) / m END, 6) AS objective FROM l CROSS JOIN m GROUP BY m""")
sql("d58_movements", "SELECT c_nationkey AS before, CAST(c_custkey % 5 AS INT) AS after, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM {customer} GROUP BY c_nationkey, c_custkey % 5")
sql("d59_source_report", "SELECT lang, source, count(*) AS n, rank() OVER (PARTITION BY lang ORDER BY count(*) DESC) AS place FROM {documents} GROUP BY lang, source")
sql("d47_adaptive_sizes", "SELECT lang, count(*) AS n, CAST(greatest(2, least(20, floor(sqrt(count(*) / 2.0)))) AS INT) AS k, CAST(greatest(5, least(50, ceil(count(*) / 10.0))) AS INT) AS batch FROM {documents} GROUP BY lang")
# Numbers in the order of ids in two steps, within ranges of ids and over the ranges, so no task orders the whole table.
sql("d42_slots", """WITH g AS (SELECT doc_id, floor(doc_id / 4096) AS g FROM {documents}), o AS (SELECT g, sum(count(*)) OVER (ORDER BY g) - count(*) AS before FROM g GROUP BY g),
            n AS (SELECT doc_id, before + row_number() OVER (PARTITION BY g.g ORDER BY doc_id) - 1 AS i FROM g JOIN o ON o.g = g.g)
       SELECT doc_id, CAST(i % 5 AS INT) AS slot, CAST((i - i % 5) / 5 % 3 AS INT) AS batch, CAST((i - i % 15) / 15 AS INT) AS workflow FROM n""",
    "SELECT doc_id, CAST(i % 5 AS INT) AS slot, CAST((i - i % 5) / 5 % 3 AS INT) AS batch, CAST((i - i % 15) / 15 AS INT) AS workflow FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)")
sql("d42_token_windows", r"""WITH t AS (SELECT doc_id, size(split(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ')), ' ')) AS words FROM {documents})
       SELECT doc_id, w AS window, CAST(w * 200 AS INT) AS first_word, CAST(least(words, w * 200 + 200) AS INT) AS end_word FROM t LATERAL VIEW explode(sequence(0, CAST((words - 1) div 200 AS INT))) AS w""",
    r"""WITH t AS (SELECT doc_id, len(string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' ')) AS words FROM documents)
       SELECT doc_id, w::INT AS window, (w * 200)::INT AS first_word, least(words, w * 200 + 200)::INT AS end_word FROM (SELECT doc_id, words, unnest(range((words - 1) // 200 + 1)) AS w FROM t)""")
sql("d43_chunk_votes", """WITH v AS (SELECT conv_id, CASE WHEN length(text) > 300 THEN 'long' ELSE 'short' END AS topic, length(text) * 1.0 AS conf FROM {conversations}), s AS (SELECT conv_id, topic, sum(conf) / sum(sum(conf)) OVER (PARTITION BY conv_id) AS share FROM v GROUP BY conv_id, topic) SELECT conv_id, topic, round(share, 6) AS share FROM s WHERE share >= 0.3""")
sql("d39_cluster_quality", """WITH e AS (SELECT label, posexplode(embedding) AS (i, x) FROM {embeddings}), n AS (SELECT label, count(*) AS n FROM {embeddings} GROUP BY label), s AS (SELECT label, i, sum(CAST(x AS DOUBLE)) AS t FROM e GROUP BY label, i)
       SELECT n.label, n.n, round((sum(t * t) - n.n) / (n.n * (n.n - 1)), 5) AS mean_similarity FROM s JOIN n ON s.label = n.label GROUP BY n.label, n.n""",
    """WITH e AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM embeddings), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), s AS (SELECT label, i, sum(x::DOUBLE) AS t FROM e GROUP BY label, i)
       SELECT n.label, n.n, round((sum(t * t) - n.n) / (n.n * (n.n - 1)), 5) AS mean_similarity FROM s JOIN n ON s.label = n.label GROUP BY n.label, n.n""")
sql("d50_repetition", """WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) AS r FROM {conversations} WHERE length(text) >= 10) SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE r > 1) AS repeated FROM t GROUP BY conv_id""")


@query("d44_tf_idf_top", r"""WITH l AS (SELECT doc_id AS d, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), w AS (SELECT d, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS t FROM l),
            c AS (SELECT d, t, count(*) AS tf FROM w GROUP BY d, t), n AS (SELECT count(DISTINCT d) AS n FROM w), f AS (SELECT t, count(*) AS df FROM c GROUP BY t),
            x AS (SELECT d, c.t, tf * (ln((1 + n) / (1.0 + df)) + 1) AS x FROM c JOIN f ON f.t = c.t CROSS JOIN n), m AS (SELECT d, sqrt(sum(x * x)) AS m FROM x GROUP BY d),
            s AS (SELECT a.d, b.d AS other, sum(a.x * b.x) / min(ma.m) / min(mb.m) AS cos FROM x a JOIN x b ON a.t = b.t AND a.d <> b.d JOIN m ma ON ma.d = a.d JOIN m mb ON mb.d = b.d WHERE a.d % 100 = 0 GROUP BY a.d, b.d)
       SELECT d, other, round(cos, 6) AS cos FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY round(cos, 9) DESC, other) AS r FROM s) WHERE r <= 3""")
def d44(spark, sf_dir):
    """The queries are the documents whose id is divisible by 100, against all documents."""
    return X.tf_idf_neighbours(table(spark, sf_dir, "documents"), "doc_id", "text", 3, F.col("doc_id") % 100 == 0).select("d", "other", F.round("cos", 6).alias("cos"))


@query("d41_sentence_chunks")
def d41(spark, sf_dir):
    return X.sentence_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("d54_lpt_partition")
def d54(spark, sf_dir):
    return B.lpt(table(spark, sf_dir, "part"), "p_partkey", "p_retailprice", 8)


@query("d37_leader_clusters")
def d37(spark, sf_dir):
    return X.leader_clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
