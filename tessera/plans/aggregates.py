"""Aggregations."""

from tessera.registry import sql

sql("a01_sales_by_month", """SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, o_orderpriority, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM {orders} GROUP BY 1, 2, 3""")
sql("a02_count_distinct_days", "SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS days FROM {events} WHERE event_type = 'view' GROUP BY user_id")
sql("a03_counts_ordered", "SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type ORDER BY n DESC, event_type")
sql("a04_ordered_array", "SELECT user_id, array_sort(collect_set(event_type)) AS kinds FROM {events} GROUP BY user_id", "SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY user_id")
sql("a05_group_by_array", """SELECT array_join(kinds, ',') AS kinds, count(*) AS users FROM (SELECT user_id, array_sort(collect_set(event_type)) AS kinds FROM {events} GROUP BY user_id) GROUP BY kinds""",
    "SELECT array_to_string(kinds, ',') AS kinds, count(*) AS users FROM (SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY user_id) GROUP BY kinds")
sql("a06_relational_division", "SELECT user_id FROM {events} WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY user_id HAVING count(DISTINCT event_type) = 3")
sql("a07_filtered_counts", """SELECT CAST(ts AS DATE) AS d, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS buyers FROM {events} GROUP BY CAST(ts AS DATE)""")
sql("a08_distinct_filtered_guarded", """SELECT user_id, count(DISTINCT CAST(ts AS DATE)) FILTER (WHERE event_type = 'click') AS click_days FROM {events} GROUP BY user_id HAVING count(DISTINCT event_type) >= 3""")
sql("a09_percentiles_with_total",
    """WITH s AS (SELECT event_type AS step, percentile_cont(0.25) WITHIN GROUP (ORDER BY value) AS p25, percentile_cont(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_cont(0.99) WITHIN GROUP (ORDER BY value) AS p99 FROM {events} GROUP BY event_type
       UNION ALL SELECT 'TOTAL', percentile_cont(0.25) WITHIN GROUP (ORDER BY value), percentile_cont(0.5) WITHIN GROUP (ORDER BY value), percentile_cont(0.99) WITHIN GROUP (ORDER BY value) FROM {events})
       SELECT step, round(p25, 4) AS p25, round(p50, 4) AS p50, round(p99, 4) AS p99, round(100 * p50 / max(p50) OVER (), 4) AS pct_of_max FROM s""")
sql("a10_partial_rollup",
    """SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total, CAST(grouping(o_orderpriority) AS INT) AS is_total,
              round(100 * sum(o_totalprice) / (sum(CASE WHEN grouping(o_orderpriority) = 0 THEN sum(o_totalprice) END) OVER ()), 4) AS pct FROM {orders} GROUP BY o_orderstatus, ROLLUP (o_orderpriority)""")
sql("a11_share_of_count", "SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM {events} GROUP BY event_type")
sql("a12_string_agg", "SELECT user_id, array_join(array_sort(collect_set(event_type)), ', ') AS kinds FROM {events} GROUP BY user_id", "SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
sql("a13_json_agg", "SELECT o_custkey, to_json(array_sort(collect_set(o_orderpriority))) AS j FROM {orders} GROUP BY o_custkey", "SELECT o_custkey, to_json(list_sort(list(DISTINCT o_orderpriority)))::VARCHAR AS j FROM orders GROUP BY o_custkey")
sql("a14_bool_aggs", "SELECT l_orderkey, bool_and(l_discount < 0.05) AS all_small, bool_or(l_returnflag = 'R') AS any_returned FROM {lineitem} GROUP BY l_orderkey")
sql("a15_stddev", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM {events} GROUP BY event_type")
sql("a16_pairwise_corr",
    """WITH d AS (SELECT CAST(ts AS DATE) AS d, event_type AS k, avg(value) AS v FROM {events} GROUP BY 1, 2)
       SELECT a.k AS a, b.k AS b, count(*) AS n, round(corr(a.v, b.v), 6) AS r, CASE WHEN corr(a.v, b.v) > 0.8 THEN 'strong' WHEN corr(a.v, b.v) > 0.5 THEN 'moderate' WHEN corr(a.v, b.v) < -0.5 THEN 'negative' ELSE 'weak' END AS label
       FROM d a JOIN d b ON a.d = b.d AND a.k < b.k GROUP BY a.k, b.k HAVING count(*) >= 5""")
sql("a17_percentile_filter", "SELECT user_id, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value) FILTER (WHERE event_type = 'view'), 6) AS p50 FROM {events} GROUP BY user_id")
sql("a18_two_level_rollup",
    """WITH c AS (SELECT concat(event_type, '_chunk_', CAST(user_id % 3 AS STRING)) AS task, avg(value) AS mean, sum(value) AS total, bool_or(value > 90) AS slow FROM {events} GROUP BY 1)
       SELECT regexp_replace(task, '_chunk_[0-9]+$', '') AS logical, round(max(mean), 6) AS max_mean, round(sum(total), 4) AS total, bool_or(slow) AS slow FROM c GROUP BY 1""",
    """WITH c AS (SELECT event_type || '_chunk_' || (user_id % 3) AS task, avg(value) AS mean, sum(value) AS total, bool_or(value > 90) AS slow FROM events GROUP BY 1)
       SELECT regexp_replace(task, '_chunk_[0-9]+$', '') AS logical, round(max(mean), 6) AS max_mean, round(sum(total), 4) AS total, bool_or(slow) AS slow FROM c GROUP BY 1""")
sql("a19_profile_metrics", "SELECT 'rows' AS metric, count(*) AS n FROM {events} UNION ALL SELECT 'users', count(DISTINCT user_id) FROM {events} UNION ALL SELECT 'types', count(DISTINCT event_type) FROM {events}")
sql("a20_multiplicity_histogram", "SELECT CASE WHEN k = 1 THEN '1' WHEN k = 2 THEN '2' ELSE '3+' END AS sets, count(*) AS elements FROM (SELECT l_partkey, count(DISTINCT l_returnflag) AS k FROM {lineitem} GROUP BY l_partkey) GROUP BY 1")
sql("a21_multi_agg", "SELECT event_type, round(sum(value), 4) AS total, round(median(value), 6) AS median, count(*) AS n FROM {events} GROUP BY event_type")
sql("a22_count_by_month", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM {orders} GROUP BY 1")
sql("a23_gap_filled_pivot",
    """WITH m AS (SELECT explode(sequence(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 MONTH)) AS month), c AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority AS p, count(*) AS n FROM {orders} GROUP BY 1, 2)
       SELECT m.month, coalesce(sum(CASE WHEN p LIKE '1%' THEN n END), 0) AS urgent, coalesce(sum(CASE WHEN p LIKE '5%' THEN n END), 0) AS low FROM m LEFT JOIN c ON m.month = c.month GROUP BY m.month""",
    """WITH m AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 MONTH)) AS DATE) AS month), c AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2)
       SELECT m.month, coalesce(sum(CASE WHEN p LIKE '1%' THEN n END), 0)::BIGINT AS urgent, coalesce(sum(CASE WHEN p LIKE '5%' THEN n END), 0)::BIGINT AS low FROM m LEFT JOIN c ON m.month = c.month GROUP BY m.month""")
sql("a24_row_share", "SELECT d, event_type, round(100.0 * n / CASE WHEN sum(n) OVER (PARTITION BY d) = 0 THEN 1 ELSE sum(n) OVER (PARTITION BY d) END, 4) AS pct FROM (SELECT CAST(ts AS DATE) AS d, event_type, count(*) AS n FROM {events} GROUP BY 1, 2)")
sql("a25_cumulative_share_cut",
    """WITH c AS (SELECT source, count(*) AS n FROM {documents} GROUP BY source), r AS (SELECT source, n, sum(n) OVER (ORDER BY n DESC, source ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER () AS total FROM c)
       SELECT CASE WHEN cum - n < 0.5 * total THEN source ELSE 'other' END AS bucket, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
sql("a26_transitions", """SELECT before, now, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_type AS now FROM {events}) WHERE before IS NOT NULL GROUP BY before, now""")
sql("a27_argmax_label", "SELECT user_id, event_type AS label FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM {events} GROUP BY user_id, event_type) WHERE r = 1")
sql("a28_describe", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS lo, round(percentile_cont(0.75) WITHIN GROUP (ORDER BY value), 6) AS p75, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value), 6) AS p95, round(max(value), 6) AS hi FROM {events} GROUP BY event_type ORDER BY 6")
sql("a29_count_by_nation", "SELECT n_name, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name")
sql("a30_inverted_index", "SELECT event_type, array_sort(collect_set(user_id)) AS users FROM {events} GROUP BY event_type", "SELECT event_type, list_sort(list(DISTINCT user_id)) AS users FROM events GROUP BY event_type")
sql("a31_trade_stats", """SELECT user_id, count(*) AS trades, round(100.0 * count(*) FILTER (WHERE value > 50) / count(*), 4) AS win_rate, round(avg(value - 50) FILTER (WHERE value > 50), 6) AS avg_win, round(avg(value - 50) FILTER (WHERE value <= 50), 6) AS avg_loss, round(sum(value - 50), 4) AS total FROM {events} GROUP BY user_id""")
sql("a32_corpus_stats",
    r"""WITH t AS (SELECT CAST(size(split(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ')), ' ')) * 0.75 AS DOUBLE) AS tok FROM {documents}), f AS (SELECT floor(tok) AS tok FROM t)
        SELECT count(*) AS n, CAST(sum(tok) AS BIGINT) AS total, CAST(min(tok) AS BIGINT) AS lo, CAST(max(tok) AS BIGINT) AS hi, round(avg(tok), 4) AS mean, round(median(tok), 4) AS mid, round(stddev_samp(tok), 4) AS sd, round(100.0 * count(*) FILTER (WHERE tok > 200) / count(*), 4) AS big_pct FROM f""",
    r"""WITH t AS (SELECT len(string_split(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' ')) * 0.75::DOUBLE AS tok FROM documents), f AS (SELECT floor(tok) AS tok FROM t)
        SELECT count(*) AS n, CAST(sum(tok) AS BIGINT) AS total, CAST(min(tok) AS BIGINT) AS lo, CAST(max(tok) AS BIGINT) AS hi, round(avg(tok), 4) AS mean, round(median(tok), 4) AS mid, round(stddev_samp(tok), 4) AS sd, round(100.0 * count(*) FILTER (WHERE tok > 200) / count(*), 4) AS big_pct FROM f""")
sql("a33_array_min_avg", "SELECT user_id, round(array_min(filter(v, x -> x IS NOT NULL)), 6) AS lo, round(aggregate(filter(v, x -> x IS NOT NULL), CAST(0 AS DOUBLE), (s, x) -> s + x) / size(filter(v, x -> x IS NOT NULL)), 4) AS mean FROM (SELECT user_id, collect_list(value) AS v FROM {events} GROUP BY user_id)",
    "SELECT user_id, round(list_min(v), 6) AS lo, round(list_avg(v), 4) AS mean FROM (SELECT user_id, list(value) FILTER (value IS NOT NULL) AS v FROM events GROUP BY user_id)")
sql("a34_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("a35_late_fees", "SELECT l_orderkey, round(sum(greatest(datediff(CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE)) - 60, 0) * 0.5), 2) AS fee FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY l_orderkey",
    "SELECT l_orderkey, round(sum(greatest(date_diff('day', o_orderdate::DATE, l_shipdate::DATE) - 60, 0) * 0.5), 2) AS fee FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey")
sql("a36_run_throughput", """SELECT CAST(ts AS DATE) AS run, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) AS n, round(sum(value) / 60, 4) AS cpu_min, round((unix_timestamp(max(ts)) - unix_timestamp(min(ts))) / 60, 4) AS wall_min FROM {events} GROUP BY 1""",
    "SELECT CAST(ts AS DATE) AS run, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) AS n, round(sum(value) / 60, 4) AS cpu_min, round((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 60, 4) AS wall_min FROM events GROUP BY 1")
sql("a37_error_taxonomy", "SELECT user_id, count(*) AS failures, count(DISTINCT CAST(ts AS DATE)) AS days, max(ts) AS last_at, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM {events} WHERE event_type = 'error' GROUP BY user_id")
sql("a38_gap_percentiles", """WITH g AS (SELECT user_id, CAST(unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(CAST(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS TIMESTAMP)) AS DOUBLE) / 1e6 AS gap FROM {events})
       SELECT user_id, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY gap), 4) AS p50, round(percentile_cont(0.999999) WITHIN GROUP (ORDER BY gap), 4) AS top FROM g WHERE gap IS NOT NULL GROUP BY user_id""",
    """WITH g AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)))::DOUBLE / 1e6 AS gap FROM events)
       SELECT user_id, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY gap), 4) AS p50, round(percentile_cont(0.999999) WITHIN GROUP (ORDER BY gap), 4) AS top FROM g WHERE gap IS NOT NULL GROUP BY user_id""")
