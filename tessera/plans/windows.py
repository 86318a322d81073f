"""Window functions."""

from tessera.registry import sql

_DAILY = "WITH d AS (SELECT CAST(ts AS DATE) AS d, event_type AS k, count(*) AS n, round(avg(value), 2) AS v FROM {events} GROUP BY 1, 2)"
sql("w01_change_flag", "SELECT event_id, NOT (struct(event_type, value > 50) <=> lag(struct(event_type, value > 50)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS changed FROM {events}",
    "SELECT event_id, (event_type IS DISTINCT FROM lag(event_type) OVER w) OR ((value > 50) IS DISTINCT FROM lag(value > 50) OVER w) AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
sql("w02_island_ids", "SELECT event_id, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS f FROM {events})")
sql("w05_running_total", _DAILY + " SELECT d, k, CAST(sum(n) OVER (PARTITION BY k ORDER BY d ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM d")
sql("w06_z_score", _DAILY + """, s AS (SELECT d, k, v, round(avg(v) OVER (PARTITION BY k), 2) AS m, round(stddev_samp(v) OVER (PARTITION BY k), 2) AS sd FROM d)
       SELECT d, k, m, sd, round((v - m) / nullif(sd, 0), 2) AS z, CASE WHEN (v - m) / nullif(sd, 0) > 2 THEN 'anomaly' WHEN (v - m) / nullif(sd, 0) > 1 THEN 'degraded' ELSE 'ok' END AS label FROM s""")
sql("w07_last_seven_rows", _DAILY + """ SELECT d, k, count(CASE WHEN v > 50 THEN 1 END) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS hits FROM d""")
sql("w08_trailing_exclusive", _DAILY + """ SELECT d, k, round(avg(v) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS prev3 FROM d""")
sql("w09_range_seven_days", _DAILY + """ SELECT d, k, round(avg(v) OVER (PARTITION BY k ORDER BY d RANGE BETWEEN INTERVAL '6' DAY PRECEDING AND CURRENT ROW), 6) AS avg7 FROM d""")
sql("w10_day_over_day", _DAILY + """ SELECT d, k, round(100 * (v - lag(v) OVER (PARTITION BY k ORDER BY d)) / nullif(lag(v) OVER (PARTITION BY k ORDER BY d), 0), 4) AS pct FROM d""")
sql("w11_regression_sigma",
    """WITH v AS (SELECT event_type AS k, CAST(day(ts) AS INT) % 5 AS version, avg(value) AS m, stddev_samp(value) AS sd, count(*) AS runs FROM {events} GROUP BY 1, 2), l AS (SELECT *, lag(m) OVER (PARTITION BY k ORDER BY version) AS pm, lag(sd) OVER (PARTITION BY k ORDER BY version) AS psd FROM v)
       SELECT k, version, round((m - pm) / nullif(psd, 0), 4) AS sigma, CASE WHEN runs < 3 THEN 'calibrating' WHEN (m - pm) / nullif(psd, 0) > 2 THEN 'regression' WHEN (m - pm) / nullif(psd, 0) > 1 THEN 'slower' WHEN (m - pm) / nullif(psd, 0) < -1 THEN 'faster' ELSE 'stable' END AS label FROM l WHERE pm IS NOT NULL""")
sql("w13_share_and_critical", """SELECT event_type, round(100 * avg(value) / sum(avg(value)) OVER (), 4) AS pct, avg(value) = max(avg(value)) OVER () AS critical FROM {events} GROUP BY event_type""")
sql("w14_latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {events}) WHERE r = 1")
sql("w15_dedup_by_key", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM {orders}) WHERE r = 1")
sql("w16_top_k_per_key", "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM {customer}) WHERE r <= 5")
sql("w23_volume_ratio", _DAILY + " SELECT d, k, round(n / avg(n) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS ratio FROM d")
sql("w25_drawdown", _DAILY + ", p AS (SELECT d, k, v, max(v) OVER (PARTITION BY k ORDER BY d ROWS UNBOUNDED PRECEDING) AS peak FROM d) SELECT d, k, round(peak - v, 4) AS drawdown, round(max(peak - v) OVER (PARTITION BY k), 4) AS deepest FROM p")
sql("w27_next_number", "SELECT conv_id, max(turn) + 1 AS next_turn FROM {conversations} GROUP BY conv_id")
sql("w28_rankings", "SELECT c_custkey, rank() OVER w AS rnk, dense_rank() OVER w AS dense, CAST(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS BIGINT) AS quarter, first_value(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS lowest FROM {customer} WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_nationkey)")
