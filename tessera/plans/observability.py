"""Marts over task executions. Tasks are event types, runs are days, durations are values, failures are 'error' events, attempts follow from the id."""

from tessera.registry import sql

#: The one mapping from events to executions that all marts here share.
EXEC = """x AS (SELECT event_id, event_type AS task, CAST(ts AS DATE) AS run_date, ts, user_id AS run_id, value AS ms, event_id % 11 = 0 AS failed, CAST(1 + event_id % 3 AS INT) AS attempt FROM {events})"""

sql("d07_health_score",
    f"""WITH {EXEC}, s AS (SELECT task, count(*) AS n, 100.0 * count(*) FILTER (WHERE NOT failed) / count(*) AS ok, 100.0 * count(*) FILTER (WHERE attempt > 1) / count(*) AS retry, percentile_cont(0.5) WITHIN GROUP (ORDER BY ms) AS p50, stddev_samp(ms) AS sd FROM x GROUP BY task),
         h AS (SELECT task, n, round((0.6 * ok + 0.2 * (100 - retry) + CASE WHEN coalesce(sd, 0) > 0.5 * p50 THEN 100 * 0.2 / (1 + (sd - 0.5 * p50) / nullif(p50, 0)) ELSE 20 END) * CASE WHEN n < 10 THEN n / 10.0 ELSE 1 END, 2) AS score FROM s)
        SELECT task, n, score, CASE WHEN n < 10 THEN 'calibrating' WHEN score >= 95 THEN 'healthy' WHEN score >= 70 THEN 'warning' ELSE 'critical' END AS label FROM h""")
sql("d08_sla_breaches",
    f"""WITH {EXEC}, l AS (SELECT task, CASE WHEN task = 'view' THEN 50.0 ELSE percentile_cont(0.95) WITHIN GROUP (ORDER BY ms) FILTER (WHERE NOT failed) END AS lim FROM x GROUP BY task)
        SELECT event_id, round((ms / lim - 1) * 100, 4) AS breach_pct, CASE WHEN ms > 2 * lim THEN 'severe' WHEN ms > 1.5 * lim THEN 'high' ELSE 'breach' END AS band FROM x JOIN l ON x.task = l.task WHERE ms > lim""")
sql("d09_retry_waste", f"""WITH {EXEC}, c AS (SELECT task, avg(ms) AS clean FROM x WHERE attempt = 1 AND NOT failed GROUP BY task) SELECT x.task, round(sum((attempt - 1) * coalesce(clean, ms)), 4) AS wasted FROM x LEFT JOIN c ON x.task = c.task GROUP BY x.task""")
sql("d10_wave_efficiency", f"""WITH {EXEC} SELECT run_date, CAST(attempt AS INT) AS wave, count(*) AS n, round(100 * max(ms) / sum(ms), 6) AS parallelism FROM x GROUP BY run_date, attempt HAVING count(*) > 1""")
sql("d11_volume_anomaly",
    f"""WITH {EXEC}, d AS (SELECT run_date, task, count(*) AS n FROM x GROUP BY run_date, task), z AS (SELECT *, (n - avg(n) OVER (PARTITION BY task)) / nullif(stddev_samp(n) OVER (PARTITION BY task), 0) AS z FROM d)
        SELECT run_date, task, n, round(z, 4) AS z, CASE WHEN abs(z) > 3 THEN '3s' WHEN abs(z) > 2 THEN '2s' ELSE 'ok' END AS label FROM z""")
sql("d12_schedule_adherence",
    f"""WITH {EXEC}, r AS (SELECT run_date, task, min(ts) AS started FROM x GROUP BY run_date, task)
        SELECT run_date, task, CASE WHEN started <= CAST(run_date AS TIMESTAMP) + INTERVAL '5' MINUTE THEN 'on_time' WHEN started <= CAST(run_date AS TIMESTAMP) + INTERVAL '30' MINUTE THEN 'late' ELSE 'critical' END AS band FROM r""")
sql("d13_handoff",
    f"""WITH {EXEC}, last AS (SELECT task, max(run_date) AS last_run FROM x GROUP BY task), f AS (SELECT task, count(*) AS failures FROM x WHERE failed AND run_date >= DATE '2024-01-24' GROUP BY task), s AS (SELECT task, max(ms) AS slowest FROM x WHERE run_date >= DATE '2024-01-24' GROUP BY task)
        SELECT last.task, last_run, coalesce(failures, 0) AS failures, round(slowest, 4) AS slowest FROM last LEFT JOIN f ON f.task = last.task LEFT JOIN s ON s.task = last.task""")
sql("d14_weekly_reliability",
    f"""WITH {EXEC}, w AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, task, 100.0 * count(*) FILTER (WHERE NOT failed) / count(*) AS ok FROM x GROUP BY 1, 2)
        SELECT week, task, round(ok, 4) AS ok, round(avg(ok) OVER (PARTITION BY task ORDER BY week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS before, CASE WHEN ok >= 99 THEN 'a' WHEN ok >= 95 THEN 'b' WHEN ok >= 85 THEN 'c' ELSE 'd' END AS band FROM w""")
sql("d15_monthly_sla",
    f"""WITH {EXEC}, l AS (SELECT task, percentile_cont(0.95) WITHIN GROUP (ORDER BY ms) AS lim FROM x GROUP BY task), m AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, x.task, count(*) AS n, 100.0 * count(*) FILTER (WHERE NOT failed) / count(*) AS ok, 100.0 * count(*) FILTER (WHERE ms <= lim) / count(*) AS in_sla FROM x JOIN l ON l.task = x.task GROUP BY 1, 2)
        SELECT month, task, round(ok, 4) AS ok, round(in_sla, 4) AS in_sla, CASE WHEN ok >= 99.5 AND in_sla >= 95 THEN 'met' WHEN ok >= 97 AND in_sla >= 80 THEN 'partial' ELSE 'missed' END AS label FROM m WHERE n >= 10""")
sql("d16_version_impact",
    f"""WITH {EXEC}, v AS (SELECT task, CAST(day(run_date) AS INT) % 6 AS version, 100.0 * count(*) FILTER (WHERE NOT failed) / count(*) AS ok, avg(ms) AS m FROM x GROUP BY 1, 2), l AS (SELECT *, lag(ok) OVER (PARTITION BY task ORDER BY version) AS pok, lag(m) OVER (PARTITION BY task ORDER BY version) AS pm FROM v)
        SELECT task, version, round(ok - pok, 4) AS d_ok, round(m / nullif(pm, 0), 6) AS ratio, CASE WHEN pok IS NULL THEN 'first' WHEN ok - pok < -5 THEN 'less_reliable' WHEN m / nullif(pm, 0) > 1.2 THEN 'slower' WHEN m / nullif(pm, 0) < 0.8 THEN 'faster' ELSE 'neutral' END AS verdict FROM l""")
sql("d17_health_calendar", f"""WITH {EXEC} SELECT task, run_date, bool_and(NOT failed) AS healthy FROM x GROUP BY task, run_date""")
sql("d18_anomaly_feed", f"""WITH {EXEC}, s AS (SELECT *, avg(ms) OVER (PARTITION BY task) AS m, stddev_samp(ms) OVER (PARTITION BY task) AS sd FROM x) SELECT event_id, 'slow' AS kind FROM s WHERE ms > m + 1.5 * sd UNION ALL SELECT event_id, 'failed' FROM x WHERE failed""")
sql("d19_alerts_with_cooldown",
    f"""WITH {EXEC}, d AS (SELECT task, run_date, 100.0 * count(*) FILTER (WHERE failed) / count(*) AS bad FROM x GROUP BY task, run_date), a AS (SELECT task, run_date, bad FROM d WHERE bad > 9)
        SELECT task, run_date, round(bad, 4) AS bad FROM (SELECT *, lag(run_date) OVER (PARTITION BY task ORDER BY run_date) AS before FROM a) WHERE before IS NULL OR before < run_date - INTERVAL '1' DAY""")
sql("d20_peak_parallelism",
    """WITH s AS (SELECT user_id, CAST(ts AS DATE) AS d, min(ts) AS a, max(ts) AS b FROM {events} GROUP BY 1, 2), p AS (SELECT d, a AS t, 1 AS x FROM s WHERE a < b UNION ALL SELECT d, b, -1 FROM s WHERE a < b),
            r AS (SELECT d, sum(x) OVER (PARTITION BY d ORDER BY t RANGE UNBOUNDED PRECEDING) AS depth FROM p) SELECT d, CAST(max(depth) AS BIGINT) AS peak FROM r GROUP BY d""")
sql("w12_version_deltas", f"""WITH {EXEC}, v AS (SELECT task, CAST(day(run_date) AS INT) % 6 AS version, avg(ms) AS m, count(*) AS n, max(ms) AS top FROM x GROUP BY 1, 2)
        SELECT task, version, round(m - lag(m) OVER w, 6) AS d_mean, n - lag(n) OVER w AS d_n, round(top - lag(top) OVER w, 6) AS d_top FROM v WINDOW w AS (PARTITION BY task ORDER BY version)""")
sql("g12_incident_classes",
    f"""WITH {EXEC}, d AS (SELECT run_date, task, avg(ms) AS v FROM x GROUP BY 1, 2), z AS (SELECT *, (v - avg(v) OVER (PARTITION BY task)) / nullif(stddev_samp(v) OVER (PARTITION BY task), 0) AS z FROM d),
             l AS (SELECT z.*, CASE task WHEN 'signup' THEN 0 WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS level FROM z WHERE z > 1)
        SELECT run_date, count(*) AS tasks, CASE WHEN count(DISTINCT level) <= 1 THEN 'INFRASTRUCTURE' WHEN max(level) - min(level) + 1 = count(DISTINCT level) THEN 'CASCADE' ELSE 'MIXED' END AS class FROM l GROUP BY run_date HAVING count(*) >= 2""")
sql("g13_upstream_blame", f"""WITH {EXEC}, e AS (SELECT * FROM (VALUES ('click', 'view'), ('purchase', 'click'), ('error', 'signup')) AS t(task, dep)), f AS (SELECT DISTINCT run_date, task FROM x WHERE failed)
        SELECT e.dep, count(*) AS blamed FROM f JOIN e ON e.task = f.task WHERE EXISTS (SELECT 1 FROM f g WHERE g.run_date = f.run_date AND g.task = e.dep) GROUP BY e.dep""")
sql("g18_critical_share", f"""WITH {EXEC} SELECT run_date, task, round(sum(ms) / sum(sum(ms)) OVER (PARTITION BY run_date), 6) AS share, sum(ms) = max(sum(ms)) OVER (PARTITION BY run_date) AS critical FROM x GROUP BY run_date, task""")
sql("d60_strategy_comparison", f"""WITH {EXEC}, a AS (SELECT task, avg(ms) AS m FROM x WHERE attempt = 1 GROUP BY task), b AS (SELECT task, avg(ms) AS m FROM x WHERE attempt = 2 GROUP BY task)
        SELECT coalesce(a.task, b.task) AS task, round(a.m / nullif(b.m, 0), 6) AS speedup, round(100 * (a.m - b.m) / nullif(a.m, 0), 6) AS pct FROM a FULL OUTER JOIN b ON a.task = b.task""")
sql("d61_scaling_table", f"""WITH {EXEC}, s AS (SELECT CAST(1 + event_id % 8 AS INT) AS workers, avg(ms) AS t FROM x GROUP BY 1) SELECT workers, round(first_value(t) OVER (ORDER BY workers) / t, 6) AS speedup, round(first_value(t) OVER (ORDER BY workers) / t / workers * 100, 6) AS efficiency FROM s""")
# Who gets an item: in turn, by a hash of its key, by ranges of its key, the shard with the most room by quota, one of two that the last digit
# steals from, at most ten a minute and worker (others wait), and the last hundred of a bounded queue (older ones drop).
sql("d62_routing", """WITH n AS (SELECT event_id, user_id, ts, value, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS i, row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id % 4, date_trunc('minute', ts) ORDER BY ts, event_id) AS m, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS back FROM {events}),
            r AS (SELECT 'round robin' AS strategy, i % 4 AS worker, value FROM n UNION ALL SELECT 'sharded', user_id % 4, value FROM n UNION ALL SELECT 'ranges', least(3, CAST(floor(value / 25) AS BIGINT)), value FROM n
                  UNION ALL SELECT 'stealing', CASE WHEN user_id % 4 = 3 AND event_id % 10 < 5 THEN event_id % 3 ELSE user_id % 4 END, value FROM n UNION ALL SELECT 'throttled', CASE WHEN m <= 10 THEN user_id % 4 ELSE -1 END, value FROM n UNION ALL SELECT 'drop oldest', CASE WHEN back <= 100 THEN i % 4 ELSE -1 END, value FROM n)
       SELECT strategy, worker, count(*) AS n, round(sum(value), 4) AS load, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY strategy), 6) AS share FROM r GROUP BY strategy, worker""")
