"""Scans, projections and predicates."""

from tessera.registry import sql

sql("s01_scan_count", "SELECT count(*) AS n FROM {lineitem}")
sql("s04_generated_sales",
    """SELECT id AS sale_id, id % 1000 AS customer_id, CAST(id % 50 AS INT) AS product_id, CAST(id % 10 AS INT) AS region_id,
              date_add(DATE '2024-01-01', CAST(id % 365 AS INT)) AS sale_date,
              CAST(month(date_add(DATE '2024-01-01', CAST(id % 365 AS INT))) AS INT) AS month FROM range(5000)""",
    """SELECT range AS sale_id, range % 1000 AS customer_id, CAST(range % 50 AS INT) AS product_id, CAST(range % 10 AS INT) AS region_id,
              DATE '2024-01-01' + CAST(range % 365 AS INT) AS sale_date,
              CAST(month(DATE '2024-01-01' + CAST(range % 365 AS INT)) AS INT) AS month FROM range(5000)""")
sql("s05_region_labels",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'north' WHEN 1 THEN 'south' WHEN 2 THEN 'east' ELSE 'west' END AS label FROM {orders}""")
sql("s08_strip_nul", r"""SELECT doc_id, translate(concat(lang, chr(0), source), chr(0), '') AS cleaned FROM {documents}""",
    "SELECT doc_id, replace(lang || chr(0) || source, chr(0), '') AS cleaned FROM documents")
sql("s10_drop_duplicates_keep_first",
    """SELECT c_nationkey, c_mktsegment, min(c_custkey) AS c_custkey, min_by(c_name, c_custkey) AS c_name FROM {customer} GROUP BY c_nationkey, c_mktsegment""")
sql("s17_html_cells",
    r"""SELECT page_id, pos AS cell, trim(regexp_replace(c, '<[^>]*>', '')) AS text
        FROM {pages} LATERAL VIEW posexplode(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1)) AS pos, c""",
    r"""SELECT page_id, i::INT AS cell, trim(regexp_replace(x[i + 1], '<[^>]*>', '', 'g')) AS text
        FROM (SELECT page_id, regexp_extract_all(html, '<p[^>]*>(.*?)</p>', 1, 's') AS x FROM pages), LATERAL (SELECT unnest(range(len(x))) AS i)""")
sql("s19_log_json", """SELECT event_id, event_type AS appname, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events} WHERE get_json_object(props, '$.k') IS NOT NULL""",
    "SELECT event_id, event_type AS appname, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
sql("s19_quarantine_counts", """SELECT event_type, count(*) AS n, count_if(get_json_object(props, '$.k') IS NULL) AS invalid FROM {events} GROUP BY event_type""",
    "SELECT event_type, count(*) AS n, count(*) FILTER (json_extract_string(props, '$.k') IS NULL) AS invalid FROM events GROUP BY event_type")
sql("s22_last_rows", "SELECT o_orderkey, o_orderdate, o_totalprice FROM {orders} ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
sql("s23_decimated", "SELECT event_id, ts, value FROM {events} WHERE event_id % 10 = 0")
sql("s26_word_count",
    r"""SELECT word, count(*) AS n FROM (SELECT explode(split(text, '[ \\t\\n\\x0B\\f\\r]+')) AS word FROM {documents}) WHERE word <> '' GROUP BY word""",
    r"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+')) AS word FROM documents) WHERE word <> '' GROUP BY word""")
sql("s27_words_per_document", r"""SELECT doc_id, CAST(size(regexp_extract_all(text, '[A-Za-z0-9_]+', 0)) AS BIGINT) AS words FROM {documents}""",
    "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+'))::BIGINT AS words FROM documents")

sql("p01_null_safe_inequality",
    """SELECT a.c_custkey FROM {customer} a JOIN {customer} b ON a.c_custkey = b.c_custkey + 1
       WHERE NOT (struct(a.c_mktsegment, a.c_nationkey) <=> struct(b.c_mktsegment, b.c_nationkey))""",
    """SELECT a.c_custkey FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey + 1
       WHERE a.c_mktsegment IS DISTINCT FROM b.c_mktsegment OR a.c_nationkey IS DISTINCT FROM b.c_nationkey""")
sql("p03_pruned_filter_count", "SELECT count(*) AS n FROM {lineitem} WHERE l_shipdate >= TIMESTAMP '1996-06-01' AND l_shipdate < TIMESTAMP '1996-07-01'")
sql("p04_segment_recode", """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'premium' WHEN 'MACHINERY' THEN 'standard' ELSE 'trial' END AS tier FROM {customer}""")
sql("p05_engagement_bucket",
    """SELECT user_id, days, CASE WHEN days >= 25 THEN 'power' WHEN days >= 14 THEN 'high' WHEN days >= 7 THEN 'medium' WHEN days >= 1 THEN 'low' ELSE 'none' END AS bucket
       FROM (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS days FROM {events} GROUP BY user_id)""")
sql("p06_json_path_equality", "SELECT event_id FROM {events} WHERE get_json_object(props, '$.k') = '5'", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '5'")
sql("p07_array_containment",
    """SELECT user_id FROM (SELECT user_id, collect_set(event_type) AS kinds FROM {events} GROUP BY user_id) WHERE size(array_except(array('purchase', 'signup'), kinds)) = 0""",
    "SELECT user_id FROM (SELECT user_id, list(DISTINCT event_type) AS kinds FROM events GROUP BY user_id) WHERE list_has_all(kinds, ['purchase', 'signup'])")
sql("p08_array_membership", """SELECT user_id FROM (SELECT user_id, collect_set(event_type) AS kinds FROM {events} GROUP BY user_id) WHERE array_contains(kinds, 'error')""",
    "SELECT user_id FROM (SELECT user_id, list(DISTINCT event_type) AS kinds FROM events GROUP BY user_id) WHERE list_contains(kinds, 'error')")
sql("p09_regex_ignore_case", "SELECT p_partkey FROM {part} WHERE p_type RLIKE '(?i)steel|brass'", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, 'steel|brass', 'i')")
sql("p10_last_days", "SELECT event_id FROM {events} WHERE CAST(ts AS DATE) >= (SELECT date_sub(CAST(max(ts) AS DATE), 6) FROM {events})",
    "SELECT event_id FROM events WHERE CAST(ts AS DATE) >= (SELECT CAST(max(ts) AS DATE) - 6 FROM events)")
_RAW = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'soon' WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN '1999-02-30' ELSE substr(CAST(o_orderdate AS {t}), 1, 10) END AS raw, CASE WHEN o_orderkey % 17 > 0 THEN o_orderpriority END AS task FROM {orders})"
sql("p11_coerced_dates", "SELECT o_orderkey, try_cast(raw AS DATE) AS day, task FROM " + _RAW.replace("{t}", "STRING") + " WHERE try_cast(raw AS DATE) > DATE '1996-01-01' AND task IS NOT NULL",
    "SELECT o_orderkey, try_cast(raw AS DATE) AS day, task FROM " + _RAW.format(t="VARCHAR", orders="orders") + " WHERE try_cast(raw AS DATE) > DATE '1996-01-01' AND task IS NOT NULL")
sql("p12_mapping_default",
    """SELECT d.doc_id, coalesce(m.name, 'Unknown') AS language FROM {documents} d LEFT JOIN (VALUES ('en', 'English'), ('fr', 'French')) AS m(code, name) ON d.lang = m.code""")
sql("p13_role_playing_dimension",
    """SELECT s.n_name AS supplier_nation, c.n_name AS customer_nation, count(*) AS n
       FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey
       JOIN {nation} s ON s_nationkey = s.n_nationkey JOIN {nation} c ON c_nationkey = c.n_nationkey GROUP BY s.n_name, c.n_name""")
sql("p14_special_members",
    """SELECT coalesce(k.nationkey, -1) AS nationkey, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_nationkey END AS nationkey FROM {customer}) k GROUP BY coalesce(k.nationkey, -1)""")
sql("p16_wide_projection",
    """SELECT o_orderkey, concat(CAST(extract(YEAROFWEEK FROM o_orderdate) AS STRING), '-W', lpad(CAST(extract(WEEK FROM o_orderdate) AS STRING), 2, '0')) AS iso_week,
              extract(DAYOFWEEK FROM o_orderdate) IN (1, 7) AS is_weekend, last_day(CAST(o_orderdate AS DATE)) = CAST(o_orderdate AS DATE) AS is_month_end,
              CAST(datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS age_days, date_format(o_orderdate, 'yyyy-MM') AS month_label FROM {orders}""",
    """SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS iso_week, dayofweek(o_orderdate) IN (0, 6) AS is_weekend,
              last_day(o_orderdate::DATE) = o_orderdate::DATE AS is_month_end, date_diff('day', o_orderdate::DATE, DATE '2002-01-01') AS age_days,
              strftime(o_orderdate, '%Y-%m') AS month_label FROM orders""")
