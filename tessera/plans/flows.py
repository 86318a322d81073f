"""Files, reloads and streams: each query writes to a place of its own, reads it back and reports on it."""

import uuid

from pyspark.sql import functions as F

from tessera.operators.graph import _path
from tessera.registry import query, sql
from tessera.sources import files
from tessera.streaming import events as E
from tessera.tables import table


def _place(spark, name):
    return f"{_path(spark)}-{name}-{uuid.uuid4().hex[:8]}"


_SALES = "SELECT l_orderkey AS k, l_suppkey % 10 AS region_id, year(l_shipdate) AS y, month(l_shipdate) AS m, l_extendedprice AS amount FROM lineitem"


def _sales(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    return d.select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 10).alias("region_id"), F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m"), F.col("l_extendedprice").alias("amount"))


LAYOUTS = {"flat": (), "region": ("region_id",), "month": ("y", "m")}


@query("s02_layouts", f"WITH s AS ({_SALES}) SELECT layout, count(*) AS n, count(*) FILTER (m = 6) AS june, count(*) FILTER (region_id = 5) AS region5, round(sum(amount), 0) AS total FROM s CROSS JOIN (VALUES ('flat'), ('region'), ('month')) AS l(layout) GROUP BY layout")
def s02(spark, sf_dir):
    """The same rows written flat, by region and by month, and read back: all, a month, a region. The filters prune where the layout has them."""
    out = None
    for name, by in LAYOUTS.items():
        path = _place(spark, name)
        files.write_layout(_sales(spark, sf_dir), path, by)
        back = spark.read.parquet(path)
        one = back.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("m") == 6).alias("june"), F.count_if(F.col("region_id") == 5).alias("region5"), F.round(F.sum("amount"), 0).alias("total")).select(F.lit(name).alias("layout"), "*")
        out = one if out is None else out.union(one)
    return out


def _pruned(name):
    def run(spark, sf_dir):
        path = _place(spark, name)
        files.write_layout(_sales(spark, sf_dir), path, LAYOUTS[name])
        return spark.read.parquet(path).filter("m = 6 AND region_id = 5").agg(F.count(F.lit(1)).alias("n"))

    return run


for _name in LAYOUTS:
    query(f"s03_read_back_{_name}", f"SELECT count(*) AS n FROM ({_SALES}) WHERE m = 6 AND region_id = 5")(_pruned(_name))


@query("s09_staging_counts", "SELECT s_nationkey AS nation, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY s_nationkey")
def s09(spark, sf_dir):
    """Delimited files without a header into a staging table: cleaned, cast, counted."""
    raw, staging = _place(spark, "csv"), _place(spark, "staging")
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal").write.csv(raw, sep=";", header=False)
    good, _ = files.split_bad(files.read_delimited(spark, raw, ["k", "name", "nation", "balance"]), {"k": "long", "nation": "int", "balance": "double"})
    good.write.parquet(staging)
    return spark.read.parquet(staging).groupBy("nation").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("balance"), 2).alias("total"))


@query("s11_first_row_per_file", "SELECT n_regionkey AS region, n_nationkey % 2 AS half, min(n_nationkey) AS first FROM nation GROUP BY 1, 2")
def s11(spark, sf_dir):
    """A glob of files, one for each region: the first row of each key in each file."""
    path = _place(spark, "files")
    table(spark, sf_dir, "nation").write.partitionBy("n_regionkey").parquet(path)
    rows = spark.read.parquet(path).select("*", F.input_file_name().alias("file"), (F.col("n_nationkey") % 2).alias("half"))
    first = rows.groupBy("file", "half").agg(F.min("n_nationkey").alias("first"), F.first("n_regionkey").alias("region"))
    return first.groupBy("region", "half").agg(F.min("first").alias("first"))


@query("s12_mapping_sink", "SELECT s_nationkey AS from_cluster, (s_suppkey % 5)::INT AS to_cluster, count(*) AS moved FROM supplier GROUP BY 1, 2")
def s12(spark, sf_dir):
    """A table of moves as one sorted file with a header, read again."""
    path = _place(spark, "moves")
    moves = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("from_cluster"), (F.col("s_suppkey") % 5).cast("int").alias("to_cluster")).groupBy("from_cluster", "to_cluster").agg(F.count(F.lit(1)).alias("moved"))
    moves.coalesce(1).sortWithinPartitions("from_cluster", "to_cluster").write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema="from_cluster int, to_cluster int, moved long")


@query("s16_places", "SELECT 'City ' || n_nationkey AS city, n_name AS country, (n_nationkey * 37 % 120 - 60)::DOUBLE AS lat, (n_nationkey * 91 % 340 - 170)::DOUBLE AS lon FROM nation")
def s16(spark, sf_dir):
    """Lines city, country, lat, lon with spaces around the commas."""
    path = _place(spark, "places")
    n = F.col("n_nationkey")
    table(spark, sf_dir, "nation").select(F.concat_ws(" , ", F.concat(F.lit(" City "), n), "n_name", (n * 37 % 120 - 60).cast("string"), (n * 91 % 340 - 170).cast("string"))).write.text(path)
    d = files.read_delimited(spark, path, ["city", "country", "lat", "lon"], sep=",")
    return d.select(F.trim("city").alias("city"), F.trim("country").alias("country"), F.trim("lat").cast("double").alias("lat"), F.trim("lon").cast("double").alias("lon"))


@query("s20_json_and_csv_sinks", "SELECT sink, lang, count(*) AS n FROM documents CROSS JOIN (VALUES ('json'), ('csv'), ('parquet')) AS s(sink) GROUP BY sink, lang")
def s20(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    out = None
    for sink in ("json", "csv", "parquet"):
        path = _place(spark, sink)
        d.write.format(sink).save(path)
        back = spark.read.schema(d.schema).format(sink).load(path).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(F.lit(sink).alias("sink"), "lang", "n")
        out = back if out is None else out.union(back)
    return out


@query("s21_state_store", "SELECT user_id, max(event_id) AS last_event, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def s21(spark, sf_dir):
    """A table of positions that each batch of rows replaces by key (insert or replace), in three batches."""
    from tessera.operators import warehouse as W

    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("last_event"), "value")
    state = None
    for k in range(3):
        path = _place(spark, "state")
        batch = rows.filter(F.col("last_event") % 3 == k)
        new = batch if state is None else batch.unionByName(state)
        W.upsert(new.limit(0), new, ["user_id"], [F.desc("last_event")]).write.parquet(path)
        state = spark.read.parquet(path)
    return state


@query("s24_notifications", "SELECT event_id, '{\"channel\":\"dag_alerts\",\"task\":\"' || event_type || '\",\"run_id\":' || user_id || '}' AS payload FROM events WHERE event_type = 'error'")
def s24(spark, sf_dir):
    """A message for each failure, written as text lines with its id and read again."""
    path = _place(spark, "alerts")
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    e.select("event_id", F.to_json(F.struct(F.lit("dag_alerts").alias("channel"), F.col("event_type").alias("task"), F.col("user_id").alias("run_id"))).alias("payload")).write.json(path)
    return spark.read.schema("event_id long, payload string").json(path)


@query("e09_euler_from_json", "SELECT sets, list_sort(list(element)) AS elements FROM (SELECT element, string_agg(s, ',' ORDER BY s) AS sets FROM (SELECT DISTINCT p_brand AS s, p_size AS element FROM part) GROUP BY element) GROUP BY sets")
def e09(spark, sf_dir):
    """The Euler regions of a JSON document {set: [elements]}."""
    from tessera.operators import sets as S

    path = _place(spark, "sets")
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set(F.col("p_size").cast("string")).alias("v"))
    p.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_brand", "v")))).alias("value")).write.text(path)
    found = S.euler(files.read_sets(spark, path).select("set_key", F.col("element").cast("int").alias("element")))
    return found.select(F.array_join("sets", ",").alias("sets"), "elements")


_RELOADED = "WITH e AS (SELECT CAST(ts AS DATE) AS day, event_id, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-10' THEN value * 2 ELSE value END AS value FROM events WHERE NOT (CAST(ts AS DATE) = DATE '2024-01-10' AND event_id % 2 = 0)) SELECT day, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY day"


@query("u06_day_reload", _RELOADED)
def u06(spark, sf_dir):
    """All days, then one of them again, corrected, twice: only that day's partition is replaced."""
    path = _place(spark, "days")
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_id", "value")
    files.overwrite_days(e, path, "day")
    for _ in range(2):
        files.overwrite_days(e.filter("day = DATE '2024-01-10' AND event_id % 2 = 1").withColumn("value", F.col("value") * 2), path, "day")
    return spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("u15_bronze_ingest", "SELECT (user_id % 7)::INT AS run_id, count(*) AS n, max(event_id) AS last FROM events WHERE user_id % 7 <> 3 OR event_id % 2 = 0 GROUP BY 1")
def u15(spark, sf_dir):
    """Rows by run; run 3 is ingested anew with fewer rows and replaces what it left before."""
    path = _place(spark, "runs")
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 7).cast("int").alias("run_id"), "event_id")
    files.overwrite_days(e, path, "run_id")
    files.overwrite_days(e.filter("run_id = 3 AND event_id % 2 = 0"), path, "run_id")
    return spark.read.parquet(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


def _stream(spark, sf_dir, name="events", per_trigger=None):
    """A table as a stream of its files."""
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    stream = reader.parquet(f"{sf_dir}/{name}.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else stream


def _finished(spark, stream, mode, name):
    """What a stream has given once all input is read: each batch's whole result (complete) or all rows (append)."""
    path = _place(spark, name)
    if mode == "complete":
        run = stream.writeStream.outputMode("complete").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(path))
    else:
        run = stream.writeStream.outputMode("append").format("parquet").option("path", path)
    run.option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("t01_daily_state", """SELECT user_id, max(CAST(ts AS DATE)) AS last_day, count(DISTINCT CAST(ts AS DATE)) AS days, sum(DISTINCT 1::BIGINT << (31 - date_diff('day', CAST(ts AS DATE), DATE '2024-01-30')::INT))::BIGINT AS bitmap FROM events GROUP BY user_id""")
def t01(spark, sf_dir):
    """Each micro-batch of days is folded into the users' days and activity bitmaps as of 30 January."""
    stream = _stream(spark, sf_dir).select("user_id", F.to_date("ts").alias("day"))
    days = stream.groupBy("user_id").agg(F.max("day").alias("last_day"), F.collect_set("day").alias("d"))
    out = _finished(spark, days, "complete", "state")
    return out.select("user_id", "last_day", F.size("d").cast("long").alias("days"), F.expr("aggregate(d, 0L, (s, x) -> s + shiftleft(1L, 31 - datediff(DATE '2024-01-30', x)))").alias("bitmap"))


@query("t02_tumbling_stream", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def t02(spark, sf_dir):
    out = _finished(spark, E.tumbling(_stream(spark, sf_dir), "ts", "event_type"), "complete", "tumbling")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("t03_sliding_stream", "SELECT CAST(CAST(e.ts AS DATE) + i::INT + 1 AS TIMESTAMP) AS stop, event_type, count(*) AS n FROM events e CROSS JOIN range(7) AS r(i) GROUP BY 1, 2")
def t03(spark, sf_dir):
    out = _finished(spark, E.sliding(_stream(spark, sf_dir), "ts", "event_type"), "complete", "sliding")
    return out.select(F.col("end").cast("timestamp_ntz").alias("stop"), "event_type", "n")


@query("t04_session_stream", """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
            i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS stop, user_id, count(*) AS n FROM i GROUP BY user_id, i""")
def t04(spark, sf_dir):
    out = _finished(spark, E.sessions(_stream(spark, sf_dir), "ts", "user_id"), "complete", "sessions")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("stop"), "user_id", "n")


@query("t05_late_days", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(ts AS DATE) < DATE '2024-01-08' AS backfill FROM events GROUP BY 1")
def t05(spark, sf_dir):
    """A stream upserts days; the same input streamed again overwrites them and changes nothing; days before the 8th are flagged as backfill."""
    path = _place(spark, "late")
    for k in range(2):
        rows = _stream(spark, sf_dir).select(F.to_date("ts").alias("day"), "event_id")
        E.upsert_days(rows, path, "day", f"{path}-progress{k}").awaitTermination()
    return spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("n")).withColumn("backfill", F.col("day") < F.lit("2024-01-08").cast("date"))


@query("t06_once_stream", "SELECT count(DISTINCT event_id // 3) AS n FROM events")
def t06(spark, sf_dir):
    """Three deliveries of each message, told apart by an idempotency key; the watermark spans the table's month."""
    rows = _stream(spark, sf_dir).select("ts", F.expr("event_id div 3").alias("message"))
    return _finished(spark, E.once(rows, "ts", "message", "60 days"), "append", "once").agg(F.count(F.lit(1)).alias("n"))


@query("t07_cooldown_stream", """WITH RECURSIVE e AS (SELECT user_id, ts FROM events WHERE event_type = 'error'), r AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id
            UNION ALL SELECT r.user_id, (SELECT min(e.ts) FROM e WHERE e.user_id = r.user_id AND e.ts >= r.ts + INTERVAL 1 DAY) FROM r WHERE r.ts IS NOT NULL) SELECT user_id, ts FROM r WHERE ts IS NOT NULL""")
def t07(spark, sf_dir):
    """Alerts of a user at least a day after the last one let through."""
    alerts = _stream(spark, sf_dir).filter("event_type = 'error'").select("user_id", "ts")
    out = _finished(spark, E.cooled_down(alerts, "user_id", "ts", 86_400), "append", "cooldown")
    return out.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("t08_bounded_stream", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def t08(spark, sf_dir):
    """At most one file a trigger: a slow reader is never handed more."""
    docs = _stream(spark, sf_dir, "documents", 1).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return _finished(spark, docs, "complete", "bounded")


@query("t09_change_stream", """SELECT op, count(*) AS n FROM (SELECT CASE WHEN user_id % 3 = 0 THEN 'UPDATE' ELSE 'INSERT' END AS op FROM events) GROUP BY op""")
def t09(spark, sf_dir):
    """Rows of a change log, as they come: the operation and what it did, in an append-only table."""
    op = F.when(F.col("user_id") % 3 == 0, "UPDATE").otherwise("INSERT")
    log = _stream(spark, sf_dir).select(op.alias("op"), F.to_json(F.struct("event_id", "user_id", "event_type")).alias("payload"))
    return _finished(spark, log, "append", "changes").groupBy("op").agg(F.count(F.lit(1)).alias("n"))


sql("t10_replay", """SELECT user_id, event_id, round(value, 4) AS price, round(max(value) OVER w, 4) AS high, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")


@query("s06_delimited_scan", "SELECT count(*) FILTER (n_nationkey % 5 > 0) AS good, count(*) FILTER (n_nationkey % 5 = 0) AS bad, sum(n_regionkey) FILTER (n_nationkey % 5 > 0)::BIGINT AS regions, 'c1,c2,c3' AS columns FROM nation")
def s06(spark, sf_dir):
    """A headerless ; file whose columns are counted and named, with rows whose number does not parse."""
    path = _place(spark, "delimited")
    n = table(spark, sf_dir, "nation")
    n.select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 5 == 0, "x").otherwise(F.col("n_regionkey").cast("string")).alias("r")).write.csv(path, sep=";")
    raw = files.read_delimited(spark, path)
    good, bad = files.split_bad(raw, {"c1": "long", "c3": "int"})
    return good.agg(F.count(F.lit(1)).alias("good"), F.sum("c3").alias("regions")).crossJoin(bad.agg(F.count(F.lit(1)).alias("bad"))).select("good", "bad", "regions", F.lit(",".join(raw.columns)).alias("columns"))


@query("s13_converted_dates", "SELECT CASE WHEN o_orderkey % 7 > 0 THEN date_trunc('year', o_orderdate)::DATE END AS y, count(*) AS n FROM orders GROUP BY 1")
def s13(spark, sf_dir):
    """Text with some dates that are none, to compressed Parquet with dates or null."""
    raw, path = _place(spark, "text"), _place(spark, "converted")
    o = table(spark, sf_dir, "orders")
    o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "none").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d")).write.csv(raw, header=True)
    d = spark.read.csv(raw, header=True).select(F.col("o_orderkey").cast("long").alias("k"), F.expr("try_cast(d AS DATE)").alias("d"))
    files.write_layout(d, path, compression="zstd")
    return spark.read.parquet(path).groupBy(F.trunc("d", "year").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("s15_json_sets", "SELECT DISTINCT p_brand AS set_key, p_size::VARCHAR AS element FROM part")
def s15(spark, sf_dir):
    path = _place(spark, "json")
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set(F.col("p_size").cast("string")).alias("v"))
    p.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_brand", "v")))).alias("value")).write.text(path)
    return files.read_sets(spark, path)


def _html(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    row = F.concat(F.lit("<tr><td> "), "n_name", F.lit(" </td><td><b>"), F.col("n_nationkey"), F.lit("</b></td>"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("<td>"), F.col("n_nationkey") * 3, F.lit("</td>"))).otherwise(""), F.lit("</tr>"))
    rows = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x["r"]), "\n").alias("r"))
    return rows.select("n_regionkey", F.concat(F.lit("<table>\n<tr><th>Name</th><th>Key</th></tr>\n"), "r", F.lit("</table>")).alias("html"))


@query("s17_html_tables", "SELECT n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::INT AS row, n_name AS name, n_nationkey::DOUBLE AS value FROM nation UNION ALL SELECT DISTINCT n_regionkey, 0, 'Name', NULL FROM nation")
def s17t(spark, sf_dir):
    return files.html_rows(_html(spark, sf_dir), "n_regionkey", "html").select("n_regionkey", "row", F.col("cells")[0].alias("name"), F.expr("try_cast(cells[1] AS DOUBLE)").alias("value"))


@query("s18_three_cells", "SELECT n_regionkey, n_name AS name, (n_nationkey * 3)::VARCHAR AS third FROM nation WHERE n_nationkey % 2 = 0")
def s18(spark, sf_dir):
    return files.html_rows(_html(spark, sf_dir), "n_regionkey", "html", cells=3).select("n_regionkey", F.col("cells")[0].alias("name"), F.col("cells")[2].alias("third"))


@query("s19_log_lines", "SELECT event_type AS appname, count(*) FILTER (event_id % 9 > 0) AS n, count(*) FILTER (event_id % 9 = 0) AS invalid FROM events GROUP BY event_type")
def s19l(spark, sf_dir):
    """Syslog lines ending in JSON, some cut short; those go to quarantine and are counted by the application in their prefix."""
    e = table(spark, sf_dir, "events")
    body = F.to_json(F.struct(F.col("event_type").alias("appname"), F.lit("info").alias("severity"), F.col("ts").cast("string").alias("timestamp")))
    lines = e.select(F.concat(F.lit("Jan 1 host "), "event_type", F.lit("[1]: "), F.when(F.col("event_id") % 9 == 0, F.substring(body, 1, 12)).otherwise(body)).alias("value"))
    good, bad = files.parse_log_lines(lines)
    n = good.groupBy("appname").agg(F.count(F.lit(1)).alias("n"))
    m = bad.groupBy(F.regexp_extract("value", r"host (\w+)\[", 1).alias("appname")).agg(F.count(F.lit(1)).alias("invalid"))
    return n.join(m, "appname", "full").fillna(0)
