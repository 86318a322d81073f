"""Set operations and the decomposition of overlapping sets."""

from pyspark.sql import functions as F

from tessera.operators import sets as S
from tessera.registry import query, sql
from tessera.tables import table

#: Sets are the kinds of events, their elements the days of each user.
_MEMBERS = "SELECT DISTINCT user_id || '-' || day(ts) AS element, event_type FROM events"


def _members(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("set_key"), F.concat_ws("-", "user_id", F.dayofmonth("ts")).alias("element"))


sql("e01_union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}")
sql("e02_union", "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM {supplier}")


@query("e03_euler_diagram", f"SELECT sets, list_sort(list(element)) AS elements FROM (SELECT element, string_agg(event_type, ',' ORDER BY event_type) AS sets FROM ({_MEMBERS}) GROUP BY element) GROUP BY sets")
def e03(spark, sf_dir):
    return S.euler(_members(spark, sf_dir)).select(F.array_join("sets", ",").alias("sets"), "elements")


@query("e04_euler_boundaries", f"SELECT a.event_type AS set_key, string_agg(DISTINCT b.event_type, ',' ORDER BY b.event_type) AS neighbours FROM ({_MEMBERS}) a JOIN ({_MEMBERS}) b ON a.element = b.element AND a.event_type <> b.event_type GROUP BY a.event_type")
def e04(spark, sf_dir):
    return S.boundaries(_members(spark, sf_dir)).select("set_key", F.array_join("neighbours", ",").alias("neighbours"))


sql("e05_euler_match", "SELECT event_type FROM {events} WHERE user_id IN (1, 2, 3) GROUP BY event_type HAVING count(DISTINCT user_id) = 3")


@query("e06_overlap_statistics", f"SELECT n, count(*) AS elements FROM (SELECT element, count(*) AS n FROM ({_MEMBERS}) GROUP BY element) GROUP BY n")
def e06(spark, sf_dir):
    return S.euler(_members(spark, sf_dir)).groupBy(F.size("sets").cast("long").alias("n")).agg(F.sum(F.size("elements")).cast("long").alias("elements"))


@query("e07_truncated_samples", f"SELECT sets, array_to_string(list_sort(list(element))[1:3], ',') || CASE WHEN count(*) > 3 THEN ',...' ELSE '' END AS sample FROM (SELECT element, string_agg(event_type, ',' ORDER BY event_type) AS sets FROM ({_MEMBERS}) GROUP BY element) GROUP BY sets")
def e07(spark, sf_dir):
    d = S.euler(_members(spark, sf_dir))
    return d.select(F.array_join("sets", ",").alias("sets"), F.concat(F.array_join(F.slice("elements", 1, 3), ","), F.when(F.size("elements") > 3, ",...").otherwise("")).alias("sample"))


sql("e08_overlap_generators", "SELECT concat('s', CAST(s.id AS STRING)) AS set_key, e.id AS element FROM range(8) s CROSS JOIN range(100) e WHERE (e.id + s.id * 10) % 80 < 20",
    "SELECT 's' || s.range AS set_key, e.range AS element FROM range(8) s CROSS JOIN range(100) e WHERE (e.range + s.range * 10) % 80 < 20")
sql("e10_composed_relations", "SELECT n_regionkey, count(DISTINCT s_suppkey) AS suppliers FROM {nation} JOIN {supplier} ON s_nationkey = n_nationkey GROUP BY n_regionkey")
sql("e11_substring_index", "SELECT w.word, count(*) AS n FROM {part} CROSS JOIN (VALUES ('STEEL'), ('BRASS'), ('ECONOMY')) AS w(word) WHERE contains(p_type, w.word) GROUP BY w.word")
sql("e12_insert_ignore", "SELECT k, v FROM (SELECT c_custkey AS k, c_name AS v FROM {customer} UNION ALL SELECT o_custkey, min(o_orderstatus) FROM {orders} WHERE o_custkey NOT IN (SELECT c_custkey FROM {customer}) GROUP BY o_custkey)")
sql("e13_intersect_except", "(SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}) EXCEPT SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1")
