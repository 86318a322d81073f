"""Sorting, limits and pagination."""

from tessera.registry import sql

sql("l01_order_limit", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
sql("l02_abs_desc_nulls_last", "SELECT c_custkey, nullif(c_acctbal, 0) AS b FROM {customer} ORDER BY abs(nullif(c_acctbal, 0)) DESC NULLS LAST, c_custkey LIMIT 25")
sql("l03_offset_page", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 100 OFFSET 300")
sql("l04_keyset_page", "SELECT o_orderkey FROM {orders} WHERE o_orderkey > 300 ORDER BY o_orderkey LIMIT 100")
sql("l05_range_page", "SELECT o_orderkey FROM {orders} WHERE o_orderkey BETWEEN 300 AND 300 + 100 ORDER BY o_orderkey")
sql("l06_timestamp_page", "SELECT event_id, ts FROM {events} WHERE ts > TIMESTAMP '2024-01-05 12:00:00' ORDER BY ts, event_id LIMIT 100")
sql("l07_composite_page", "SELECT o_orderkey, o_orderdate FROM {orders} WHERE o_orderdate > TIMESTAMP '1997-03-01' OR (o_orderdate = TIMESTAMP '1997-03-01' AND o_orderkey > 500) ORDER BY o_orderdate, o_orderkey LIMIT 100")
