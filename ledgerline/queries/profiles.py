"""One row per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.asof import asof_history
from ledgerline.operators.link import lookup_unique, with_membership
from ledgerline.operators.profile import Out, entity_profile as build_profile, one_aggregate
from ledgerline.queries.link import good_customers, urgent_orders
from ledgerline.queries.registry import Tables, query
from ledgerline.sources.shared import stored

OUTPUTS = [
    Out("frequent_type", "event_type", "mode"),
    Out("frequent_value", "whole", "mode"),
    Out("last_v", "v", "last"),
    Out("last_filled_v", "v", "last_filled"),
    Out("second_last_v", "v", "nth_last_filled", 2),
    Out("third_last_v", "v", "nth_last_filled", 3),
    Out("min_v", "v", "min"),
    Out("filled_v", "v", "count"),
    Out("latest", "dated", "largest"),
    Out("latest_poisoned", "dated", "largest_poisoned"),
    Out("second_latest", "dated", "nth_largest", 2),
    Out("third_latest", "dated", "nth_largest", 3),
    Out("second_latest_poisoned", "dated", "nth_largest", 2, "poison"),
    Out("mean_gap_days", "dated", "mean_gap_days"),
]


def ledger(t: Tables) -> DataFrame:
    """Events with missing values for views and missing dates for some errors."""
    return t.events.select(
        "user_id", "event_id", "event_type", F.floor("value").alias("whole"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("v"),
        F.when((F.col("event_type") != "error") | (F.col("value") < 8), F.col("ts")).alias("dated"))


PROFILE_SQL = """WITH e AS (SELECT user_id, event_id, event_type, floor(value)::BIGINT AS whole,
  CASE WHEN event_type <> 'view' THEN value END AS v,
  CASE WHEN event_type <> 'error' OR value < 8 THEN ts END AS dated FROM events),
 m1 AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn
  FROM e GROUP BY user_id, event_type),
 m2 AS (SELECT user_id, whole, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, whole) AS rn
  FROM e GROUP BY user_id, whole),
 o AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM e),
 f AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM e WHERE v IS NOT NULL),
 d AS (SELECT user_id, dated, row_number() OVER (PARTITION BY user_id ORDER BY dated DESC) AS rn FROM e WHERE dated IS NOT NULL),
 p AS (SELECT user_id, dated, row_number() OVER (PARTITION BY user_id ORDER BY dated DESC NULLS FIRST) AS rn FROM e),
 a AS (SELECT user_id, min(v) AS min_v, count(v) AS filled_v,
  CASE WHEN count(dated) > 1 THEN (epoch_us(max(dated)) - epoch_us(min(dated))) / 86400000000.0 / (count(dated) - 1) END AS gap
  FROM e GROUP BY user_id)
SELECT a.user_id, m1.event_type AS frequent_type, m2.whole AS frequent_value, o1.v AS last_v, f1.v AS last_filled_v,
 f2.v AS second_last_v, f3.v AS third_last_v, min_v, filled_v, d1.dated AS latest, p1.dated AS latest_poisoned,
 d2.dated AS second_latest, d3.dated AS third_latest, p2.dated AS second_latest_poisoned, round(gap, 6) AS mean_gap_days
FROM a LEFT JOIN m1 ON m1.user_id = a.user_id AND m1.rn = 1 LEFT JOIN m2 ON m2.user_id = a.user_id AND m2.rn = 1
LEFT JOIN o o1 ON o1.user_id = a.user_id AND o1.rn = 1 LEFT JOIN f f1 ON f1.user_id = a.user_id AND f1.rn = 1
LEFT JOIN f f2 ON f2.user_id = a.user_id AND f2.rn = 2 LEFT JOIN f f3 ON f3.user_id = a.user_id AND f3.rn = 3
LEFT JOIN d d1 ON d1.user_id = a.user_id AND d1.rn = 1 LEFT JOIN d d2 ON d2.user_id = a.user_id AND d2.rn = 2
LEFT JOIN d d3 ON d3.user_id = a.user_id AND d3.rn = 3 LEFT JOIN p p1 ON p1.user_id = a.user_id AND p1.rn = 1
LEFT JOIN p p2 ON p2.user_id = a.user_id AND p2.rn = 2"""


@query(PROFILE_SQL)
def entity_profile(t):
    profile = build_profile(ledger(t), "user_id", "event_id", OUTPUTS)
    return profile.withColumn("mean_gap_days", F.round("mean_gap_days", 6))


@query("""SELECT o_custkey, o_totalprice AS second_last_price FROM (SELECT o_custkey, o_totalprice,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 2
UNION ALL SELECT o_custkey, NULL FROM orders GROUP BY o_custkey HAVING count(*) = 1""")
def adhoc_aggregate(t):
    return one_aggregate(t.orders, "o_custkey", "o_totalprice", "nth_last_filled", "second_last_price", "o_orderkey", 2)


LINKED_OUTPUTS = [
    Out("status", "o_orderstatus", "last_filled"), Out("priority", "o_orderpriority", "mode"), Out("orders", "o_orderdate", "count"),
    Out("mean_gap_days", "o_orderdate", "mean_gap_days"), Out("segment", "segment", "last_filled"), Out("urgent", "urgent", "max"),
    Out("urgent_before", "urgent_count", "last_filled"), Out("second_last_price", "o_totalprice", "nth_last_filled", 2),
]


@query("""WITH u AS (SELECT o_custkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000),
 c AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 2000),
 b AS (SELECT o_orderkey, (SELECT count(*) FROM u WHERE u.o_custkey = o.o_custkey AND u.o_orderdate < o.o_orderdate) AS before FROM orders o),
 r AS (SELECT o.*, before, row_number() OVER (PARTITION BY o_custkey ORDER BY o.o_orderkey DESC) AS rn FROM orders o JOIN b ON b.o_orderkey = o.o_orderkey),
 m AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS rn
  FROM orders GROUP BY o_custkey, o_orderpriority),
 g AS (SELECT o_custkey, count(*) AS n, CASE WHEN count(*) > 1 THEN (epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000.0
  / (count(*) - 1) END AS gap FROM orders GROUP BY o_custkey)
SELECT g.o_custkey, r1.o_orderstatus AS status, m.o_orderpriority AS priority, n AS orders, round(gap, 6) AS mean_gap_days, c_mktsegment AS segment,
 (g.o_custkey IN (SELECT o_custkey FROM u))::INT AS urgent, r1.before AS urgent_before, r2.o_totalprice AS second_last_price
FROM g JOIN r r1 ON r1.o_custkey = g.o_custkey AND r1.rn = 1 LEFT JOIN r r2 ON r2.o_custkey = g.o_custkey AND r2.rn = 2
JOIN m ON m.o_custkey = g.o_custkey AND m.rn = 1 LEFT JOIN c ON c_custkey = g.o_custkey""")
def linked_profile(t):
    """Orders linked with a lookup, a membership flag and earlier urgent orders, then one row per customer."""
    urgent = urgent_orders(t).select("o_custkey", F.col("o_orderdate").alias("urgent_date"))
    linked = asof_history(t.orders, urgent, "o_custkey", "o_orderdate", "urgent_date", "urgent_")
    linked = lookup_unique(linked, good_customers(t), "o_custkey", "c_custkey", {"segment": "c_mktsegment"})
    linked = stored(with_membership(linked, urgent, "o_custkey", "o_custkey", "urgent"))
    profile = build_profile(linked, "o_custkey", "o_orderkey", LINKED_OUTPUTS)
    return profile.withColumn("mean_gap_days", F.round("mean_gap_days", 6))
