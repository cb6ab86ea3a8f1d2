"""Joins with registries by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import fixed_values as fixed
from ledgerline.functions.text import lookup
from ledgerline.operators import link, stats
from ledgerline.queries.registry import Tables, query


def good_customers(t: Tables) -> DataFrame:
    """A registry that misses some keys."""
    return t.customer.filter(F.col("c_acctbal") > 2000)


def urgent_orders(t: Tables) -> DataFrame:
    return t.orders.filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 300000))


URGENT_SQL = "SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000"


@query("""SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey""")
def inner_join(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "inner").select(
        "o_orderkey", "c_name", "c_mktsegment")


@query("""SELECT o_orderkey, o_custkey, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance,
 coalesce(c_mktsegment = 'BUILDING', false) AS is_building
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 2000) ON o_custkey = c_custkey""")
def lookup_join(t):
    found = link.lookup_unique(t.orders.select("o_orderkey", "o_custkey"), good_customers(t), "o_custkey", "c_custkey",
                               {"name": "c_name", "segment": "c_mktsegment", "balance": "c_acctbal"})
    return found.withColumn("is_building", F.col("segment").eqNullSafe("BUILDING"))


@query(f"""SELECT c_custkey, (c_custkey IN (SELECT o_custkey FROM ({URGENT_SQL})))::INT AS in_urgent,
 (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000))::INT AS in_pending
FROM customer""")
def membership_flags(t):
    pending = t.orders.filter((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000))
    return link.with_memberships(t.customer.select("c_custkey"), "c_custkey", {
        "in_urgent": (urgent_orders(t), "o_custkey"), "in_pending": (pending, "o_custkey")})


@query(f"""WITH r AS (SELECT 'pending' AS registry, o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000
 UNION ALL SELECT 'urgent', o_custkey FROM ({URGENT_SQL})),
 e AS (SELECT c_custkey FROM customer WHERE c_acctbal > 2000),
 n AS (SELECT DISTINCT registry FROM r)
SELECT registry,
 (SELECT count(*) FROM e WHERE c_custkey IN (SELECT o_custkey FROM r WHERE r.registry = n.registry)) AS entities_present,
 (SELECT count(*) FROM e WHERE c_custkey NOT IN (SELECT o_custkey FROM r WHERE r.registry = n.registry)) AS entities_absent,
 (SELECT count(*) FROM r WHERE r.registry = n.registry AND o_custkey NOT IN (SELECT c_custkey FROM e)) AS orphan_rows
FROM n""")
def coverage_report(t):
    pending = t.orders.filter((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000))
    return link.coverage_report(good_customers(t), "c_custkey", {
        "urgent": (urgent_orders(t), "o_custkey"), "pending": (pending, "o_custkey")})


@query(f"""SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM ({URGENT_SQL}))""")
def anti_left(t):
    return link.only_in(t.customer, urgent_orders(t), "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("""SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 2000)""")
def anti_right(t):
    return link.only_in(t.orders, good_customers(t), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query(f"""SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM ({URGENT_SQL}))""")
def semi_keys(t):
    return link.also_in(t.customer, urgent_orders(t), "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query(f"""WITH l AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 2000),
 r AS (SELECT DISTINCT o_custkey AS k FROM ({URGENT_SQL}))
SELECT (SELECT count(*) FROM l) AS left_keys, (SELECT count(*) FROM r) AS right_keys,
 (SELECT count(*) FROM l JOIN r USING (k)) AS common_keys,
 (SELECT count(*) FROM l WHERE k NOT IN (SELECT k FROM r)) AS left_only,
 (SELECT count(*) FROM r WHERE k NOT IN (SELECT k FROM l)) AS right_only""")
def key_overlap(t):
    return link.key_overlap(good_customers(t), urgent_orders(t), "c_custkey", "o_custkey")


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus AS s, CASE WHEN o_totalprice > 100000 THEN o_orderdate END AS d FROM orders),
 b AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'X' ELSE o_orderstatus END AS s,
  CASE WHEN o_totalprice < 400000 THEN o_orderdate END AS d FROM orders)
SELECT count(*) AS matched, count(*) FILTER (a.s = b.s) AS same_status, count(*) FILTER (a.d = b.d) AS same_date,
 count(*) FILTER (a.d = b.d AND a.s <> b.s) AS same_date_other_status, count(*) FILTER (b.d IS NULL) AS undated
FROM a JOIN b USING (o_orderkey)""")
def delivery_compare(t):
    first = t.orders.select(
        "o_orderkey", F.col("o_orderstatus").alias("s"), F.when(F.col("o_totalprice") > 100000, F.col("o_orderdate")).alias("d"))
    second = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", F.lit("X")).otherwise(F.col("o_orderstatus")).alias("s"),
        F.when(F.col("o_totalprice") < 400000, F.col("o_orderdate")).alias("d"))
    both = link.merge_deliveries(first, second, "o_orderkey")
    same_s, same_d = F.col("s_1") == F.col("s_2"), F.col("d_1") == F.col("d_2")
    return both.agg(F.count(F.lit(1)).alias("matched"), F.count_if(same_s).alias("same_status"),
                    F.count_if(same_d).alias("same_date"),
                    F.count_if(same_d & (F.col("s_1") != F.col("s_2"))).alias("same_date_other_status"),
                    F.count_if(F.col("d_2").isNull()).alias("undated"))


@query("""WITH a AS (SELECT o_custkey AS k, o_orderstatus AS s, CASE WHEN o_totalprice > 200000 THEN year(o_orderdate) END AS y FROM orders),
 j AS (SELECT x.s = z.s AS same_s, x.y = z.y AS same_y FROM a x JOIN a z ON x.k = z.k)
SELECT 'matched' AS "check", count(*) AS pairs FROM j UNION ALL SELECT 'same_status', count(*) FILTER (same_s) FROM j
UNION ALL SELECT 'same_year', count(*) FILTER (same_y) FROM j UNION ALL SELECT 'same_both', count(*) FILTER (same_s AND same_y) FROM j""")
def delivery_pairs(t):
    rows = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s"),
                           F.when(F.col("o_totalprice") > 200000, F.year("o_orderdate")).alias("y"))
    return link.pair_agreement(rows, rows, "k", {"matched": {}, "same_status": {"s": "s"}, "same_year": {"y": "y"},
                                                 "same_both": {"s": "s", "y": "y"}})


@query("""SELECT c_custkey, c_name, s_suppkey, s_name, n_nationkey, n_name
FROM (SELECT CASE WHEN c_acctbal > 5000 THEN c_custkey END AS c_custkey, c_name FROM customer) c
FULL JOIN (SELECT s_suppkey, s_name FROM supplier) s ON c_custkey = s_suppkey
FULL JOIN (SELECT n_nationkey, n_name FROM nation) n ON c_custkey = n_nationkey""")
def outer_chain(t):
    """All customers; those of a small balance have no key and match nothing."""
    key = F.when(F.col("c_acctbal") > 5000, F.col("c_custkey")).alias("c_custkey")
    customers = t.customer.select(key, "c_name", F.lit("c").alias("origin"))
    suppliers = t.supplier.select("s_suppkey", "s_name", F.lit("s").alias("origin"))
    nations = t.nation.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    merged = link.outer_chain([(customers, "c_custkey"), (suppliers, "s_suppkey"), (nations, "n_nationkey")])
    return merged.select("c_custkey", "c_name", "s_suppkey", "s_name", F.col("n_nationkey").cast("int").alias("n_nationkey"),
                         "n_name")


LATEST_SQL = """SELECT user_id, event_id, event_type, CASE WHEN event_type <> 'view' THEN value END AS v FROM events"""


def events_valued(t: Tables) -> DataFrame:
    """Events whose value is missing for views."""
    return t.events.withColumn("v", F.when(F.col("event_type") != "view", F.col("value")))


@query(f"""WITH e AS ({LATEST_SQL}),
 v AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM e WHERE v IS NOT NULL),
 k AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM e)
SELECT c_custkey, k.event_type AS latest_event_type, v.v AS latest_v FROM customer
LEFT JOIN k ON k.user_id = c_custkey AND k.rn = 1 LEFT JOIN v ON v.user_id = c_custkey AND v.rn = 1""")
def latest_per_key(t):
    return link.with_latest(t.customer.select("c_custkey"), events_valued(t), "c_custkey", "user_id", "event_id",
                            ["event_type", "v"])


@query(f"""WITH e AS ({LATEST_SQL}), f AS (
 SELECT user_id, 'c' AS p, v, event_id FROM e WHERE v IS NOT NULL AND event_type LIKE '%c%'
 UNION ALL SELECT user_id, 's', v, event_id FROM e WHERE v IS NOT NULL AND regexp_matches(event_type, '^(sign|err)')),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id, p ORDER BY event_id DESC) AS rn FROM f)
SELECT c_custkey, a.v AS with_c, b.v AS signup_or_error FROM customer
LEFT JOIN r a ON a.user_id = c_custkey AND a.rn = 1 AND a.p = 'c'
LEFT JOIN r b ON b.user_id = c_custkey AND b.rn = 1 AND b.p = 's'""")
def filtered_latest(t):
    return link.with_filtered_latest(t.customer.select("c_custkey"), events_valued(t), "c_custkey", "user_id",
                                     "event_type", "v", "event_id", {"with_c": "c", "signup_or_error": "^(sign|err)"})


@query("""WITH g AS (SELECT l_orderkey, min(l_suppkey) AS lo, max(l_suppkey) AS hi FROM lineitem
 GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 2)
SELECT l.l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_suppkey = lo THEN hi ELSE lo END AS counterpart
FROM lineitem l LEFT JOIN g ON g.l_orderkey = l.l_orderkey""")
def pair_counterpart(t):
    return link.with_counterpart(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), "l_orderkey", "l_suppkey")


@query("""WITH m AS (SELECT l_orderkey, l_suppkey, min(l_partkey) AS o FROM lineitem GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY o, l_suppkey) AS rn FROM m)
SELECT l.l_orderkey, l_linenumber, l.l_suppkey,
 CASE WHEN l.l_suppkey = a.l_suppkey THEN b.l_suppkey ELSE a.l_suppkey END AS first_other
FROM lineitem l LEFT JOIN r a ON a.l_orderkey = l.l_orderkey AND a.rn = 1
LEFT JOIN r b ON b.l_orderkey = l.l_orderkey AND b.rn = 2""")
def first_other_member(t):
    keyed = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey",
                              F.struct("l_partkey", "l_suppkey").alias("ord"))
    return link.with_first_other(keyed, "l_orderkey", "l_suppkey", "ord").drop("ord")


@query("""WITH g AS (SELECT l_orderkey, min(l_suppkey) AS lo, max(l_suppkey) AS hi FROM lineitem
 GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 2),
 p AS (SELECT lo AS s, hi AS other, l_orderkey FROM g UNION ALL SELECT hi, lo, l_orderkey FROM g),
 f AS (SELECT s, other, row_number() OVER (PARTITION BY s ORDER BY l_orderkey) AS rn FROM p)
SELECT s_suppkey, s_name, other AS counterpart FROM supplier LEFT JOIN f ON s = s_suppkey AND rn = 1""")
def attach_counterpart(t):
    return link.attach_counterpart(t.supplier.select("s_suppkey", "s_name"), t.lineitem.select("l_orderkey", "l_suppkey"),
                                   "s_suppkey", "l_suppkey", "l_orderkey", "l_orderkey")


@query("""SELECT c_custkey, (c_custkey IN (SELECT o_custkey FROM orders
 WHERE o_orderkey IN (SELECT c_custkey FROM customer)))::INT AS secondary_in_ledger FROM customer""")
def secondary_key_flag(t):
    return link.with_secondary_key_flag(t.customer.select("c_custkey"), t.orders, "c_custkey", "o_custkey", "o_orderkey")


@query("""WITH f AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn
 FROM orders WHERE o_totalprice > 350000)
SELECT c_custkey, o_orderstatus AS status, coalesce(o_orderstatus = 'F', false) AS finished
FROM customer LEFT JOIN f ON o_custkey = c_custkey AND rn = 1""")
def dict_last_wins(t):
    table = t.orders.withColumn("status", F.when(F.col("o_totalprice") > 350000, F.col("o_orderstatus")))
    mapped = link.dict_lookup(t.customer.select("c_custkey"), table, "c_custkey", "o_custkey", "status", "o_orderkey",
                              "status")
    return mapped.withColumn("finished", F.col("status").eqNullSafe("F"))


# Regions of the population table stand in for the first nations by number.
REGION_NAMES = {f"NATION_{i}": name for i, name in enumerate(fixed.POPULATION)}
REGION_VALUES = ", ".join(f"('NATION_{i}', '{name}', {n})" for i, (name, n) in enumerate(fixed.POPULATION.items()))


@query(f"""WITH p(nation, region, population) AS (VALUES {REGION_VALUES})
SELECT n_nationkey, n_name, region, population::INT AS population FROM nation LEFT JOIN p ON nation = n_name""")
def constant_lookup(t):
    named = t.nation.select("n_nationkey", "n_name", lookup("n_name", REGION_NAMES).alias("region"))
    return named.withColumn("population", lookup("region", fixed.POPULATION))


@query(f"""WITH p(nation, region, population) AS (VALUES {REGION_VALUES})
SELECT coalesce(region, n_name) AS region, count(*) AS n, any_value(population)::BIGINT AS population,
 round(100000.0 * count(*) / any_value(population), 6) AS rate
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN p ON nation = n_name
WHERE c_mktsegment = 'MACHINERY' GROUP BY 1""")
def rate_per_100k(t):
    placed = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rates = stats.rate_per_100k(placed.filter(F.col("c_mktsegment") == "MACHINERY"), "n_name", fixed.POPULATION, REGION_NAMES)
    return rates.select(F.col("n_name").alias("region"), "n", "population", F.round("rate", 6).alias("rate"))
