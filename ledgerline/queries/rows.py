"""Row filters, duplicates, flags and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import values
from ledgerline.functions.dates import elapsed_days
from ledgerline.functions.text import corrected_previous, whitelist
from ledgerline.operators import rows
from ledgerline.queries.registry import Tables, query


def orders_with_gaps(t: Tables) -> DataFrame:
    """Orders with cells emptied by value, for the null rules."""
    return t.orders.select(
        "o_orderkey",
        F.when(F.col("o_totalprice") >= 100000, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_totalprice") >= 200000, F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_totalprice") >= 300000, F.col("o_orderpriority")).alias("priority"))


GAPS_SQL = """SELECT o_orderkey, CASE WHEN o_totalprice >= 100000 THEN o_totalprice END AS price,
 CASE WHEN o_totalprice >= 200000 THEN o_orderstatus END AS status,
 CASE WHEN o_totalprice >= 300000 THEN o_orderpriority END AS priority FROM orders"""


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-07-01' AND o_orderdate < TIMESTAMP '1997-08-01'""")
def range_filter(t):
    return rows.in_range(t.orders, "o_orderdate", "1996-07-01", "1997-08-01").select(
        "o_orderkey", "o_custkey", "o_totalprice")


@query(f"""SELECT * FROM ({GAPS_SQL}) WHERE 1 + (price IS NOT NULL)::INT + (status IS NOT NULL)::INT
 + (priority IS NOT NULL)::INT >= 3""")
def null_threshold_keep(t):
    return rows.keep_filled(orders_with_gaps(t), 3)


@query(f"""SELECT * FROM ({GAPS_SQL}) WHERE (price IS NULL)::INT + (status IS NULL)::INT
 + (priority IS NULL)::INT > 1""")
def null_threshold_bad(t):
    return rows.mostly_null(orders_with_gaps(t), 1)


@query("SELECT p_partkey, p_name, p_size FROM part")
def all_null_columns(t):
    emptied = t.part.select("p_partkey", "p_name", F.when(F.col("p_size") < 0, F.col("p_brand")).alias("never"), "p_size")
    return rows.drop_empty_columns(emptied)


DOUBLED_SQL = """SELECT o_custkey, o_orderstatus, o_orderpriority, o_orderkey FROM orders
 UNION ALL SELECT o_custkey, o_orderstatus, o_orderpriority, o_orderkey FROM orders WHERE o_orderstatus = 'F'"""


def orders_doubled(t: Tables) -> DataFrame:
    """Orders followed by a copy of the finished ones."""
    base = t.orders.select("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey")
    return base.unionByName(base.filter(F.col("o_orderstatus") == "F"))


@query("SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def dedup_exact(t):
    return rows.distinct_rows(orders_doubled(t).drop("o_orderkey"))


@query(f"""WITH d AS ({DOUBLED_SQL}), u AS (SELECT DISTINCT * FROM d)
SELECT (SELECT count(*) FROM d) AS rows_before, (SELECT count(*) FROM u) AS rows_after,
 (SELECT count(*) FROM d) - (SELECT count(*) FROM u) AS removed""")
def dedup_report(t):
    return rows.duplicates_removed(orders_doubled(t))


@query(f"""SELECT o_custkey, o_orderstatus, o_orderpriority, min(o_orderkey) AS o_orderkey FROM ({DOUBLED_SQL})
GROUP BY ALL""")
def dedup_subset(t):
    return rows.first_by(orders_doubled(t), ["o_custkey", "o_orderstatus", "o_orderpriority"], "o_orderkey")


@query(f"""WITH d AS ({DOUBLED_SQL}),
 e AS (SELECT count(*) AS n FROM d GROUP BY o_custkey, o_orderstatus, o_orderpriority, o_orderkey),
 s AS (SELECT count(*) AS n FROM d GROUP BY o_custkey, o_orderstatus, o_orderpriority)
SELECT (SELECT sum(n - 1)::BIGINT FROM e) AS exact_later, (SELECT coalesce(sum(n) FILTER (n > 1), 0)::BIGINT FROM s)
 AS similar_members""")
def duplicate_counts(t):
    return rows.duplicate_counts(orders_doubled(t), ["o_orderkey"])


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) > 1
 AS is_duplicate FROM orders""")
def duplicate_marks(t):
    marked = rows.mark_duplicates(t.orders, ["o_custkey", "o_orderstatus"], "o_orderkey")
    return marked.select("o_orderkey", "is_duplicate")


@query("""SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) > 1 AS is_duplicate FROM orders""")
def duplicate_marks_all(t):
    marked = rows.mark_duplicates(t.orders, ["o_custkey", "o_orderpriority"], "o_orderkey", keep_first=False)
    return marked.select("o_orderkey", "is_duplicate")


@query(f"""SELECT price IS NOT NULL AS has_price, status IS NOT NULL AS has_status, count(*) AS n
FROM ({GAPS_SQL}) GROUP BY ALL""")
def presence_matrix(t):
    return rows.presence_matrix(orders_with_gaps(t), "price", "status")


@query(f"""SELECT count(*) FILTER (price IS NOT NULL) AS with_price, count(*) AS n FROM ({GAPS_SQL})""")
def presence_flags(t):
    flagged = orders_with_gaps(t).withColumn("has_price", values.not_null_flag("price"))
    return flagged.agg(F.count_if("has_price").alias("with_price"), F.count(F.lit(1)).alias("n"))


TYPED_SQL = "SELECT *, CASE WHEN value >= 5 THEN event_type END AS kind FROM events"


def events_typed(t: Tables) -> DataFrame:
    """Events whose type is missing where the value is small."""
    return t.events.withColumn("kind", F.when(F.col("value") >= 5, F.col("event_type")))


@query(f"""SELECT event_id, CASE WHEN kind IN ('purchase', 'signup') THEN kind ELSE 'Otros' END AS category
FROM ({TYPED_SQL})""")
def whitelist_category(t):
    return events_typed(t).select("event_id", whitelist("kind", ["purchase", "signup"], "Otros").alias("category"))


@query("""WITH p AS (SELECT user_id, count(*) AS n, CASE WHEN sum(value) < 500 THEN 'NO SE INDICA' ELSE 'NO' END AS flag
 FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT user_id, n, CASE WHEN flag = 'NO SE INDICA' AND n > 1 THEN 'SI' ELSE flag END AS flag FROM p""")
def corrected_label(t):
    per_user = t.events.filter(F.col("event_type") == "purchase").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    flagged = per_user.withColumn("flag", F.when(F.col("total") < 500, F.lit("NO SE INDICA")).otherwise(F.lit("NO")))
    return flagged.select("user_id", "n", corrected_previous("flag", "n").alias("flag"))


VERSIONS_SQL = """SELECT o_orderkey, o_orderpriority,
 CASE WHEN o_totalprice >= 60000 THEN o_orderstatus END AS old_status,
 CASE WHEN o_totalprice < 90000 THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 'O' ELSE o_orderstatus END AS new_status
 FROM orders"""


def order_versions(t: Tables) -> DataFrame:
    """Two versions of the order status, both with missing values."""
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    return t.orders.select(
        "o_orderkey", "o_orderpriority",
        F.when(price >= 60000, status).alias("old_status"),
        F.when(price < 90000, F.lit(None)).when(F.col("o_orderpriority") == "1-URGENT", F.lit("O")).otherwise(status)
        .alias("new_status"))


@query(f"""SELECT count(*) FILTER (old_status IS DISTINCT FROM new_status) AS changed FROM ({VERSIONS_SQL})""")
def changed_cells(t):
    return order_versions(t).agg(rows.changed_cells("old_status", "new_status").alias("changed"))


@query(f"""SELECT count(*) FILTER (old_status = new_status) AS agreeing, count(*) AS n FROM ({VERSIONS_SQL})""")
def agreement_count(t):
    return order_versions(t).agg(rows.agreeing_rows("old_status", "new_status").alias("agreeing"),
                                 F.count(F.lit(1)).alias("n"))


@query(f"""SELECT o_orderkey, old_status, new_status FROM ({VERSIONS_SQL}) WHERE old_status <> new_status""")
def conflict_report(t):
    return rows.conflicts(order_versions(t), "old_status", "new_status", ["o_orderkey", "old_status", "new_status"])


@query("""SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate, l_shipdate)::DOUBLE AS days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate""")
def elapsed_negative(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    dated = joined.select("l_orderkey", "l_linenumber", elapsed_days("o_orderdate", "l_shipdate").alias("days"))
    return dated.filter(F.col("days") < 0)


@query("""WITH f AS (SELECT o_orderkey, date_diff('day', any_value(o_orderdate), min(l_shipdate)) AS days
 FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT o_orderkey, coalesce(days < 30, false) AS within_30, coalesce(days < 60, false) AS within_60,
 coalesce(days < 90, false) AS within_90 FROM f""")
def horizon_labels(t):
    first = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"))
    joined = t.orders.join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    dated = joined.select("o_orderkey", elapsed_days("o_orderdate", "first_ship").alias("days"))
    return dated.select("o_orderkey", *[values.horizon_label("days", k).alias(f"within_{k}") for k in (30, 60, 90)])


@query(f"""SELECT event_id, coalesce(kind = 'purchase', false)::INT AS is_purchase,
 coalesce(kind = 'click', false) AS is_click, coalesce(kind = 'view', false) AS is_view FROM ({TYPED_SQL})""")
def binary_features(t):
    click, view = values.two_flags("kind", "click", "view")
    return events_typed(t).select("event_id", values.equals_flag("kind", "purchase").alias("is_purchase"),
                                  click.alias("is_click"), view.alias("is_view"))


@query(f"""SELECT event_id, user_id, value FROM ({TYPED_SQL}) WHERE kind IS NULL AND value > 2 AND event_type <> 'view'""")
def point_predicates(t):
    hit = F.col("kind").isNull() & (F.col("value") > 2) & (F.col("event_type") != "view")
    return events_typed(t).filter(hit).select("event_id", "user_id", "value")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderpriority = '2-HIGH'")
def fetch_group(t):
    return t.orders.filter(F.col("o_orderpriority") == "2-HIGH").select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 10 AND o_orderkey < 4000")
def row_positions(t):
    return rows.positions(t.orders, "o_orderkey", 10, 4000).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 30")
def last_rows(t):
    return rows.end_rows(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", 30, last=True)


@query(f"""SELECT o.o_orderkey, o_custkey, o_totalprice * 2 AS doubled FROM orders o
JOIN ({GAPS_SQL}) g ON g.o_orderkey = o.o_orderkey
WHERE (price IS NULL)::INT + (status IS NULL)::INT + (priority IS NULL)::INT > 2""")
def refetch_rows(t):
    bad = rows.mostly_null(orders_with_gaps(t), 2)
    later = t.orders.withColumn("doubled", F.col("o_totalprice") * 2)
    return rows.refetch(later, bad, "o_orderkey").select("o_orderkey", "o_custkey", "doubled")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 0) AS l_extendedprice FROM lineitem")
def rounded_columns(t):
    chosen = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return values.round_numeric(chosen, 0)
