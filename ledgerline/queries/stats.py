"""Frequencies, profiles, time series, distributions and label conflicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import stats
from ledgerline.queries.registry import query
from ledgerline.queries.rows import GAPS_SQL, orders_with_gaps


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def value_frequencies(t):
    return stats.frequencies(t.part, "p_type")


@query(f"SELECT status, priority, count(*) AS n FROM ({GAPS_SQL}) WHERE status IS NOT NULL AND priority IS NOT NULL GROUP BY ALL")
def tuple_frequencies(t):
    return stats.frequencies(orders_with_gaps(t), ["status", "priority"])


@query("""SELECT o_orderpriority, count(*) AS n, sum((o_totalprice > 250000)::INT)::BIGINT AS expensive FROM orders
WHERE o_orderstatus = 'O' GROUP BY o_orderpriority""")
def subset_frequencies(t):
    flagged = t.orders.filter(F.col("o_orderstatus") == "O").withColumn("big", (F.col("o_totalprice") > 250000).cast("int"))
    return flagged.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("big").alias("expensive"))


@query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 20")
def top_values(t):
    return stats.top_values(t.part, "p_name", 20)


@query(f"""WITH g AS ({GAPS_SQL}) SELECT c AS "column", n_rows, n_null, n_distinct, lo AS min_value, hi AS max_value FROM (
 SELECT 'status' AS c, count(*) AS n_rows, count(*) - count(status) AS n_null,
  count(DISTINCT status) + max((status IS NULL)::INT)::BIGINT AS n_distinct, min(status) AS lo, max(status) AS hi FROM g
 UNION ALL SELECT 'priority', count(*), count(*) - count(priority), count(DISTINCT priority)
  + max((priority IS NULL)::INT)::BIGINT, min(priority), max(priority) FROM g
 UNION ALL SELECT 'o_orderkey', count(*), 0, count(DISTINCT o_orderkey), min(o_orderkey)::VARCHAR, max(o_orderkey)::VARCHAR FROM g)""")
def table_profile(t):
    return stats.column_facts(orders_with_gaps(t), ["status", "priority", "o_orderkey"])


@query(f"""WITH g AS ({GAPS_SQL}) SELECT * FROM (
 SELECT 'status' AS "column", status AS value, count(*) AS n FROM g GROUP BY status
 UNION ALL SELECT 'priority', priority, count(*) FROM g GROUP BY priority) WHERE value IS NOT NULL""")
def profile_frequencies(t):
    return stats.column_frequencies(orders_with_gaps(t), ["status", "priority"])


def _described(columns: dict[str, str], source: str) -> str:
    """SQL of a summary: {name: expression} over a source."""
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, min(v) AS min_value,
 round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.5), 4) AS q50, round(quantile_cont(v, 0.75), 4) AS q75, max(v) AS max_value
FROM (SELECT ({e})::DOUBLE AS v FROM {source})""" for c, e in columns.items())


def _rounded_summary(df, columns):
    return stats.summary(df, columns).withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})


@query(_described({"o_totalprice": "o_totalprice", "o_custkey": "o_custkey"}, "orders"))
def describe(t):
    return _rounded_summary(t.orders, ["o_totalprice", "o_custkey"])


LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(_described({c: c for c in LINE_NUMBERS} | {"late_price": "CASE WHEN l_returnflag = 'R' THEN l_extendedprice END", "no_value": "NULL"}, "lineitem"))
def describe_wide(t):
    """All numeric columns, one with gaps and one without any value."""
    late = F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))
    return _rounded_summary(t.lineitem.withColumns({"late_price": late, "no_value": F.lit(None).cast("double")}), [*LINE_NUMBERS, "late_price", "no_value"])


@query(f"""WITH g AS ({GAPS_SQL}) SELECT * FROM (VALUES (0, 'o_orderkey', 'bigint'), (1, 'status', 'string'), (2, 'priority', 'string')) i(position, "column", type)
JOIN (SELECT 'o_orderkey' AS "column", count(o_orderkey) AS n_filled, count(*) - count(o_orderkey) AS n_null FROM g
 UNION ALL SELECT 'status', count(status), count(*) - count(status) FROM g
 UNION ALL SELECT 'priority', count(priority), count(*) - count(priority) FROM g) USING ("column")""")
def table_info(t):
    return stats.table_info(orders_with_gaps(t).select("o_orderkey", "status", "priority"))


QUIET_SQL = "SELECT CASE WHEN o_totalprice > 480000 THEN o_orderdate END AS o_orderdate, o_orderpriority FROM orders"


@query(f"""WITH w AS (SELECT date_trunc('week', o_orderdate)::DATE + 6 AS week_end, count(*) AS n FROM ({QUIET_SQL}) WHERE o_orderdate IS NOT NULL GROUP BY 1),
 s AS (SELECT unnest(generate_series(min(week_end), max(week_end), INTERVAL 7 DAY))::DATE AS week_end FROM w)
SELECT s.week_end::VARCHAR AS week_end, coalesce(n, 0) AS n FROM s LEFT JOIN w ON w.week_end = s.week_end""")
def weekly_counts(t):
    gaps = t.orders.withColumn("o_orderdate", F.when(F.col("o_totalprice") > 480000, F.col("o_orderdate")))
    counts = stats.weekly_counts(gaps, "o_orderdate")
    return counts.withColumn("week_end", F.col("week_end").cast("string"))


@query(f"""WITH m AS (SELECT last_day(o_orderdate) AS month_end, count(*) AS n FROM ({QUIET_SQL}) WHERE o_orderdate IS NOT NULL AND o_orderpriority = '5-LOW' GROUP BY 1),
 s AS (SELECT last_day(unnest(generate_series(date_trunc('month', min(month_end)), max(month_end)::TIMESTAMP, INTERVAL 1 MONTH))::DATE) AS month_end FROM m)
SELECT s.month_end::VARCHAR AS month_end, coalesce(n, 0) AS n FROM s LEFT JOIN m ON m.month_end = s.month_end""")
def monthly_counts(t):
    rare = (F.col("o_totalprice") > 480000) & (F.col("o_orderpriority") == "5-LOW")
    gaps = t.orders.withColumn("o_orderdate", F.when(rare, F.col("o_orderdate")))
    return stats.monthly_counts(gaps, "o_orderdate").withColumn("month_end", F.col("month_end").cast("string"))


@query("""WITH r AS (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 5 AS part FROM orders)
SELECT o_custkey, part::BIGINT AS part, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys,
 string_agg(CASE WHEN o_totalprice > 200000 THEN o_orderstatus ELSE '-' END, ',' ORDER BY o_orderkey) AS statuses
FROM r GROUP BY ALL""")
def grouped_lists(t):
    rows = t.orders.select("o_custkey", "o_orderkey",
                           F.when(F.col("o_totalprice") > 200000, F.col("o_orderstatus")).alias("status"))
    lists = stats.grouped_lists(rows.withColumn("keys", F.col("o_orderkey")), "o_custkey", "o_orderkey", ["keys", "status"], 5)
    return lists.select("o_custkey", "part", F.array_join("keys", ",").alias("keys"),
                        F.array_join("status", ",", "-").alias("statuses"))


@query("SELECT p_name, count(DISTINCT p_brand) AS n_values FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def fd_violations(t):
    return stats.dependency_violations(t.part, "p_name", "p_brand")


@query(f"""SELECT round(avg((coalesce(status, '') = 'F')::INT), 9) AS share_f, round(avg((coalesce(priority, '') = '5-LOW')::INT), 9)
 AS share_low FROM ({GAPS_SQL})""")
def value_share(t):
    return orders_with_gaps(t).agg(F.round(stats.share_equal("status", "F"), 9).alias("share_f"),
                                   F.round(stats.share_equal("priority", "5-LOW"), 9).alias("share_low"))


@query("""WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
 r AS (SELECT least(floor((l_extendedprice - lo) / (hi - lo) * 10), 9)::INT AS bin, l_returnflag, lo, hi FROM lineitem, b),
 c AS (SELECT bin, l_returnflag, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi FROM r GROUP BY bin, l_returnflag)
SELECT bin, l_returnflag, n, round(lo + bin * ((hi - lo) / 10), 6) AS bin_start,
 round(n / (sum(n) OVER (PARTITION BY l_returnflag) * ((hi - lo) / 10)), 12) AS density FROM c""")
def histogram(t):
    out = stats.histogram(t.lineitem, "l_extendedprice", 10, "l_returnflag")
    return out.withColumns({"bin_start": F.round("bin_start", 6), "density": F.round("density", 12)})


@query("""WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
 c AS (SELECT least(floor((value - lo) / (hi - lo) * 100), 99)::INT AS bin, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi
 FROM events, b GROUP BY 1)
SELECT bin, n, round(lo + bin * ((hi - lo) / 100), 6) AS bin_start, round(n / (sum(n) OVER () * ((hi - lo) / 100)), 9) AS density FROM c""")
def histogram_all(t):
    out = stats.histogram(t.events, "value", 100)
    return out.withColumns({"bin_start": F.round("bin_start", 6), "density": F.round("density", 9)})


@query("""WITH e AS (SELECT CASE WHEN event_type <> 'view' OR value <= 50 THEN event_type END AS value, value > 50 AS class FROM events),
 c AS (SELECT value, class, count(*) AS n FROM e WHERE value IS NOT NULL GROUP BY ALL), s AS (SELECT DISTINCT c1.value, c2.class FROM c c1, c c2),
 k AS (SELECT class, sum(n) AS total FROM c GROUP BY class)
SELECT s.value, s.class, coalesce(n, 0) AS n, round(coalesce(n, 0) / total, 9) AS share
FROM s JOIN k ON k.class = s.class LEFT JOIN c ON c.value = s.value AND c.class = s.class""")
def class_frequencies(t):
    """All events; views above 50 have no type, so one class lacks it."""
    kind = F.when((F.col("event_type") != "view") | (F.col("value") <= 50), F.col("event_type")).alias("kind")
    rows = t.events.select(kind, (F.col("value") > 50).alias("high"))
    return stats.class_frequencies(rows, "kind", "high").withColumn("share", F.round("share", 9))


FEATURES = ["l_returnflag", "l_discount", "l_tax"]


@query("""SELECT l_returnflag, l_discount, l_tax, count(*) FILTER (l_linestatus <> 'O') AS n_false,
 count(*) FILTER (l_linestatus = 'O') AS n_true, count(*) AS total FROM lineitem
GROUP BY ALL HAVING count(DISTINCT l_linestatus = 'O') > 1""")
def label_conflicts(t):
    rows = t.lineitem.withColumn("y", (F.col("l_linestatus") == "O").cast("int"))
    return stats.label_conflicts(rows, FEATURES, "y")


@query("""WITH p AS (SELECT *, l_linestatus = 'O' AS y FROM lineitem),
 k AS (SELECT l_returnflag, l_discount, l_quantity, l_suppkey FROM p GROUP BY ALL HAVING count(DISTINCT y) > 1)
SELECT p.l_orderkey, p.l_linenumber, p.l_suppkey FROM p JOIN k ON k.l_returnflag = p.l_returnflag AND k.l_discount = p.l_discount
 AND k.l_quantity = p.l_quantity AND k.l_suppkey = p.l_suppkey""")
def conflict_rows(t):
    rows = t.lineitem.withColumn("y", (F.col("l_linestatus") == "O").cast("int"))
    found = stats.conflict_rows(rows, ["l_returnflag", "l_discount", "l_quantity", "l_suppkey"], "y")
    return found.select("l_orderkey", "l_linenumber", "l_suppkey")


@query(f"""SELECT count(*) AS n_rows, count(*) FILTER (status IS NOT NULL AND priority IS NOT NULL) AS n_counted,
 count(*) = count(*) FILTER (status IS NOT NULL AND priority IS NOT NULL) AS consistent FROM ({GAPS_SQL})""")
def pattern_check(t):
    rows = orders_with_gaps(t).withColumn("y", (F.col("price") > 250000).cast("int"))
    return stats.pattern_check(rows, ["status", "priority"], "y")


@query("""WITH n AS (SELECT count(*) FILTER (toxic = 1) AS p, count(*) FILTER (toxic <> 1) AS q FROM labels)
SELECT p AS n_pos, q AS n_neg, round(q / p, 9) AS pos_weight, round((p + q) / (2 * p), 9) AS balanced_pos,
 round((p + q) / (2 * q), 9) AS balanced_neg FROM n""")
def class_balance(t):
    out = stats.class_balance(t.labels, "toxic")
    return out.withColumns({c: F.round(c, 9) for c in ("pos_weight", "balanced_pos", "balanced_neg")})


@query()
def fingerprint(t):
    return stats.fingerprint(t.orders)
