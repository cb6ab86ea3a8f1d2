"""Joins in time, on the event ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import asof
from ledgerline.queries.registry import Tables, query


def events_of(t: Tables, kind: str, event_id: str, time: str) -> DataFrame:
    """Events of one type with their times cut to the day, so that ties occur."""
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    return t.events.filter(F.col("event_type") == kind).select(
        F.col("event_id").alias(event_id), "user_id", day.alias(time), F.col("value").alias(f"{event_id}_value"))


A_SQL = """a AS (SELECT event_id AS anchor, user_id, date_trunc('day', ts)::TIMESTAMP AS at_time FROM events WHERE event_type = 'purchase'),
 h AS (SELECT event_id AS past, user_id, date_trunc('day', ts)::TIMESTAMP AS t, value AS past_value FROM events WHERE event_type = '{}')"""


@query(f"""WITH {A_SQL.format("error")}
SELECT anchor, a.user_id, count(past) AS history_count,
 round(floor(date_diff('second', min(t), any_value(at_time)) / 86400.0)::DOUBLE / 365.25, 9) AS history_oldest_years,
 round(floor(date_diff('second', max(t), any_value(at_time)) / 86400.0)::DOUBLE / 365.25, 9) AS history_youngest_years
FROM a LEFT JOIN h ON h.user_id = a.user_id AND t < at_time GROUP BY anchor, a.user_id""")
def asof_history(t):
    out = asof.asof_history(events_of(t, "purchase", "anchor", "at"), events_of(t, "error", "past", "t"), "user_id", "at", "t")
    return out.select("anchor", "user_id", "history_count", F.round("history_oldest_years", 9).alias("history_oldest_years"),
                      F.round("history_youngest_years", 9).alias("history_youngest_years"))


@query(f"""WITH {A_SQL.format("error")}, j AS (SELECT anchor, a.user_id, past, past_value,
 row_number() OVER (PARTITION BY anchor ORDER BY past_value DESC NULLS LAST, past DESC NULLS LAST) AS rn
 FROM a LEFT JOIN h ON h.user_id = a.user_id AND t < at_time)
SELECT anchor, user_id, past AS last_past, past_value AS last_past_value FROM j WHERE rn = 1""")
def asof_last_record(t):
    # Row order by value: it differs from time order.
    out = asof.asof_last(events_of(t, "purchase", "anchor", "at"), events_of(t, "error", "past", "t"), "user_id", "at", "t",
                         ["past", "past_value"], ["past_value", "past"])
    return out.select("anchor", "user_id", "last_past", "last_past_value")


@query(f"""WITH {A_SQL.format("view")}, j AS (SELECT anchor, a.user_id, count(past) OVER (PARTITION BY anchor) AS n, past,
 row_number() OVER (PARTITION BY anchor ORDER BY past DESC NULLS LAST) AS rn
 FROM a LEFT JOIN h ON h.user_id = a.user_id AND t < at_time)
SELECT anchor, user_id, n AS history_count, past AS last_past FROM j WHERE rn = 1""")
def asof_enrich(t):
    out = asof.asof_enrich(events_of(t, "purchase", "anchor", "at"), events_of(t, "view", "past", "t"), "user_id", "at", "t",
                           ["past"], "past")
    return out.select("anchor", "user_id", "history_count", "last_past")


@query(f"""WITH {A_SQL.format("click")}, j AS (SELECT anchor, a.user_id, past, past_value,
 row_number() OVER (PARTITION BY anchor ORDER BY t DESC NULLS LAST, past DESC NULLS LAST) AS rn
 FROM a LEFT JOIN h ON h.user_id = a.user_id AND t < at_time)
SELECT anchor, user_id, past AS last_past, past_value AS last_past_value FROM j WHERE rn = 1""")
def asof_latest_date(t):
    out = asof.asof_last(events_of(t, "purchase", "anchor", "at"), events_of(t, "click", "past", "t"), "user_id", "at", "t",
                         ["past", "past_value"], "past", by="date")
    return out.select("anchor", "user_id", "last_past", "last_past_value")


@query("""WITH a AS (SELECT event_id AS anchor, user_id, ts AS at_time FROM events WHERE event_type = 'purchase'),
 h AS (SELECT event_id AS past, user_id, ts AS t, value AS past_value FROM events WHERE event_type = 'signup'),
 j AS (SELECT anchor, a.user_id, past, past_value, epoch_us(t) - epoch_us(at_time) AS gap,
  row_number() OVER (PARTITION BY anchor ORDER BY abs(epoch_us(t) - epoch_us(at_time)) NULLS LAST, past) AS rn
  FROM a LEFT JOIN h ON h.user_id = a.user_id)
SELECT anchor, user_id, CASE WHEN abs(floor(gap / 86400000000.0)) < 3 THEN past END AS nearest_past,
 CASE WHEN abs(floor(gap / 86400000000.0)) < 3 THEN past_value END AS nearest_past_value FROM j WHERE rn = 1""")
def nearest_within(t):
    purchases = t.events.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("anchor"), "user_id", F.col("ts").alias("at"))
    signups = t.events.filter(F.col("event_type") == "signup").select(
        F.col("event_id").alias("past"), "user_id", F.col("ts").alias("t"), F.col("value").alias("past_value"))
    out = asof.nearest_within(purchases, signups, "user_id", "at", "t", ["past", "past_value"], "past")
    return out.drop("at")
