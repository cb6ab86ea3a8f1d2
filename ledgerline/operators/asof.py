"""Joins in time: history before an event, last record before it, nearest record.

Both sides are stacked and each event reads a running value, so an entity's events
never meet all of its history rows. If an entity is oversized, its rows are first
collapsed to one per time, which lets ``running`` split the entity between times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.columns import order_value
from ledgerline.functions.dates import MICROS_PER_DAY, years_between_floor_days
from ledgerline.operators.running import HotGroups, Running, hot_groups, order_position, running
from ledgerline.operators.skew import join_unique


def asof_history(events: DataFrame, history: DataFrame, key: str, event_time: str, history_time: str,
                 prefix: str = "history_") -> DataFrame:
    """Count, oldest and youngest age in years of the history dated strictly before each event."""
    h = _history(history, key, history_time)
    values = {"__n": Running("count", F.col("__h.t")), "__lo": Running("min", F.col("__h.t")),
              "__hi": Running("max", F.col("__h.t"))}
    merged = {"__n": ("sum", F.lit(1)), "__lo": ("min", F.col("__h.t")), "__hi": ("max", F.col("__h.t"))}
    out = _before(events, h, key, event_time, values, merged)
    return out.select(
        *_event_columns(events, key),
        F.col("__n").alias(f"{prefix}count"),
        years_between_floor_days("__lo", f"__e.{event_time}").alias(f"{prefix}oldest_years"),
        years_between_floor_days("__hi", f"__e.{event_time}").alias(f"{prefix}youngest_years"))


def asof_last(events: DataFrame, history: DataFrame, key: str, event_time: str, history_time: str,
              fields: Sequence[str], ordinal: str | Sequence[str], prefix: str = "last_",
              by: str = "ordinal") -> DataFrame:
    """Fields of the last history row strictly before each event.

    "Last" follows the row order given by ``ordinal``; ``by='date'`` takes the
    latest date instead (row order breaks ties).
    """
    rank = _rank(history_time, ordinal, by)
    h = _history(history, key, history_time, F.struct(rank, F.struct(*fields).alias("f")).alias("r"))
    out = _before(events, h, key, event_time, {"__last": Running("max", F.col("__h.r"))},
                  {"__last": ("max", F.col("__h.r"))})
    return out.select(*_event_columns(events, key), *[F.col(f"__last.f.`{c}`").alias(f"{prefix}{c}") for c in fields])


def asof_enrich(events: DataFrame, history: DataFrame, key: str, event_time: str, history_time: str,
                fields: Sequence[str], ordinal: str | Sequence[str], prefix: str = "history_",
                last_prefix: str = "last_") -> DataFrame:
    """:func:`asof_history` and :func:`asof_last` over one shared exchange."""
    rank = _rank(history_time, ordinal, "ordinal")
    h = _history(history, key, history_time, F.struct(rank, F.struct(*fields).alias("f")).alias("r"))
    t, r = F.col("__h.t"), F.col("__h.r")
    values = {"__n": Running("count", t), "__lo": Running("min", t), "__hi": Running("max", t),
              "__last": Running("max", r)}
    merged = {"__n": ("sum", F.lit(1)), "__lo": ("min", t), "__hi": ("max", t), "__last": ("max", r)}
    out = _before(events, h, key, event_time, values, merged)
    return out.select(
        *_event_columns(events, key),
        F.col("__n").alias(f"{prefix}count"),
        years_between_floor_days("__lo", f"__e.{event_time}").alias(f"{prefix}oldest_years"),
        years_between_floor_days("__hi", f"__e.{event_time}").alias(f"{prefix}youngest_years"),
        *[F.col(f"__last.f.`{c}`").alias(f"{last_prefix}{c}") for c in fields])


def nearest_within(events: DataFrame, history: DataFrame, key: str, event_time: str, history_time: str,
                   fields: Sequence[str], ordinal: str, tolerance_days: int = 3,
                   prefix: str = "nearest_") -> DataFrame:
    """Fields of the history row nearest in time, either side; the first row wins ties.

    The gap is rounded down to days with its sign before its size is compared with
    the tolerance, so -2.5 days counts as 3 and +2.9 days as 2.
    """
    o = F.col(ordinal)
    pos = order_position(history, F.col(history_time))
    row = F.struct(pos.alias("p"), o.alias("o"), F.struct(*fields).alias("f"))
    h = _history(history, key, history_time, row.alias("r"), F.struct(pos.alias("p"), (-o).alias("neg"), row.alias("r")).alias("b"))
    e = _events(events, key, event_time)
    stacked = _stack(e, h)
    hot = hot_groups(stacked, "__key", "__pos")
    back, ahead = F.col("__h.b"), F.col("__h.r")
    # History before events at equal times, in both directions.
    tag = F.col("__tag")
    rows = hot.pick(stacked, False) if hot else stacked
    both = _both_sides(rows, back, ahead, ["__pos", -tag], ["__pos", tag]).filter(tag == 0).select(*_NEAR)
    if hot:
        per_time = hot.pick(stacked, True).groupBy("__key", "__pos").agg(
            F.max(back).alias("__b"), F.min(ahead).alias("__r"), F.max((tag == 0).cast("int")).alias("__ev"))
        found = _both_sides(per_time, F.col("__b"), F.col("__r"), ["__pos"], ["__pos"], hot).filter(F.col("__ev") == 1)
        split = _attach(hot.pick(e, True), found.select("__key", "__pos", "__prev", "__next"))
        both = both.unionByName(split.select(*_NEAR))
    at, before, after = F.col("__pos"), F.col("__prev"), F.col("__next")
    gap_b, gap_a = at - before["p"], after["p"] - at
    take_before = after.isNull() | (gap_b < gap_a) | ((gap_b == gap_a) & (before["o"] < after["o"]))
    near = F.when(before.isNotNull() & take_before, before).otherwise(after)
    days = F.floor((F.col("__near.p") - at) / F.lit(float(MICROS_PER_DAY)))
    ok = at.isNotNull() & (F.abs(days) < tolerance_days)
    return both.withColumn("__near", near).select(
        *_event_columns(events, key), *[F.when(ok, F.col(f"__near.f.`{c}`")).alias(f"{prefix}{c}") for c in fields])


_NEAR = ["__key", "__pos", "__e", "__prev", "__next"]


def _both_sides(rows: DataFrame, back: Column, ahead: Column, up: list, down: list, hot: HotGroups | None = None) -> DataFrame:
    """Latest record up to each row and earliest record from it on."""
    hot = hot or HotGroups(["__key"])
    prev = running(rows, "__key", up, {"__prev": Running("max", back)}, hot=hot)
    both = running(prev, "__key", down, {"__next": Running("min", ahead)}, descending=True, hot=hot)
    return both.withColumn("__prev", F.col("__prev.r"))


def _rank(history_time: str, ordinal: str | Sequence[str], by: str) -> Column:
    if by not in ("ordinal", "date"):
        raise ValueError(f"by must be 'ordinal' or 'date', not {by!r}")
    order = order_value(ordinal)
    return (order if by == "ordinal" else F.struct(F.col(history_time), order)).alias("o")


def _event_columns(events: DataFrame, key: str) -> list[Column]:
    """The events as they were; the key keeps the partitioning it was shuffled by."""
    return [F.col("__key").alias(c) if c == key else F.col(f"__e.`{c}`").alias(c) for c in events.columns]


def _events(events: DataFrame, key: str, time: str) -> DataFrame:
    pos = order_position(events, F.col(time))
    return events.select(F.col(key).alias("__key"), F.col(time).alias("__t"), pos.alias("__pos"),
                         F.lit(0).alias("__tag"), F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("__e"))


def _history(history: DataFrame, key: str, time: str, *payload: Column) -> DataFrame:
    """Rows that can be seen by an event: keyed and dated ones."""
    usable = history.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    pos = order_position(history, F.col(time))
    return usable.select(F.col(key).alias("__key"), F.col(time).alias("__t"), pos.alias("__pos"),
                         F.lit(1).alias("__tag"), F.struct(F.col(time).alias("t"), *payload).alias("__h"))


def _stack(e: DataFrame, h: DataFrame) -> DataFrame:
    return e.unionByName(h, allowMissingColumns=True)


def _before(events: DataFrame, h: DataFrame, key: str, time: str, values: dict[str, Running],
            merged: dict[str, tuple[str, Column]]) -> DataFrame:
    """Running values over the history rows strictly earlier than each event.

    Split entities go their own way, so all others keep the one exchange.
    """
    e = _events(events, key, time)
    stacked = _stack(e, h)
    hot = hot_groups(stacked, "__key", "__pos")
    kept = ["__key", "__pos", "__e", *values]
    # Events sort before history at equal times and so do not see it.
    rows = hot.pick(stacked, False) if hot else stacked
    plain = running(rows, "__key", ["__pos", F.col("__tag")], values, hot=HotGroups(["__key"]))
    plain = plain.filter(F.col("__tag") == 0).select(*kept)
    if not hot:
        return plain
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    past = F.col("__tag") == 1
    per_time = hot.pick(stacked, True).groupBy("__key", "__pos").agg(
        *[fold[kind](F.when(past, c)).alias(f"{n}_at") for n, (kind, c) in merged.items()],
        F.max((F.col("__tag") == 0).cast("int")).alias("__ev"))
    at_times = {n: Running(kind, F.col(f"{n}_at")) for n, (kind, _) in merged.items()}
    seen = running(per_time, "__key", ["__pos"], at_times, include_current=False, hot=hot)
    state = seen.filter(F.col("__ev") == 1).select("__key", "__pos", *values)
    zero = {n: F.coalesce(F.col(n), F.lit(0)) for n, (kind, _) in merged.items() if kind == "sum"}
    return plain.unionByName(_attach(hot.pick(e, True), state).withColumns(zero).select(*kept))


def _attach(e: DataFrame, state: DataFrame) -> DataFrame:
    """Bring the per-time values back to every event of that time."""
    s = state.withColumnsRenamed({"__key": "__skey", "__pos": "__spos"})
    return join_unique(e, s, {"__key": "__skey", "__pos": "__spos"}, null_safe=True).drop("__skey", "__spos")
