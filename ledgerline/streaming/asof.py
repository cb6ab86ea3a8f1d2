"""The last record before each event, when both come as streams."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

_EVENT, _RECORD = 0, 1  # at equal times events come first: a record counts for later ones only
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def asof_last_stream(events: DataFrame, history: DataFrame, key: str, event_time: str, history_time: str, fields: Sequence[str],
                     ordinal: str, delay: str = "1 day", prefix: str = "last_") -> DataFrame:
    """Each event with the fields of the last of its key's records (by ``ordinal``) dated strictly before it.

    The streamed form of ``asof_last``. An event is given out once the watermark, which
    trails the latest time seen by ``delay``, has passed it, as no earlier record can come
    after that. The state of a key is its best record so far and what the watermark has not
    passed yet. Rows that come later than that are dropped by Spark, which counts them
    (numRowsDroppedByWatermark); rows without a key or time match nothing and are left out.
    """
    body = StructType([f for f in events.schema.fields])
    record = StructType([history.schema[c] for c in fields])

    def rows(df: DataFrame, time: str, kind: int, rank: Column, columns: Sequence[str]) -> DataFrame:
        found = df.filter(F.col(time).isNotNull() & F.col(key).isNotNull()).select(
            F.col(key).cast("string").alias("__key"), F.col(time).cast("timestamp").alias("__time"), F.lit(kind).alias("__kind"), rank.alias("__rank"),
            F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), _JSON).alias("__body"))
        return found

    both = rows(events, event_time, _EVENT, F.lit(0).cast("long"), events.columns).unionByName(
        rows(history, history_time, _RECORD, F.col(ordinal).cast("long"), fields))
    timed = both.withWatermark("__time", delay).withColumn("__micros", F.unix_micros("__time"))
    found = timed.groupBy("__key").applyInPandasWithState(
        _advance, "event string, record string", "rank long, record string, pending string", "append", GroupStateTimeout.EventTimeTimeout)
    parsed = found.select(F.from_json("event", body, _JSON).alias("e"), F.from_json("record", record, _JSON).alias("r"))
    return parsed.select("e.*", *[F.col(f"r.`{c}`").alias(f"{prefix}{c}") for c in fields])


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Give out the events that the watermark has passed, in the order of time."""
    rank, record, held = state.get if state.exists else (None, None, "[]")
    pending = json.loads(held)
    for pdf in frames:
        pending += [list(map(_plain, r)) for r in pdf[["__micros", "__kind", "__rank", "__body"]].itertuples(index=False)]
    passed = state.getCurrentWatermarkMs() * 1000
    pending.sort(key=lambda r: (r[0], r[1]))
    out = []
    while pending and pending[0][0] <= passed:
        _, kind, own, body = pending.pop(0)
        if kind == _EVENT:
            out.append((body, record))
        elif own is not None and (rank is None or own > rank):
            rank, record = own, body
    state.update((rank, record, json.dumps(pending)))
    waiting = next((r[0] for r in pending if r[1] == _EVENT), None)
    if waiting is not None:
        state.setTimeoutTimestamp(max(-(-waiting // 1000), state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=["event", "record"], dtype=object)


def _plain(x):
    return None if x is None or x != x else x.item() if hasattr(x, "item") else x
