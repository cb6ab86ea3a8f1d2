"""Temporal joins against brute force, with and without split groups."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.asof import asof_enrich, asof_history, asof_last, nearest_within
from ledgerline.operators.running import Running, running

T0 = dt.datetime(2023, 1, 1)


def _rows(seed, n_events=60, n_history=120):
    rnd = random.Random(seed)
    # One key holds about a third of the rows; times repeat often.
    keys = ["a"] * 6 + [f"k{i}" for i in range(12)] + [None]

    def t():
        return None if rnd.random() < 0.05 else T0 + dt.timedelta(hours=12 * rnd.randrange(40))

    events = [(i, rnd.choice(keys), t()) for i in range(n_events)]
    history = [(rnd.choice(keys), t(), i, f"v{i}" if rnd.random() < 0.8 else None) for i in rnd.sample(range(1000), n_history)]
    return events, history


def _frames(spark, events, history):
    e = spark.createDataFrame(events, "id long, k string, et timestamp_ntz")
    h = spark.createDataFrame(history, "k string, ht timestamp_ntz, ord long, v string")
    return e, h


def _past(event, history):
    return [h for h in history if event[1] is not None and h[0] == event[1] and event[2] is not None
            and h[1] is not None and h[1] < event[2]]


def _check_before(spark, events, history):
    e, h = _frames(spark, events, history)
    got = {r.id: r for r in asof_enrich(e, h, "k", "et", "ht", ["ord", "v"], "ord").collect()}
    plain = {r.id: r for r in asof_history(e, h, "k", "et", "ht").collect()}
    last = {r.id: r for r in asof_last(e, h, "k", "et", "ht", ["ord", "v"], "ord").collect()}
    dated = {r.id: r for r in asof_last(e, h, "k", "et", "ht", ["ord"], "ord", by="date").collect()}
    assert len(got) == len(events)
    for ev in events:
        past = _past(ev, history)
        r = got[ev[0]]
        assert (r.k, r.et) == (ev[1], ev[2])
        assert r.history_count == plain[ev[0]].history_count == len(past)
        if not past:
            assert r.history_oldest_years is None and r.last_ord is None and last[ev[0]].last_ord is None
            continue
        oldest = math.floor((ev[2] - min(h[1] for h in past)).total_seconds() / 86400) / 365.25
        youngest = math.floor((ev[2] - max(h[1] for h in past)).total_seconds() / 86400) / 365.25
        assert r.history_oldest_years == pytest.approx(oldest)
        assert r.history_youngest_years == pytest.approx(youngest)
        want = max(past, key=lambda h: h[2])
        assert (r.last_ord, r.last_v) == (want[2], want[3]) == (last[ev[0]].last_ord, last[ev[0]].last_v)
        assert dated[ev[0]].last_ord == max(past, key=lambda h: (h[1], h[2]))[2]


def _check_nearest(spark, events, history):
    e, h = _frames(spark, events, history)
    got = {r.id: r for r in nearest_within(e, h, "k", "et", "ht", ["ord", "v"], "ord").collect()}
    assert len(got) == len(events)
    for ev in events:
        near = [x for x in history if x[0] is not None and x[0] == ev[1] and x[1] is not None] if ev[2] else []
        want = None
        if near:
            best = min(near, key=lambda x: (abs(x[1] - ev[2]), x[2]))
            if abs(math.floor((best[1] - ev[2]).total_seconds() / 86400)) < 3:
                want = best[2]
        assert got[ev[0]].nearest_ord == want


@pytest.mark.parametrize("seed", [1, 2])
def test_before_matches_brute_force(spark, seed):
    _check_before(spark, *_rows(seed))


@pytest.mark.parametrize("seed", [1, 2])
def test_before_with_split_groups(spark, split_groups, seed):
    _check_before(spark, *_rows(seed))


def test_nearest_matches_brute_force(spark):
    _check_nearest(spark, *_rows(3))


def test_nearest_with_split_groups(spark, split_groups):
    _check_nearest(spark, *_rows(3))


def test_nearest_tolerance_is_floor_days(spark):
    d = dt.timedelta
    cases = [(-2.5, None), (2.9, 1), (3.0, None), (-2.0, 1), (-3.0, None)]
    events = [(i, f"k{i}", T0) for i in range(len(cases))]
    history = [(f"k{i}", T0 + d(days=gap), 1, "x") for i, (gap, _) in enumerate(cases)]
    events.append((90, "tie", T0))
    history += [("tie", T0 + d(days=2), 5, "after"), ("tie", T0 - d(days=2), 7, "before")]
    events.append((91, "undated", T0))
    history.append(("undated", None, 1, "x"))
    e, h = _frames(spark, events, history)
    got = {r.id: r for r in nearest_within(e, h, "k", "et", "ht", ["ord", "v"], "ord").collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i].nearest_ord == want
    assert got[90].nearest_v == "after"
    assert got[91].nearest_ord is None


def test_running_split_equals_unsplit(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "a", "b", None]), rnd.randrange(30), i, rnd.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, p int, i int, v double")
    values = {"n": Running("count", F.col("v")), "s": Running("sum", F.lit(1).cast("long")),
              "lo": Running("min", F.col("v")), "hi": Running("max", F.struct("v", "i"))}
    for keys in (["k"], []):
        for down in (False, True):
            for current in (False, True):
                def run():
                    return sorted(map(str, running(df, keys, ["p", "i"], values, descending=down,
                                                   include_current=current).collect()))
                plain = run()
                spark.conf.set("spark.ledgerline.hotGroupRows", "20")
                try:
                    assert run() == plain
                finally:
                    spark.conf.unset("spark.ledgerline.hotGroupRows")
