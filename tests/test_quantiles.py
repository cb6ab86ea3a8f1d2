"""Exact quantiles against sorted lists, on awkward distributions and with few bins."""

import math
import random

import pytest

from ledgerline.operators import stats
from ledgerline.operators.quantiles import exact_quantiles


def plain(values, share):
    values = sorted(v for v in values if v is not None and not math.isnan(v))
    if not values:
        return None
    p = (len(values) - 1) * share
    a, b = values[math.floor(p)], values[math.ceil(p)]
    return a if a == b or p == math.floor(p) else a + (b - a) * (p - math.floor(p))


def columns():
    rng = random.Random(4)
    tiny = [1.0 + i * 2.0 ** -52 for i in range(300)]
    yield "even", [rng.random() for _ in range(999)]
    yield "heavy", [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(999)]
    yield "ends", [float("inf")] * 300 + [float("-inf")] * 300 + [rng.gauss(0, 1) for _ in range(399)]
    yield "close", [rng.choice(tiny) for _ in range(999)]
    yield "ties", [0.0] * 500 + [1e9] * 300 + [-2.5] * 199
    yield "gaps", [None if i % 3 else float("nan") if i % 2 else i * 1.5 for i in range(999)]
    yield "none", [None] * 999
    yield "one", [7.25] + [None] * 998
    yield "two", [1.0, 2.0] + [None] * 997


@pytest.mark.parametrize("bins, listed", [(1024, 10_000), (12, 60)])
def test_quantiles_match_sorted_lists(spark, bins, listed):
    data = dict(columns())
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"{c} double" for c in data)).repartition(5)
    shares = (0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0)
    got = exact_quantiles(df, list(data), shares, bins, listed)
    assert {c: got[c] for c in data} == {c: [plain(v, s) for s in shares] for c, v in data.items()}


def test_summary_and_info_of_odd_tables(spark):
    empty = spark.createDataFrame([], "`a b` long, c string")
    assert tuple(stats.summary(empty, ["a b"]).first()) == ("a b", 0, None, None, None, None, None, None, None)
    rows = spark.createDataFrame([(1, None), (2, "x"), (None, "y")], "`a b` long, c string")
    r = stats.summary(rows, ["a b"]).first()
    assert (r.n, r.q25, r.q50, r.q75) == (2, 1.25, 1.5, 1.75)
    assert [tuple(x) for x in stats.table_info(rows).collect()] == [(0, "a b", "bigint", 2, 1), (1, "c", "string", 2, 1)]
    assert [x.n_filled for x in stats.table_info(empty).collect()] == [0, 0]
