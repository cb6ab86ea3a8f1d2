"""Profiles and statistics on hand-made edge tables."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import stats
from ledgerline.operators.profile import Out, entity_profile, one_aggregate

D = dt.datetime


def tuples(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_modes_and_order(spark):
    rows = [("k", v, i) for i, v in enumerate(["b", "a", None, "b", "a"])] + [("n", None, 9), (None, "z", 10)]
    df = spark.createDataFrame(rows, "k string, v string, o int")
    outs = [Out("mode", "v", "mode"), Out("last", "v", "last"), Out("filled", "v", "last_filled"), Out("second", "v", "nth_last_filled", 2),
            Out("fifth", "v", "nth_last_filled", 5), Out("n", "v", "count")]
    assert tuples(entity_profile(df, "k", "o", outs), "k") == [("k", "a", "a", "a", "b", None, 4), ("n", None, None, None, None, None, 0)]
    assert tuples(one_aggregate(df, "k", "v", "mode", "m", "o"), "k") == [("k", "a"), ("n", None)]
    with pytest.raises(ValueError, match="known"):
        entity_profile(df, "k", "o", [Out("x", "v", "median")])


def test_booleans_and_trailing_nulls(spark):
    df = spark.createDataFrame([("k", True, 0), ("k", False, 1), ("k", None, 2)], "k string, v boolean, o int")
    assert tuples(entity_profile(df, "k", "o", [Out("mode", "v", "mode"), Out("last", "v", "last"), Out("filled", "v", "last_filled")])) == [
        ("k", False, None, False)]


def test_dates_with_null(spark):
    days = {"a": [D(2023, 1, 5), None, D(2023, 1, 1), D(2023, 1, 3)], "b": [D(2023, 1, 1)], "c": [None, None]}
    df = spark.createDataFrame([(k, d, i) for k, ds in days.items() for i, d in enumerate(ds)], "k string, t timestamp_ntz, o int")
    outs = [Out("gap", "t", "mean_gap_days"), Out("top", "t", "largest"), Out("bad", "t", "largest_poisoned"),
            Out("second", "t", "nth_largest", 2), Out("bad2", "t", "nth_largest", 2, "poison"), Out("bad3", "t", "nth_largest", 3, "poison")]
    assert tuples(entity_profile(df, "k", "o", outs), "k") == [
        ("a", 2.0, D(2023, 1, 5), None, D(2023, 1, 3), D(2023, 1, 5), D(2023, 1, 3)),
        ("b", None, D(2023, 1, 1), D(2023, 1, 1), None, None, None), ("c", None, None, None, None, None, None)]
    # The closed form is the mean of the gaps between consecutive dates.
    gaps = pd.Series(sorted(d for d in days["a"] if d)).diff().dropna()
    assert gaps.mean().total_seconds() / 86400 == 2.0


def test_weeks(spark):
    df = spark.createDataFrame([(D(2023, 1, 1),), (D(2023, 1, 2),), (D(2023, 1, 8, 23),), (D(2023, 1, 25),), (None,)], "t timestamp_ntz")
    got = {str(a): n for a, n in tuples(stats.weekly_counts(df, "t"))}
    want = df.toPandas().dropna().set_index("t").resample("W").size()
    assert got == {str(k.date()): v for k, v in want.items()}
    months = {str(a): n for a, n in tuples(stats.monthly_counts(df.union(spark.createDataFrame([(D(2023, 4, 30),)], df.schema)), "t"))}
    assert months == {"2023-01-31": 4, "2023-02-28": 0, "2023-03-31": 0, "2023-04-30": 1}
    assert stats.weekly_counts(df.filter("t is null"), "t").count() == 0


@pytest.mark.parametrize("split", [False, True])
def test_grouped_lists(spark, request, split):
    if split:
        request.getfixturevalue("split_groups")
    rows = [("a", i, None if i % 3 == 0 else i * 10) for i in range(20)] + [("b", 5, 1), (None, 1, 1)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = tuples(stats.grouped_lists(df, "k", "o", ["o", "v"], 8), "k", "part")
    assert [(k, p, o) for k, p, o, _ in got] == [("a", 0, list(range(8))), ("a", 1, list(range(8, 16))), ("a", 2, list(range(16, 20))), ("b", 0, [5])]
    assert got[0][3][:4] == [None, 10, 20, None]


def test_conflicts(spark):
    df = spark.createDataFrame([(1.001, "x", 1), (1.002, "x", 0), (2.0, "x", 1), (3.0, None, 1), (3.0, None, 0)], "a double, b string, y int")
    assert tuples(stats.label_conflicts(df, ["a", "b"], "y")) == []
    assert tuples(stats.label_conflicts(df, ["a", "b"], "y", decimals=1)) == [(1.0, "x", 1, 1, 2)]
    assert tuples(stats.pattern_check(df, ["a", "b"], "y")) == [(5, 3, False)]
    assert tuples(stats.conflict_rows(df.withColumn("a", F.round("a", 1)), ["a", "b"], "y").select("y"), "y") == [(0,), (1,)]


def test_distributions(spark):
    df = spark.createDataFrame([(float(v), "p" if v % 2 else "q") for v in range(21)] + [(None, "p")], "v double, c string")
    wide = tuples(stats.class_distribution(df, "v", "c", 10))
    assert len(wide[0]) == 5 and sum(r[2] for r in wide) == 21
    few = tuples(stats.class_distribution(df.withColumn("v", F.col("v") % 2), "v", "c"), "value", "class")
    assert few == [(0.0, "p", 0, 0.0), (0.0, "q", 11, 1.0), (1.0, "p", 10, 1.0), (1.0, "q", 0, 0.0)]
    one = tuples(stats.histogram(df.limit(1), "v", 4))
    assert one[0][0] == 2 and one[0][1] == 1
    assert stats.columns_named(df, "v") == ["v"]


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    a = tuples(stats.fingerprint(df))
    assert a == tuples(stats.fingerprint(df.orderBy(F.desc("id")))) and a != tuples(stats.fingerprint(df.withColumn("v", F.col("v") + 1)))


def test_top_and_share(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), ("c",)], "v string")
    assert tuples(stats.top_values(df, "v", 2)) == [("a", 2), ("b", 2)]
    assert df.agg(stats.share_equal("v", "a")).first()[0] == pytest.approx(2 / 6)
    rates = tuples(stats.rate_per_100k(df, "v", {"a": 1000, "b": 0}, {"c": "a"}), "v")
    assert rates == [("a", 3, 1000, 300.0), ("b", 2, 0, None)]
