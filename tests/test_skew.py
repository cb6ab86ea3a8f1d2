"""Joins with oversized keys give what plain joins give."""

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import link, rows, skew, stats
from ledgerline.operators.skew import join_unique, oversized


@pytest.fixture(scope="module")
def frames(spark):
    # One key and the null key hold a third of the rows each; exact copies among them.
    left = spark.createDataFrame([("hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i % 20}", i // 6, i % 2) for i in range(120)],
                                 "k string, v int, y int").repartition(4)
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k5", 3), (None, 4), ("zz", 5)], "r string, w int")
    return left, right


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_join_unique(spark, frames, split_groups, how, null_safe):
    left, right = frames
    assert {r.k for r in oversized(left, ["k"])} >= {"hot", None}
    same = F.col("k").eqNullSafe(F.col("r")) if null_safe else F.col("k") == F.col("r")
    want = sorted(map(str, left.join(right, same, how).collect()))
    assert sorted(map(str, join_unique(left, right, {"k": "r"}, how, null_safe).collect())) == want


def test_oversized_keys_are_spread(spark, frames, split_groups):
    left, right = frames
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = join_unique(left, right, {"k": "r"}).filter("k = 'hot'").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert parts > 1


def test_small_inputs_are_not_counted(spark, frames):
    assert oversized(frames[0], ["k"]) == []


def test_operators_agree(spark, frames):
    left, right = frames
    left = left.withColumn("o", F.monotonically_increasing_id()).cache()
    ops = {
        "lookup": lambda: link.lookup_unique(left, right, "k", "r", {"w": "w"}),
        "flag": lambda: link.with_membership(left, right, "k", "r", "hit"),
        "anti": lambda: link.only_in(left, right, "k", "r"),
        "latest": lambda: link.with_latest(left, right, "k", "r", "w"),
        "other": lambda: link.with_first_other(left, "k", "v", "o"),
        "pair": lambda: link.with_counterpart(left, "v", "y"),
        "marks": lambda: rows.mark_duplicates(left, ["k", "v"], "o"),
        "conflicts": lambda: stats.conflict_rows(left, ["k"], "y"),
    }
    plain = {n: sorted(map(str, f().collect())) for n, f in ops.items()}
    spark.conf.set("spark.ledgerline.hotGroupRows", "5")
    try:
        for n, f in ops.items():
            assert sorted(map(str, f().collect())) == plain[n], n
    finally:
        spark.conf.unset("spark.ledgerline.hotGroupRows")


@pytest.mark.parametrize("sketch", [True, False])
def test_all_of_many_oversized_keys_are_found_and_spread(spark, monkeypatch, sketch):
    monkeypatch.setattr(skew, "MISSED", 1e-6 if sketch else 1.0)
    keys = spark.range(5000).select(F.when(F.col("id") > 0, F.concat(F.lit("k"), "id")).alias("k"))  # one key is null
    left = keys.withColumn("v", F.explode(F.sequence(F.lit(1), F.lit(7)))).unionByName(spark.range(3000).select(F.concat(F.lit("rare"), "id").alias("k"), F.lit(1).alias("v")))
    right = keys.filter("k IS NOT NULL").select(F.col("k").alias("r"), F.length("k").alias("w"))
    spark.conf.set("spark.ledgerline.hotGroupRows", "6")
    try:
        found = skew.oversized(left, ["k"])
        assert len(found) == 5000 and all(r["__n"] == 7 for r in found)
        assert all(n == 2 for n in skew.parts_of(found, 6))
        got = join_unique(left, right, {"k": "r"}, hot=found)
        assert got.count() == 38000 and got.filter("w IS NULL").count() == 3007
        assert got.filter("w = length(k)").count() == 4999 * 7
    finally:
        spark.conf.unset("spark.ledgerline.hotGroupRows")
