"""Row operators and joins on hand-made edge tables."""

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import link, rows


def tuples(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="module")
def dups(spark):
    return spark.createDataFrame(
        [("a", 1, 0), ("a", 1, 1), ("a", 1, 2), ("b", 1, 3), ("c", 1, 4), (None, None, 5), (None, None, 6)], "k string, v int, o int")


def test_duplicates(dups):
    two = dups.drop("o")
    assert rows.distinct_rows(two).count() == 4
    assert tuples(rows.duplicates_removed(two)) == [(7, 4, 3)]
    assert tuples(rows.first_by(dups, ["k", "v"], "o"), "o") == [("a", 1, 0), ("b", 1, 3), ("c", 1, 4), (None, None, 5)]
    assert tuples(rows.first_by(dups, ["v"], "o"), "o") == [("a", 1, 0), (None, None, 5)]
    # Sets that agree on v: five rows with 1 and two with null.
    assert tuples(rows.duplicate_counts(two, ["k"])) == [(3, 7)]


def test_duplicate_marks(dups):
    first = tuples(rows.mark_duplicates(dups, ["k", "v"], "o"), "o")
    assert [r[3] for r in first] == [False, True, True, False, False, False, True]
    every = tuples(rows.mark_duplicates(dups, ["k", "v"], "o", keep_first=False), "o")
    assert [r[3] for r in every] == [True, True, True, False, False, True, True]


def test_null_rules(spark):
    df = spark.createDataFrame([(1, None, None, None), (1, 2, None, float("nan")), (None, None, None, None)], "a int, b int, c int, `d.e` double")
    assert rows.keep_filled(df, 2).count() == 1
    assert rows.mostly_null(df, 2).count() == 2
    assert rows.drop_empty_columns(df.select("a", "b", "c")).columns == ["a", "b"]


def test_flags_with_null_keys(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    right = spark.createDataFrame([("a",), ("a",), (None,)], "r string")
    assert tuples(link.with_membership(left, right, "k", "r", "hit"), "k") == [(None, 0), ("a", 1), ("b", 0)]
    assert tuples(link.only_in(left, right, "k", "r"), "k") == [(None,), ("b",)]
    assert tuples(link.also_in(left, right, "k", "r")) == [("a",)]
    assert tuples(link.key_overlap(left, right, "k", "r")) == [(2, 1, 1, 1, 0)]


def test_unique_lookup(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    registry = spark.createDataFrame([("a", "x"), ("c", None)], "r string, w string")
    assert tuples(link.lookup_unique(left, registry, "k", "r", {"w": "w"}), "v") == [("a", 1, "x"), ("b", 2, None), (None, 3, None)]
    # An existing column of that name is replaced.
    assert link.lookup_unique(left, registry, "k", "r", {"v": "w"}).columns == ["k", "v"]
    with pytest.raises(Exception, match="not unique"):
        link.lookup_unique(left, registry.unionByName(registry), "k", "r", {"w": "w"}).collect()


def test_dict_lookup(spark):
    left = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    table = spark.createDataFrame([("a", "old", 0), ("a", "new", 1), ("a", None, 2), ("b", None, 3), (None, "x", 4)], "r string, v string, o int")
    assert tuples(link.dict_lookup(left, table, "k", "r", "v", "o", "v"), "k") == [("a", "new"), ("b", None), ("c", None)]


def test_latest(spark):
    registry = spark.createDataFrame([("a", "x", 1, 0), ("a", None, 2, 1), ("b", None, None, 2)], "k string, v string, w int, o int")
    assert tuples(link.latest_per_key(registry, "k", "o", ["v", "w"]), "k") == [("a", "x", 2), ("b", None, None)]


def test_counterparts(spark):
    df = spark.createDataFrame(
        [("g1", "a"), ("g1", "b"), ("g1", "a"), ("g2", "a"), ("g3", "a"), ("g3", "b"), ("g3", "c"), ("g4", "a"), ("g4", None), (None, "a"), (None, "b")],
        "g string, m string").withColumn("o", F.monotonically_increasing_id())
    got = {(r.g, r.m, r.counterpart) for r in link.with_counterpart(df, "g", "m").collect()}
    assert got == {("g1", "a", "b"), ("g1", "b", "a"), ("g2", "a", None), ("g3", "a", None), ("g3", "b", None), ("g3", "c", None),
                   ("g4", "a", None), ("g4", None, "a"), (None, "a", None), (None, "b", None)}
    others = {(r.g, r.m, r.first_other) for r in link.with_first_other(df, "g", "m", "o").collect()}
    assert {("g3", "a", "b"), ("g3", "b", "a"), ("g3", "c", "a"), ("g1", "b", "a"), ("g2", "a", None)} <= others


def test_outer_chain(spark):
    a = spark.createDataFrame([("x", 1, "p"), (None, 2, "p")], "CEDULA string, va int, shared string")
    b = spark.createDataFrame([("x", 5, "q"), ("y", 6, "q"), (None, 7, "q")], "cedula2 string, vb int, shared string")
    merged = link.outer_chain([(a, "CEDULA"), (b, "cedula2")], match_null_keys=True)
    assert sorted(merged.columns) == ["CEDULA", "cedula2", "va", "vb"]
    got = set(tuples(merged.select("CEDULA", "va", "cedula2", "vb")))
    assert got == {("x", 1, "x", 5), (None, None, "y", 6), (None, 2, None, 7)}
    same = link.outer_chain([(a.drop("shared"), "CEDULA"), (b.drop("shared").withColumnRenamed("cedula2", "CEDULA"), "CEDULA")])
    assert same.count() == 4 and same.columns.count("CEDULA") == 1


def test_coverage_counts_null_registry_rows_as_orphans(spark):
    entities = spark.createDataFrame([("a",), ("b",)], "k string")
    registry = spark.createDataFrame([("a",), (None,), ("z",), ("z",)], "r string")
    assert tuples(link.coverage_report(entities, "k", {"r1": (registry, "r")})) == [("r1", 1, 1, 3)]


def test_empty_columns_and_repeated_registry_keys(spark):
    import pytest

    from ledgerline.operators import link, rows

    df = spark.createDataFrame([(1, float("nan"), None), (2, float("nan"), None)], "k long, x double, s string")
    assert rows.drop_empty_columns(df).columns == ["k"]
    registry = spark.createDataFrame([(1, "a"), (1, "b")], "rk long, v string")
    with pytest.raises(Exception, match="not unique"):
        link.lookup_unique(df, registry, "k", "rk", {"v": "v"}).count()


def test_outer_chain_deals_null_keys(spark):
    """Rows that only a later table has keep a null first key; the next join spreads them and matches none of them."""
    first = spark.range(20).select(F.col("id").alias("a"))
    later = spark.range(1000, 9000).select(F.col("id").alias("b"), F.col("id").alias("x"))
    last = spark.range(10, 30).select(F.col("id").alias("c"))
    merged = link.outer_chain([(first, "a"), (later, "b"), (last, "c")])
    rows = merged.collect()
    assert len(rows) == 20 + 8000 + 10
    assert sum(r.a is not None and r.c is not None for r in rows) == 10
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in link.outer_chain([(first, "a"), (later, "b"), (last, "c")])
                 .filter("a IS NULL").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert max(sizes) < 8000 / 2


def test_key_repeated_on_both_sides_is_an_error(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (None, "n"), (None, "m")], "k int, v string")
    b = spark.createDataFrame([(1, "z"), (None, "o"), (None, "p")], "k int, v string")
    assert link.merge_deliveries(a, b, "k").count() == 2
    with pytest.raises(ValueError, match="repeats on both sides"):
        link.merge_deliveries(a, b.union(b), "k")
    assert link.merge_deliveries(a, b.union(b), "k", repeated=True).count() == 4
