"""Frequencies, profiles, time series, distributions and label conflicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.columns import count_if, names
from ledgerline.functions.dates import month_end, week_ending_sunday
from ledgerline.functions.text import lookup
from ledgerline.functions.values import round_numeric
from ledgerline.operators.quantiles import exact_quantiles
from ledgerline.operators.running import Running, hot_groups, order_position, running
from ledgerline.operators.skew import join_unique


def frequencies(df: DataFrame, columns: str | Sequence[str], count: str = "n") -> DataFrame:
    """Counts per value (or tuple of values) with nulls left out, most frequent first."""
    columns = names(columns)
    filled = df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
    return filled.groupBy(*columns).agg(F.count(F.lit(1)).alias(count)).orderBy(F.desc(count), *columns)


def top_values(df: DataFrame, column: str, n: int = 20, count: str = "n") -> DataFrame:
    """The n most frequent values; the smaller value wins ties."""
    return frequencies(df, column, count).limit(n)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def values_containing(df: DataFrame, column: str, part: str) -> DataFrame:
    """Distinct values that contain a text; null does not."""
    return df.filter(F.col(column).contains(F.lit(part))).select(column).distinct()


def column_facts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows, nulls, distinct values (null counts as one), and range as text.

    Values are counted per column first, so a wide table is read once and a value
    shared by many rows is one row afterwards.
    """
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])))
    counted = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    facts = counted.groupBy("column").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.count(F.lit(1)).alias("n_distinct"))
    bounds = df.agg(*[f(F.col(f"`{c}`")).alias(f"{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))])
    ranges = bounds.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`lo_{c}`").cast("string").alias("min_value"),
                 F.col(f"`hi_{c}`").cast("string").alias("max_value")) for c in columns])))
    return facts.join(ranges, "column")


def column_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Value counts of several columns at once, as (column, value, n); nulls left out."""
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])))
    return cells.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def columns_named(df: DataFrame, part: str) -> list[str]:
    return [c for c in df.columns if part in c]


def summary(df: DataFrame, columns: Sequence[str], shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quantiles (q25, q50, q75) and maximum per numeric column."""
    first = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min_value": F.min}
    aggs = {**first, "max_value": F.max}
    found = exact_quantiles(df, columns, shares)
    cell = lambda c: F.col(f"`{c}`").cast("double")
    wide = df.agg(*[f(cell(c)).alias(f"{k}_{c}") for c in columns for k, f in aggs.items()])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{k}_{c}`").alias(k) for k in first],
                 *[F.lit(q).cast("double").alias(f"q{round(100 * s)}") for s, q in zip(shares, found[c])],
                 F.col(f"`max_value_{c}`").alias("max_value")) for c in columns])))


def table_info(df: DataFrame) -> DataFrame:
    """A row per column: position, name, type, filled and null cells."""
    counts = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(f"`{c}`")).alias(f"__n{i}") for i, c in enumerate(df.columns)])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(kind).alias("type"), F.col(f"__n{i}").alias("n_filled"),
                 (F.col("__rows") - F.col(f"__n{i}")).alias("n_null")) for i, (c, kind) in enumerate(df.dtypes)])))


def share_equal(column: str, value) -> Column:
    """Share of rows equal to a value; null is not equal."""
    return F.avg(F.col(column).eqNullSafe(F.lit(value)).cast("int"))


def _filled_series(counts: DataFrame, label: str, step: str) -> DataFrame:
    """Zero rows for the missing steps between the first and the last label.

    The spine has one row per period of the covered time.
    """
    limits = counts.agg(F.min(label).alias("lo"), F.max(label).alias("hi")).filter(F.col("lo").isNotNull())
    if step == "week":
        spine = limits.select(F.explode(F.expr("sequence(lo, hi, interval 7 days)")).alias(label))
    else:
        months = F.expr("sequence(trunc(lo, 'MM'), trunc(hi, 'MM'), interval 1 month)")
        spine = limits.select(F.explode(months).alias("m")).select(F.last_day("m").alias(label))
    return spine.join(counts, label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))


def weekly_counts(df: DataFrame, time: str, label: str = "week_end") -> DataFrame:
    """Rows per week, labelled by the Sunday that ends it; empty weeks count 0."""
    counts = df.filter(F.col(time).isNotNull()).groupBy(week_ending_sunday(time).alias(label)).agg(
        F.count(F.lit(1)).alias("n"))
    return _filled_series(counts, label, "week")


def monthly_counts(df: DataFrame, time: str, label: str = "month_end") -> DataFrame:
    """Rows per month, labelled by its last day; empty months count 0."""
    counts = df.filter(F.col(time).isNotNull()).groupBy(month_end(time).alias(label)).agg(F.count(F.lit(1)).alias("n"))
    return _filled_series(counts, label, "month")


def grouped_lists(df: DataFrame, key: str, ordinal: str, columns: Sequence[str], segment: int = 10_000) -> DataFrame:
    """Every column as lists per key in row order, nulls kept.

    A long list comes in segments of at most ``segment`` values (``part`` 0, 1, ...),
    so no row or task has to hold a whole large entity.
    """
    rows = df.filter(F.col(key).isNotNull())
    hot = hot_groups(rows, key, order_position(rows, F.col(ordinal)))
    placed = running(rows, key, [ordinal], {"__n": Running("count", F.lit(1))}, hot=hot)
    part = F.floor((F.col("__n") - 1) / segment).alias("part")
    lists = placed.groupBy(key, part).agg(F.sort_array(F.collect_list(F.struct("__n", *columns))).alias("__l"))
    return lists.select(key, "part", *[F.col("__l").getField(c).alias(c) for c in columns])


def dependency_violations(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """Values of the determinant that go with more than one distinct dependent value."""
    return (df.groupBy(determinant).agg(F.count_distinct(dependent).alias("n_values"))
            .filter(F.col("n_values") > 1))


def rate_per_100k(df: DataFrame, region: str, population: Mapping[str, int],
                  renames: Mapping[str, str] | None = None) -> DataFrame:
    """Rows per region and per 100 000 inhabitants; unknown regions get a null rate."""
    named = F.coalesce(lookup(region, renames), region) if renames else F.col(region)
    counts = df.filter(F.col(region).isNotNull()).groupBy(named.alias(region)).agg(F.count(F.lit(1)).alias("n"))
    people = lookup(region, population).cast("long")
    rate = F.try_divide(F.lit(100000.0) * F.col("n"), people)
    return counts.select(region, "n", people.alias("population"), rate.alias("rate"))


def histogram(df: DataFrame, column: str, bins: int, by: str | None = None) -> DataFrame:
    """Equal-width bins over the column's range, last bin closed, with density per class.

    The edges come from one aggregate over all classes.
    """
    value = F.col(column).cast("double")
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        low, high = 0.0, 1.0
    elif low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    number = F.least(F.floor((value - low) / F.lit(high - low) * bins), F.lit(bins - 1)).cast("int")
    groups = ["bin"] + ([by] if by else [])
    rows = df.filter(value.isNotNull()).withColumn("bin", number)
    counts = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    if by:
        totals = counts.groupBy(F.col(by).alias("__c")).agg(F.sum("n").alias("__total"))
        counts = counts.join(totals, F.col(by).eqNullSafe(F.col("__c")))
    else:
        counts = counts.withColumn("__total", counts.agg(F.sum("n")).scalar())
    return counts.select(*groups, "n", (F.lit(low) + F.col("bin") * F.lit(width)).alias("bin_start"),
                         (F.col("n") / (F.col("__total") * F.lit(width))).alias("density"))


def class_frequencies(df: DataFrame, column: str, by: str) -> DataFrame:
    """Relative frequency of each value within each class, 0 where a class lacks the value.

    ``by`` is a label: its values go into one array, so up to some thousands are meant.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"), F.col(by).alias("class")).agg(
        F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(F.col("class").alias("__c")).agg(F.sum("n").alias("__total"))
    # Every class is offered to every value, so the result has a row for each; the classes are carried as one array.
    classes = totals.agg(F.sort_array(F.collect_list(F.struct("__c", "__total"))).alias("a")).scalar()
    spine = counts.select("value").distinct().withColumn("__k", F.explode(classes)).select(
        "value", F.col("__k.__c").alias("class"), F.col("__k.__total").alias("__total"))
    return spine.join(counts, ["value", "class"], "left").select(
        "value", "class", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("__total")).alias("share"))


def class_distribution(df: DataFrame, column: str, by: str, bins: int = 10, distinct_limit: int = 10) -> DataFrame:
    """Histogram for numbers with many distinct values, frequencies otherwise."""
    numeric = dict(df.dtypes)[column] in ("int", "bigint", "double", "float", "smallint", "tinyint")
    if numeric and df.select(column).distinct().limit(distinct_limit + 2).filter(F.col(column).isNotNull()).count() > distinct_limit:
        return histogram(df, column, bins, by)
    return class_frequencies(df, column, by)


def label_patterns(df: DataFrame, features: Sequence[str], label: str, decimals: int | None = None) -> DataFrame:
    """Counts of each label per feature tuple; rows with a null feature are left out."""
    rows = df.select(*features, F.col(label).cast("int").eqNullSafe(F.lit(1)).alias("__y"))
    if decimals is not None:
        rows = round_numeric(rows, decimals)
    rows = rows.dropna(subset=list(features))
    return rows.groupBy(*features).agg(count_if(~F.col("__y")).alias("n_false"), count_if(F.col("__y")).alias("n_true"))


def label_conflicts(df: DataFrame, features: Sequence[str], label: str, decimals: int | None = None) -> DataFrame:
    """Feature tuples seen with both labels, largest first."""
    both = label_patterns(df, features, label, decimals).filter((F.col("n_false") > 0) & (F.col("n_true") > 0))
    return both.withColumn("total", F.col("n_false") + F.col("n_true")).orderBy(F.desc("total"), *features)


def pattern_check(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Rows, rows counted in the patterns, and whether they agree."""
    counted = label_patterns(df, features, label).agg(
        F.coalesce(F.sum(F.col("n_false") + F.col("n_true")), F.lit(0)).alias("n_counted"))
    return counted.withColumn("n_rows", df.agg(F.count(F.lit(1))).scalar()).select(
        "n_rows", "n_counted", (F.col("n_rows") == F.col("n_counted")).alias("consistent"))


def conflict_rows(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Rows whose feature tuple is seen with both labels."""
    both = label_patterns(df, features, label).filter((F.col("n_false") > 0) & (F.col("n_true") > 0))
    keys = both.select(*[F.col(c).alias(f"__f_{c}") for c in features])
    return join_unique(df, keys, {c: f"__f_{c}" for c in features}, "left_semi")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Class counts, positive weight and balanced class weights."""
    positive = F.col(label).cast("int").eqNullSafe(F.lit(1))
    n = df.agg(count_if(positive).alias("n_pos"), count_if(~positive).alias("n_neg"))
    total = F.col("n_pos") + F.col("n_neg")
    return n.select("n_pos", "n_neg", F.try_divide("n_neg", "n_pos").alias("pos_weight"),
                    F.try_divide(total, 2 * F.col("n_pos")).alias("balanced_pos"),
                    F.try_divide(total, 2 * F.col("n_neg")).alias("balanced_neg"))


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-insensitive fingerprint of a table: equal rows in any order give the same values."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in columns or df.columns])
    return df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("hash_xor"),
                  F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"))
