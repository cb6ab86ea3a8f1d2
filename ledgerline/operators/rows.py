"""Row filters, null thresholds, duplicates and row references."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import count_if, names, order_value
from ledgerline.operators.skew import join_unique


def in_range(df: DataFrame, column: str, start, end) -> DataFrame:
    """Half-open range; null is out."""
    return df.filter((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end)))


def empty_cell(name: str, kind: str) -> Column:
    """Whether a cell is empty: null, or NaN in a column of floating numbers."""
    c = F.col(f"`{name}`")
    return (c.isNull() | F.isnan(c)) if kind in ("double", "float") else c.isNull()


def null_cells(df: DataFrame) -> Column:
    """Number of empty cells of a row."""
    return reduce(lambda a, b: a + b, [empty_cell(c, k).cast("int") for c, k in df.dtypes])


def keep_filled(df: DataFrame, at_least: int = 3) -> DataFrame:
    """Rows with at least this many non-null cells."""
    return df.filter(F.lit(len(df.columns)) - null_cells(df) >= at_least)


def mostly_null(df: DataFrame, more_than: int) -> DataFrame:
    """Rows with more than this many null cells."""
    return df.filter(null_cells(df) > more_than)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop the columns that are empty in every row; one aggregate finds them."""
    filled = df.agg(*[F.count(F.when(~empty_cell(c, k), 1)).alias(f"c{i}") for i, (c, k) in enumerate(df.dtypes)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if filled[f"c{i}"]])


def distinct_rows(df: DataFrame) -> DataFrame:
    """Exact duplicates removed; null equals null."""
    return df.dropDuplicates()


def duplicates_removed(df: DataFrame) -> DataFrame:
    """How many rows ``distinct_rows`` removes: rows, distinct rows and the difference."""
    per_row = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    return per_row.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows_before"), F.count(F.lit(1)).alias("rows_after"),
                       F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("removed"))


def first_by(df: DataFrame, columns: Sequence[str], ordinal: str | Sequence[str]) -> DataFrame:
    """First row, in row order, of each set that agrees on the columns.

    Copies of one row never travel to a single task: they are folded, or cut to one by
    the rank filter, before the exchange.
    """
    order = names(ordinal)
    if len(order) == 1 and set(df.columns) == {*columns, *order}:
        return df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.min(order[0]).alias(order[0])).select(
            *[F.col(f"`{c}`") for c in df.columns])
    w = Window.partitionBy(*columns).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def duplicate_counts(df: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Rows after the first of each identical set, and members of sets that agree
    outside the excluded columns."""
    same = [c for c in df.columns if c not in excluded]
    per_row = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    # Identical rows also agree outside the excluded columns: count up from them.
    per_set = per_row.groupBy(*same).agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("later"))
    return per_set.agg(F.coalesce(F.sum("later"), F.lit(0)).alias("exact_later"),
                       F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("similar_members"))


def mark_duplicates(df: DataFrame, columns: Sequence[str], ordinal: str | Sequence[str],
                    keep_first: bool = True, flag: str = "is_duplicate") -> DataFrame:
    """Flag the rows after the first of each set, or all members of sets of two or more.

    The sets are reduced to one row each and joined back; nulls match nulls.
    """
    order = order_value(ordinal)
    sets = df.groupBy(*columns).agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("__n"))
    sets = sets.filter(F.col("__n") > 1).withColumnsRenamed({c: f"__d_{c}" for c in columns})
    joined = join_unique(df, sets, {c: f"__d_{c}" for c in columns}, null_safe=True)
    hit = F.col("__n").isNotNull()
    if keep_first:
        hit = hit & ~order.eqNullSafe(F.col("__first"))
    return joined.withColumn(flag, hit).select(*df.columns, flag)


def refetch(df: DataFrame, remembered: DataFrame, ordinal: str) -> DataFrame:
    """Rows of ``df`` whose ordinal was remembered from an earlier subset."""
    return df.join(remembered.select(ordinal).distinct(), ordinal, "left_semi")


def positions(df: DataFrame, ordinal: str, start: int, end: int) -> DataFrame:
    """Rows whose ordinal lies in [start, end)."""
    return df.filter((F.col(ordinal) >= start) & (F.col(ordinal) < end))


def end_rows(df: DataFrame, ordinal: str, n: int, last: bool = False) -> DataFrame:
    """First or last n rows in row order."""
    return df.orderBy(F.desc(ordinal) if last else F.asc(ordinal)).limit(n)


def presence_matrix(df: DataFrame, first: str, second: str) -> DataFrame:
    """Row counts by presence of two fields."""
    return (df.groupBy(F.col(first).isNotNull().alias(f"has_{first}"), F.col(second).isNotNull().alias(f"has_{second}"))
            .agg(F.count(F.lit(1)).alias("n")))


def changed_cells(before: str, after: str) -> Column:
    """Cells that differ between two columns; two nulls are equal."""
    return count_if(~F.col(before).eqNullSafe(F.col(after)))


def agreeing_rows(a: str, b: str) -> Column:
    """Rows where two columns agree; null never agrees."""
    return count_if(F.col(a) == F.col(b))


def conflicts(df: DataFrame, a: str, b: str, columns: Sequence[str]) -> DataFrame:
    """Rows where both are present and differ."""
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(*columns)
