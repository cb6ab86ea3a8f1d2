"""Numeric, flag and label expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.columns import ColumnLike, col


def bin_upper_edge(max_value: float, width: int, closed_top: bool = False) -> int:
    """Largest multiple of the width below int(max) + width; values from there on have no bin."""
    top = -(-(int(max_value) + width) // width) * width - width
    return top + width if closed_top and top <= max_value else top


def bin_midpoint(c: ColumnLike, width: int, edge: int) -> Column:
    """Middle of the bin [i*w, (i+1)*w); null below zero and from the edge on."""
    v = col(c).cast("double")
    return F.when((v >= 0) & (v < edge), F.floor(v / width) * width + width / 2.0)


def with_bin_midpoint(df: DataFrame, source: str, target: str, width: int = 5, coerce: bool = False,
                      closed_top: bool = False, basis: DataFrame | None = None) -> DataFrame:
    """Bins up to the column maximum, which one aggregate over the column finds.

    ``basis`` is a cheaper table with the same maximum to find it in. Text that is not
    a number is an error, or null with ``coerce``.
    """
    number = F.col(source).try_cast("double") if coerce else F.col(source).cast("double")
    largest = (basis or df).agg(F.max(number)).first()[0]
    if largest is None:
        return df.withColumn(target, F.lit(None).cast("double"))
    return df.withColumn(target, bin_midpoint(number, width, bin_upper_edge(largest, width, closed_top)))


def not_null_flag(c: ColumnLike) -> Column:
    return col(c).isNotNull()


def equals_flag(c: ColumnLike, value) -> Column:
    """0/1 with null counting as not equal."""
    return col(c).eqNullSafe(F.lit(value)).cast("int")


def horizon_label(days: ColumnLike, limit: int) -> Column:
    """Elapsed days below the limit; missing is False."""
    return F.coalesce(col(days) < limit, F.lit(False))


# The binary labels, their columns and limits in days.
LABELS: Mapping[str, tuple[str, int | None]] = {
    "defuncion": ("DEFUNCION_", None),
    "30dias": ("MIN_DIAS_IAE_MUERTE_", 30),
    "60dias": ("MIN_DIAS_IAE_MUERTE_", 60),
    "90dias": ("MIN_DIAS_IAE_MUERTE_", 90),
    "CAT_SUI_": ("CAT_SUI_", None),
    "CAT_MCEXSUI_": ("CAT_MCEXSUI_", None),
    "MOTIVO_EXT_SUI_": ("MOTIVO_EXT_SUI_", None),
}


def named_label(name: str, labels: Mapping[str, tuple[str, int | None]] = LABELS) -> Column:
    """One of the named binary labels; an unknown name lists the known ones."""
    if name not in labels:
        raise ValueError(f"unknown label {name!r}; known: {list(labels)}")
    column, limit = labels[name]
    return horizon_label(column, limit) if limit else col(column).cast("int").eqNullSafe(F.lit(1))


def two_flags(c: ColumnLike, first: str, second: str) -> tuple[Column, Column]:
    """A two-valued text as two flags; null gives False for both."""
    return col(c).eqNullSafe(F.lit(first)), col(c).eqNullSafe(F.lit(second))


def round_numeric(df: DataFrame, decimals: int, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round every floating column."""
    floats = [c for c, t in df.dtypes if t in ("double", "float") and c not in skip]
    return df.withColumns({c: F.round(c, decimals) for c in floats})


def odds_ratio(coefficient: ColumnLike) -> Column:
    return F.exp(col(coefficient))
