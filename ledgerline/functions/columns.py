"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = str | Column


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def names(value: str | Sequence[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def order_value(ordinal: str | Sequence[str]) -> Column:
    """One comparable value for a row order given as one or several columns."""
    cols = names(ordinal)
    return F.col(cols[0]) if len(cols) == 1 else F.struct(*cols)


def count_if(condition: Column) -> Column:
    """Rows where the condition is true, as a long (0 on no rows)."""
    return F.count(F.when(condition, F.lit(1)))
