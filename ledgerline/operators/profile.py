"""Folding a ledger into one profile row per entity.

The outputs are declared as a list; those that fold row by row share one
aggregation. Modes and n-th values take one more pass each: modes through counts
per value, n-th values through a rank filter that keeps a few rows per entity before
the exchange. No step gathers an entity's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import names, order_value
from ledgerline.functions.dates import MICROS_PER_DAY, micros
from ledgerline.operators.link import last_filled


@dataclass(frozen=True)
class Out:
    """One profile column: ``how`` names an aggregate, ``n`` is for the n-th ones.

    ``nulls='poison'`` ranks nulls above every value in the n-th largest.
    """

    name: str
    column: str
    how: str
    n: int = 1
    nulls: str = "ignore"


def mean_gap_days(c: Column) -> Column:
    """Mean gap between consecutive times, in days; null below two times."""
    span = (micros(F.max(c)) - micros(F.min(c))) / F.lit(float(MICROS_PER_DAY))
    return F.when(F.count(c) > 1, span / (F.count(c) - 1))


def largest(c: Column, nulls: str) -> Column:
    top = F.max(c)
    return F.when(F.count(c) == F.count(F.lit(1)), top) if nulls == "poison" else top


# name -> (column, row order) -> aggregate; all fold with constant state per entity.
FOLDS: dict[str, Callable[[Column, Column], Column]] = {
    "last": lambda c, o: F.max_by(c, o),
    "last_filled": last_filled,
    "min": lambda c, o: F.min(c),
    "max": lambda c, o: F.max(c),
    "count": lambda c, o: F.count(c),
    "sum": lambda c, o: F.sum(c),
    "mean": lambda c, o: F.avg(c),
    "mean_gap_days": lambda c, o: mean_gap_days(c),
    "largest": lambda c, o: largest(c, "ignore"),
    "largest_poisoned": lambda c, o: largest(c, "poison"),
}
RANKED = ("nth_last_filled", "nth_largest")


def entity_profile(df: DataFrame, key: str, ordinal: str | Sequence[str], outputs: Sequence[Out]) -> DataFrame:
    """One row per non-null key with the declared outputs, in their order."""
    for o in outputs:
        if o.how not in FOLDS and o.how not in (*RANKED, "mode"):
            raise ValueError(f"unknown aggregate {o.how!r}; known: {[*FOLDS, *RANKED, 'mode']}")
    rows = df.filter(F.col(key).isNotNull())
    order = order_value(ordinal)
    folds = [FOLDS[o.how](F.col(f"`{o.column}`"), order).alias(o.name) for o in outputs if o.how in FOLDS]
    by_value = [o for o in outputs if o.how == "nth_largest"]
    poisoned = [o for o in by_value if o.nulls == "poison"]
    folds += [_null_count(c).alias(f"__nulls_{c}") for c in dict.fromkeys(o.column for o in poisoned)]
    # Every entity is in the first part; the others come from filtered rows.
    parts = [rows.groupBy(key).agg(*folds) if folds else rows.select(key).distinct()]
    modes = [o for o in outputs if o.how == "mode"]
    if modes:
        parts.append(modes_per_key(rows, key, {o.name: o.column for o in modes}))
    by_order = [o for o in outputs if o.how == "nth_last_filled"]
    if by_order:
        parts.append(_nth(rows, key, by_order, [F.desc(o) for o in names(ordinal)], names(ordinal)))
    if by_value:
        # A poisoned rank moves up by the number of nulls, so all ranks to n are picked.
        ranks = [o for o in by_value if o.nulls != "poison"]
        ranks += [Out(f"__top_{o.name}_{r}", o.column, o.how, r) for o in poisoned for r in range(1, o.n + 1)]
        parts.append(_nth(rows, key, ranks))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.join(part, key, "left")
    merged = merged.withColumns({o.name: _poisoned(o) for o in poisoned})
    return merged.select(key, *[F.col(f"`{o.name}`") for o in outputs])


def _null_count(column: str) -> Column:
    return F.count(F.lit(1)) - F.count(F.col(f"`{column}`"))


def _poisoned(o: Out) -> Column:
    nulls = F.col(f"`__nulls_{o.column}`")
    return F.coalesce(*[F.when(nulls == o.n - r, F.col(f"`__top_{o.name}_{r}`")) for r in range(1, o.n + 1)])


def one_aggregate(df: DataFrame, key: str, column: str, how: str, out: str, ordinal: str | Sequence[str], n: int = 1,
                  nulls: str = "ignore") -> DataFrame:
    """A single aggregate per key, chosen by name."""
    return entity_profile(df, key, ordinal, [Out(out, column, how, n, nulls)])


def modes_per_key(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Most frequent value per key and column, the smallest on ties; null if all are null.

    Values are counted per key first, so a large entity is spread over its values
    and a value-rich one needs no map in memory.
    """
    long = _long(df, key, list(columns.values()))
    counted = long.filter(_filled(len(columns))).groupBy(key, "slot", *_values(columns)).agg(
        F.count(F.lit(1)).alias("n"))
    best = [F.min_by(v, F.when(F.col("slot") == i, F.struct(-F.col("n"), F.col(v)))).alias(name)
            for i, (name, v) in enumerate(zip(columns, _values(columns)))]
    return counted.groupBy(key).agg(*best)


def _nth(df: DataFrame, key: str, outputs: list[Out], sort: list[Column] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Values at given ranks per key: by the sort columns, or by the values from the largest down."""
    columns = list(dict.fromkeys(o.column for o in outputs))
    long = _long(df, key, columns, keep).filter(_filled(len(columns)))
    # Only the slot's own value is set, so sorting by all of them sorts by it.
    w = Window.partitionBy(key, "slot").orderBy(*(sort or [F.desc(v) for v in _values(columns)]))
    ranked = long.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= max(o.n for o in outputs))

    def at(o: Out) -> Column:
        i = columns.index(o.column)
        return F.max(F.when((F.col("slot") == i) & (F.col("rn") == o.n), F.col(f"v{i}"))).alias(o.name)

    return ranked.groupBy(key).agg(*[at(o) for o in outputs])


def _long(df: DataFrame, key: str, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per column and source row: its slot number and its value in column v<slot>."""
    def slot(i: int) -> Column:
        values = [F.col(f"`{c}`").alias(f"v{j}") if i == j else F.lit(None).cast(df.schema[c].dataType).alias(f"v{j}")
                  for j, c in enumerate(columns)]
        return F.struct(F.lit(i).alias("slot"), *values)

    kept = [key, *[k for k in keep if k != key]]
    return df.select(*kept, F.inline(F.array(*[slot(i) for i in range(len(columns))])))


def _values(columns) -> list[str]:
    return [f"v{i}" for i in range(len(columns))]


def _filled(count: int) -> Column:
    """Rows whose slot holds a value; the other slots' columns are always null."""
    return reduce(lambda a, b: a | b, [F.col(f"v{i}").isNotNull() for i in range(count)])
