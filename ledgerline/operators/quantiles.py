"""Exact quantiles of many columns by repeated histograms.

Every wanted rank has an interval of values that holds it. A pass over the table counts the
values of each interval in equal bins, with the smallest and largest value of each bin, and
the bin with the rank is the next interval. A pass serves all columns and ranks, and what
is shuffled is one row a bin. Once few values are left in all intervals, these are listed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Interval:
    """Values from ``low`` to ``high`` of a column: ``n`` of them, after ``below`` smaller ones."""

    column: str
    low: float
    high: float
    below: int
    n: int


def _number(column: str) -> Column:
    """The column as a double; NaN is missing."""
    value = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(value), value)


def _spread(x: float) -> float:
    """A rising function that brings large and small numbers near one another."""
    return math.copysign(math.log1p(abs(x)), x)


def _bin(value: Column, i: Interval, bins: int) -> Column:
    """Number of the bin of a value inside the interval; larger values have no smaller number."""
    if math.isinf(i.low) or math.isinf(i.high):
        ends = F.when(value == F.lit(float("-inf")), 0).when(value == F.lit(float("inf")), bins + 1)
        inner = Interval(i.column, max(i.low, -1.7976931348623157e308), min(i.high, 1.7976931348623157e308), i.below, i.n)
        return ends.otherwise(_bin(value, inner, bins) + 1)
    low, high = _spread(i.low), _spread(i.high)
    place = F.when(value < 0, -F.log1p(-value)).otherwise(F.log1p(value))
    if high - low <= 1e-9 * max(abs(low), abs(high), 1e-300):  # too close to tell apart there
        low, high, place = i.low, i.high, value
    width = high - low
    return F.when(value >= F.lit(i.high), bins - 1).otherwise(
        F.greatest(F.least(F.floor((place - F.lit(low)) / F.lit(width) * bins), F.lit(bins - 1)), F.lit(0))).cast("int")


def _inside(df: DataFrame, intervals: Sequence[Interval], number: dict[int, Column]) -> DataFrame:
    """slot, place and value of every value in an interval."""
    cells = []
    for slot, i in enumerate(intervals):
        value = _number(i.column)
        cell = F.struct(F.lit(slot).alias("slot"), number[slot].alias("place"), value.alias("value"))
        cells.append(F.when((value >= F.lit(i.low)) & (value <= F.lit(i.high)), cell))
    return df.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*")


def order_statistics(df: DataFrame, ranks: dict[str, Sequence[int]], start: dict[str, Interval], bins: int = 1024,
                     listed: int = 10_000) -> dict[tuple[str, int], float]:
    """The value of each rank (from 0) of each column; ``start`` has the whole range of each.

    A list holds ``listed`` values at most. A round divides each interval by ``bins``, so a
    column of doubles needs no more than seven, whatever the distribution.
    """
    found: dict[tuple[str, int], float] = {}
    at = {(c, r): start[c] for c, rs in ranks.items() for r in set(rs)}
    while True:
        for key, i in list(at.items()):
            if i.low == i.high:
                found[key] = i.low
                del at[key]
        if not at:
            return found
        intervals = sorted(set(at.values()), key=lambda i: (i.column, i.below, i.low))
        if all(i.n <= listed for i in intervals):
            break
        rows = _inside(df, intervals, {s: _bin(_number(i.column), i, bins) for s, i in enumerate(intervals)})
        counts: dict[Interval, list] = {i: [] for i in intervals}
        for r in rows.groupBy("slot", "place").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect():
            counts[intervals[r.slot]].append((r.place, r.n, r.low, r.high))
        for key, i in at.items():
            below = i.below
            for _, n, low, high in sorted(counts[i]):
                if key[1] < below + n:
                    at[key] = Interval(i.column, low, high, below, n)
                    break
                below += n
    lists = _inside(df, intervals, dict.fromkeys(range(len(intervals)), F.lit(0))).groupBy("slot").agg(F.sort_array(F.collect_list("value")).alias("values"))
    values = {intervals[r.slot]: r["values"] for r in lists.collect()}  # a list has few values
    return found | {key: values[i][key[1] - i.below] for key, i in at.items()}


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float] = (0.25, 0.5, 0.75), bins: int = 1024,
                    listed: int = 10_000) -> dict[str, list[float | None]]:
    """Quantiles of each numeric column, linear between neighbouring values; null and NaN are left out.

    A column without values has null quantiles. The driver gets one row for each bin that is
    in use: at most ``bins`` for each column and rank.
    """
    facts = df.agg(*[f(_number(c)).alias(f"{k}_{n}") for n, c in enumerate(columns)
                     for k, f in (("n", F.count), ("low", F.min), ("high", F.max))]).first()
    places, start = {}, {}
    for k, c in enumerate(columns):
        n = facts[f"n_{k}"]
        if n:
            places[c] = [(n - 1) * s for s in shares]
            start[c] = Interval(c, facts[f"low_{k}"], facts[f"high_{k}"], 0, n)
    ranks = {c: [r for p in ps for r in (math.floor(p), math.ceil(p))] for c, ps in places.items()}
    value = order_statistics(df, ranks, start, bins, listed)
    out: dict[str, list[float | None]] = {}
    for c in columns:
        if c not in places:
            out[c] = [None] * len(shares)
            continue
        ends = [(value[c, math.floor(p)], value[c, math.ceil(p)], p - math.floor(p)) for p in places[c]]
        out[c] = [a if a == b or not part else a + (b - a) * part for a, b, part in ends]
    return out
