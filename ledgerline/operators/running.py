"""Running aggregates that stay balanced when one group holds most of the rows.

A window runs each group in one task. Groups larger than ``hotGroupRows`` are cut
into slices at quantiles of their order value: the window then runs per slice, and
what earlier slices add up to is attached from a table with one row per slice.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import ColumnLike, col, names
from ledgerline.functions.dates import micros
from ledgerline.operators.skew import local_frame, match_local, oversized, parts_of
from ledgerline.session import hot_group_rows

_SLICE = "__slice"


@dataclass(frozen=True)
class Running:
    """One running value; ``kind`` is count, sum, min or max."""

    kind: str
    value: Column

    def aggregate(self) -> Column:
        return {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}[self.kind](self.value)

    def combine(self, carried: Column, own: Column) -> Column:
        if self.kind == "count":
            return F.coalesce(carried, F.lit(0)) + F.coalesce(own, F.lit(0))
        if self.kind == "sum":
            return F.coalesce(carried + own, own, carried)
        return (F.least if self.kind == "min" else F.greatest)(carried, own)


@dataclass(frozen=True)
class HotGroups:
    """Split points of the oversized groups; empty when every group fits a task."""

    keys: list[str]
    splits: list[tuple] = field(default_factory=list)

    def __bool__(self) -> bool:
        return bool(self.splits)

    def pick(self, df: DataFrame, inside: bool) -> DataFrame:
        """Rows of the split groups, or all other rows."""
        local = local_frame(df, self.keys, [s[:-1] for s in self.splits])
        return match_local(df, local, self.keys, "left_semi" if inside else "left_anti")


def hot_groups(df: DataFrame, keys: str | Sequence[str], position: ColumnLike) -> HotGroups:
    """Find the groups to split and the quantiles of ``position`` to split them at.

    Only if some group is too large, a pass over the rows of those groups takes the
    quantiles. What is collected has a row for each oversized group, with MAX_PARTS quantiles at most.
    """
    keys = names(keys)
    keyed = df.select(*keys, col(position).cast("double").alias("__pos"))
    found = oversized(keyed, keys)
    if not found:
        return HotGroups(keys)
    wanted = {tuple(r[k] for k in keys): n for r, n in zip(found, parts_of(found, hot_group_rows(df.sparkSession)))}
    grid = max(wanted.values())
    hot_rows = match_local(keyed, local_frame(df, keys, list(wanted)), keys, "left_semi") if keys else keyed
    fractions = [i / grid for i in range(1, grid)] or [0.5]
    quantiles = hot_rows.groupBy(*keys).agg(
        F.percentile_approx("__pos", fractions, max(10_000, 10 * grid)).alias("__q"))
    splits = []
    for row in quantiles.collect():
        key = tuple(row[k] for k in keys)
        parts = wanted[key]
        picked = {row["__q"][i * grid // parts - 1] for i in range(1, parts)} if row["__q"] else set()
        if picked:
            splits.append((*key, _nest(sorted(picked))))
    return HotGroups(keys, splits)


def running(
    df: DataFrame,
    keys: str | Sequence[str],
    order: Sequence[ColumnLike],
    values: Mapping[str, Running],
    *,
    descending: bool = False,
    include_current: bool = True,
    hot: HotGroups | None = None,
) -> DataFrame:
    """Add running aggregates over each group.

    ``order`` starts with the position (number or time); the rest breaks ties.
    Rows with equal position share a slice, so collapse them first where one
    position can be hot. Nulls come first ascending and last descending.
    """
    keys = names(keys)
    order = [col(c) for c in order]
    position = order_position(df, order[0])
    if hot is None:
        hot = hot_groups(df, keys, position)
    sort = [c.desc() if descending else c.asc() for c in order]
    end = 0 if include_current else -1
    if not hot:
        w = _window(keys, sort, end)
        return df.withColumns({n: _default(v, v.aggregate().over(w)) for n, v in values.items()})

    sliced = with_slice(df, position, hot)
    w = _window([*keys, _SLICE], sort, end)
    own = sliced.withColumns({n: v.aggregate().over(w) for n, v in values.items()})

    totals = sliced.filter(F.col(_SLICE) >= 0).groupBy(*keys, _SLICE).agg(
        *[v.aggregate().alias(f"__c_{n}") for n, v in values.items()])
    before = _window(keys, [F.desc(_SLICE) if descending else F.asc(_SLICE)], -1)
    carried = totals.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col(_SLICE).alias("__k_slice"),
        *[_fold(v, f"__c_{n}").over(before).alias(f"__c_{n}") for n, v in values.items()])
    match = F.col(_SLICE) == F.col("__k_slice")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = own.join(F.broadcast(carried), match, "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[v.combine(F.col(f"__c_{n}"), F.col(n)).alias(n) for n, v in values.items()])


def _fold(value: Running, name: str) -> Column:
    """Fold the slice totals of one running value."""
    kind = "sum" if value.kind == "count" else value.kind
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](F.col(name))


def order_position(df: DataFrame, c: Column) -> Column:
    """Number that orders like ``c``: times become microseconds."""
    kind = df.select(c.alias("p")).schema["p"].dataType.typeName()
    return micros(c) if kind in ("timestamp", "timestamp_ntz", "date") else c.cast("double")


def with_slice(df: DataFrame, position: Column, hot: HotGroups) -> DataFrame:
    """Slice number of each row; -1 outside the oversized groups."""
    keys = hot.keys
    local = local_frame(df, [*keys, "__splits"], hot.splits, {"__splits": "array<array<double>>"})
    pos = position.cast("double")
    if keys:
        joined = match_local(df, local, keys, "left")
    else:
        joined = df.withColumn("__splits", F.lit(hot.splits[0][0]))
    first = F.transform("__splits", lambda s: s[0])
    coarse = F.greatest(F.size(F.filter(first, lambda s: s < pos)), F.lit(1)) - 1
    inner = F.size(F.filter(F.element_at("__splits", coarse + 1), lambda s: s < pos))
    width = F.size(F.element_at("__splits", 1))
    number = F.when(pos.isNull(), F.lit(0)).otherwise(coarse * width + inner)
    return joined.withColumn(
        _SLICE, F.when(F.col("__splits").isNull(), F.lit(-1)).otherwise(number)).drop("__splits")


def _nest(splits: list[float]) -> list[list[float]]:
    """Two levels of split points, so a row is placed in about 2*sqrt(n) comparisons."""
    width = max(1, math.isqrt(len(splits)))
    return [splits[i:i + width] for i in range(0, len(splits), width)]


def _window(keys: list[str], sort: list[Column], end: int):
    return Window.partitionBy(*keys).orderBy(*sort).rowsBetween(Window.unboundedPreceding, end)


def _default(value: Running, c: Column) -> Column:
    return F.coalesce(c, F.lit(0)) if value.kind == "count" else c
