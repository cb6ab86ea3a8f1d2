"""Finding oversized groups, and joins that spread them."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ledgerline.session import hot_group_rows

# A group is dealt into at most this many parts.
MAX_PARTS = 10_000

# Groups that the sketch of frequent keys follows. It can miss one of fewer rows than this part of
# all rows; where smaller groups are oversized, all keys are counted.
TRACKED = 100_000
MISSED = 4 / TRACKED

_SALT, _PARTS = "__salt", "__parts"


def oversized(df: DataFrame, keys: Sequence[str]) -> list[Row]:
    """Key values and row counts (``__n``) of all groups with more rows than one task should get.

    Skipped when the table has no more rows than one group may have (a hot key compresses too
    well for its bytes to tell). Each task keeps a sketch of its frequent keys, the sketches
    are merged, and only the rows of the few keys that may be oversized are counted exactly;
    no key is shuffled to find that there are none. What is collected has a row for each
    oversized group: with n rows and the limit l there are fewer than n / l.
    """
    limit = hot_group_rows(df.sparkSession)
    n = df.count()
    if n <= limit:
        return []
    rows = df
    if keys and limit >= MISSED * n:
        hashed = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
        kept = min(TRACKED, 2 * math.ceil(n / limit) + 1)
        sketch = df.agg(F.call_function("approx_top_k", hashed, F.lit(kept), F.lit(TRACKED)).alias("top")).first()["top"]
        likely = [r["item"] for r in sketch if r["count"] + MISSED * n > limit]
        if not likely:
            return []
        table = df.sparkSession.createDataFrame([(h,) for h in likely], "__h long")
        rows = df.join(F.broadcast(table), hashed == F.col("__h"), "left_semi")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).collect()


def parts_of(found: Sequence[Row], limit: int) -> list[int]:
    """Number of parts of each oversized group, at least two: all together fewer than twice the rows over the limit."""
    return [min(math.ceil(r["__n"] / limit), MAX_PARTS) for r in found]


def join_unique(left: DataFrame, right: DataFrame, on: Mapping[str, str], how: str = "left", null_safe: bool = False,
                hot: Sequence[Row] | None = None) -> DataFrame:
    """Join to a right side that has one row per key (left column -> right column).

    Rows of an oversized key are dealt over several tasks by a salt; the right row of
    such a key, and only of such a key, is repeated once per salt. Works for left,
    inner, left_semi and left_anti joins. The right key columns stay in the result.
    ``hot`` passes on what :func:`oversized` found for the same keys before.
    """
    found = oversized(left, list(on)) if hot is None else hot
    if not found:
        return left.join(right, _match_condition(on, null_safe), how)
    parts = parts_of(found, hot_group_rows(left.sparkSession))
    rows = [(*[r[k] for k in on], n) for r, n in zip(found, parts)]
    local = local_frame(left, [*on, _PARTS], rows, {_PARTS: "int"})
    dealt = match_local(left, local, list(on), "left").withColumn(
        _SALT, F.when(F.col(_PARTS).isNotNull(), F.pmod(_row_hash(left), F.col(_PARTS)).cast("int")).otherwise(0))
    right_local = local.withColumnsRenamed({a: b for a, b in on.items()})
    copies = F.when(F.col(_PARTS).isNotNull(), F.sequence(F.lit(0), F.col(_PARTS) - 1)).otherwise(F.array(F.lit(0)))
    repeated = match_local(right, right_local, list(on.values()), "left").withColumn("__rsalt", F.explode(copies)).drop(_PARTS)
    condition = _match_condition(on, null_safe) & (F.col(_SALT) == F.col("__rsalt"))
    return dealt.join(repeated, condition, how).drop(_SALT, _PARTS, "__rsalt")


def _match_condition(on: Mapping[str, str], null_safe: bool) -> Column:
    def same(a: str, b: str) -> Column:
        x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
        return x.eqNullSafe(y) if null_safe else x == y

    return reduce(lambda a, b: a & b, [same(a, b) for a, b in on.items()])


def with_null_salt(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with a number that is 0 where the key is filled and differs between rows where it is null.

    The 0 is made from the key: a plain one is folded away for a key that is never null,
    and the join would no longer be dealt by the number.
    """
    filled = F.col(f"`{key}`")
    return df.withColumn(name, F.when(filled.isNotNull(), F.pmod(F.xxhash64(filled), F.lit(1))).otherwise(_row_hash(df)))


def _row_hash(df: DataFrame) -> Column:
    """Hash that differs between rows, and between copies of a row in different partitions.

    It gives the same value when a task is run again.
    """
    plain = [F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith(("map", "struct", "array"))]
    return F.xxhash64(F.spark_partition_id(), *plain)


def estimated_bytes(df: DataFrame) -> int:
    """The planner's size estimate; nothing runs to find it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def local_frame(df: DataFrame, columns: Sequence[str], rows: Sequence[tuple], types: Mapping[str, str] | None = None) -> DataFrame:
    """Small frame of collected rows, typed like the columns of ``df``."""
    types = types or {}
    ddl = ", ".join(f"`{c}` {types.get(c) or df.schema[c].dataType.simpleString()}" for c in columns)
    return df.sparkSession.createDataFrame(list(rows), ddl)


def match_local(df: DataFrame, local: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join to a bounded local frame with null keys matching."""
    renamed = local.select(*[F.col(f"`{c}`").alias(f"__k_{c}" if c in keys else c) for c in local.columns])
    condition = _match_condition({k: f"__k_{k}" for k in keys}, null_safe=True)
    return df.join(F.broadcast(renamed), condition, how).drop(*[f"__k_{k}" for k in keys])
