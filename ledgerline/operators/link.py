"""Linking a ledger to registries by key.

Every registry is reduced to one row per key before it is joined, so a frequent key
never multiplies rows. Spark chooses broadcast or merge by measured size; the rows of
an oversized ledger key are spread by ``join_unique``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import count_if, names, order_value
from ledgerline.operators.skew import join_unique, with_null_salt

# Oversized keys of the ledger, where they are known from an earlier count.
Hot = Sequence[Row] | None


def lookup_unique(ledger: DataFrame, registry: DataFrame, key: str, registry_key: str,
                  columns: Mapping[str, str], hot: Hot = None) -> DataFrame:
    """Attach registry columns (new name -> registry column); missing keys give null.

    A registry key with several rows is an error, raised while the join runs.
    """
    one = registry.filter(F.col(registry_key).isNotNull()).groupBy(F.col(registry_key).alias("__rk")).agg(
        F.first(F.struct(*[F.col(c).alias(n) for n, c in columns.items()])).alias("__r"),
        F.count(F.lit(1)).alias("__n"))
    problem = F.concat(F.lit(f"registry key {registry_key} is not unique: "), F.col("__rk").cast("string"))
    joined = join_unique(ledger, one, {key: "__rk"}, hot=hot)
    # as a filter behind the join it stays in the plan even where no looked-up column is read
    joined = joined.filter(F.when(F.col("__n") > 1, F.raise_error(problem).cast("boolean")).otherwise(True))
    return joined.select(*_kept(ledger, columns), *[F.col(f"__r.{n}").alias(n) for n in columns])


def with_membership(ledger: DataFrame, registry: DataFrame, key: str, registry_key: str, flag: str,
                    hot: Hot = None) -> DataFrame:
    """0/1 flag for keys present in the registry; a null key is absent."""
    return with_memberships(ledger, key, {flag: (registry, registry_key)}, hot)


def with_memberships(ledger: DataFrame, key: str, registries: Mapping[str, tuple[DataFrame, str]],
                     hot: Hot = None) -> DataFrame:
    """Flags for several registries through one join: their key sets are merged first."""
    marked = [r.filter(F.col(k).isNotNull()).select(F.col(k).alias("__rk"), *[
        F.lit(int(f == flag)).alias(f"__m_{f}") for f in registries]) for flag, (r, k) in registries.items()]
    hits = reduce(DataFrame.unionByName, marked).groupBy("__rk").agg(
        *[F.max(f"__m_{f}").alias(f"__m_{f}") for f in registries])
    joined = join_unique(ledger, hits, {key: "__rk"}, hot=hot)
    return joined.select(*_kept(ledger, registries),
                         *[F.coalesce(F.col(f"__m_{f}"), F.lit(0)).alias(f) for f in registries])


def only_in(left: DataFrame, right: DataFrame, key: str, right_key: str) -> DataFrame:
    """Rows of the left side whose key the right side lacks; null keys stay."""
    return join_unique(left, _keys(right, right_key), {key: "__rk"}, "left_anti")


def also_in(left: DataFrame, right: DataFrame, key: str, right_key: str) -> DataFrame:
    """Rows of the left side whose key the right side has."""
    return join_unique(left, _keys(right, right_key), {key: "__rk"}, "left_semi")


def coverage_report(entities: DataFrame, key: str, registries: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per registry: entities present, entities absent, and registry rows without entity."""
    flagged = with_memberships(entities.select(key), key, registries)
    present = flagged.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f) for f in registries])
    pairs = F.array(*[F.struct(F.lit(f).alias("registry"), F.coalesce(F.col(f), F.lit(0)).alias("entities_present"))
                      for f in registries])
    left = present.select("n", F.explode(pairs).alias("r")).select(
        "r.registry", "r.entities_present", (F.col("n") - F.col("r.entities_present")).alias("entities_absent"))
    # Registry rows are counted per key first, so the anti join sees one row per key.
    keyed = reduce(DataFrame.unionByName, [
        r.groupBy(F.col(k).alias("__k")).agg(F.count(F.lit(1)).alias("__n")).withColumn("registry", F.lit(f))
        for f, (r, k) in registries.items()])
    orphans = only_in(keyed, entities, "__k", key).groupBy("registry").agg(F.sum("__n").alias("orphan_rows"))
    return left.join(orphans, "registry", "left").fillna({"orphan_rows": 0})


def key_overlap(left: DataFrame, right: DataFrame, key: str, right_key: str) -> DataFrame:
    """Sizes of the two key sets, their intersection and both differences."""
    sides = left.select(F.col(key).alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(F.col(right_key).alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    per_key = sides.filter(F.col("k").isNotNull()).groupBy("k").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    in_left, in_right = F.col("l") == 1, F.col("r") == 1
    return per_key.agg(count_if(in_left).alias("left_keys"), count_if(in_right).alias("right_keys"),
                       count_if(in_left & in_right).alias("common_keys"),
                       count_if(in_left & ~in_right).alias("left_only"), count_if(~in_left & in_right).alias("right_only"))


def merge_deliveries(first: DataFrame, second: DataFrame, key: str, suffixes: tuple[str, str] = ("_1", "_2"),
                     repeated: bool = False) -> DataFrame:
    """Inner join of two deliveries; shared columns get suffixes.

    A key that repeats on both sides is an error unless ``repeated`` is set, as it gives
    every pair of its rows; :func:`pair_agreement` counts pairs without making them.
    """
    if not repeated:
        twice = [df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & F.col(key).isNotNull()).select(key)
                 for df in (first, second)]
        found = twice[0].join(twice[1], key, "left_semi").first()
        if found is not None:
            raise ValueError(f"{key} {found[0]!r} repeats on both sides")
    shared = {c for c in first.columns if c in second.columns and c != key}
    a = first.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    b = second.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return a.join(b, key, "inner")


def pair_agreement(first: DataFrame, second: DataFrame, key: str, checks: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Numbers of row pairs of equal key that also agree on the fields of each check.

    ``checks`` maps an output to {field of first: field of second}; null agrees with
    nothing. Rows are counted per key and field values on both sides and the counts
    multiplied, so a key with many rows costs as much as its distinct values.
    """
    found = []
    for name, fields in checks.items():
        sides = []
        for df, cols, n in ((first, [key, *fields], "n1"), (second, [key, *fields.values()], "n2")):
            same = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)]).dropna()
            sides.append(same.groupBy(*same.columns).agg(F.count(F.lit(1)).alias(n)))
        pairs = sides[0].join(sides[1], [f"c{i}" for i in range(len(fields) + 1)])
        total = pairs.agg(F.coalesce(F.sum(F.col("n1") * F.col("n2")), F.lit(0)).alias("pairs"))
        found.append(total.select(F.lit(name).alias("check"), "pairs"))
    return reduce(DataFrame.unionByName, found)


def outer_chain(tables: Sequence[tuple[DataFrame, str]], match_null_keys: bool = False) -> DataFrame:
    """Full outer join of several tables, all on the first one's key column.

    Columns that collide are dropped from both sides. Rows from a later table keep
    their own key; the first key stays null for them. Null keys match nothing unless
    asked for, when each pair of null-keyed rows is a result row. Rows whose null key
    matches nothing are dealt over the tasks by a salt.
    """
    merged, key = tables[0]
    for table, other_key in tables[1:]:
        clash = {c for c in table.columns if c in merged.columns}
        a = merged.withColumnRenamed(key, "__lk").drop(*(clash - {key}))
        b = table.withColumnRenamed(other_key, "__rk").drop(*(clash - {other_key}))
        if match_null_keys:
            merged = a.join(b, F.col("__lk").eqNullSafe(F.col("__rk")), "full_outer")
        else:
            a, b = with_null_salt(a, "__lk", "__ls"), with_null_salt(b, "__rk", "__rs")
            same = (F.col("__lk") == F.col("__rk")) & (F.col("__ls") == F.col("__rs"))
            merged = a.join(b, same, "full_outer").drop("__ls", "__rs")
        if key == other_key:
            merged = merged.withColumn("__lk", F.coalesce("__lk", "__rk")).drop("__rk")
        else:
            merged = merged.withColumnRenamed("__rk", other_key)
        merged = merged.withColumnRenamed("__lk", key)
    return merged


def latest_per_key(registry: DataFrame, key: str, ordinal: str | Sequence[str], columns: Sequence[str] | None = None,
                   prefix: str = "") -> DataFrame:
    """Per key and column, the last non-null value in row order."""
    order = order_value(ordinal)
    columns = [c for c in columns or registry.columns if c != key]
    return registry.filter(F.col(key).isNotNull()).groupBy(key).agg(
        *[last_filled(F.col(c), order).alias(f"{prefix}{c}") for c in columns])


def last_filled(c: Column, order: Column) -> Column:
    return F.max_by(c, F.when(c.isNotNull(), order))


def with_latest(ledger: DataFrame, registry: DataFrame, key: str, registry_key: str, ordinal: str | Sequence[str],
                columns: Sequence[str] | None = None, prefix: str = "latest_", hot: Hot = None) -> DataFrame:
    """Left lookup of :func:`latest_per_key`."""
    latest = latest_per_key(registry, registry_key, ordinal, columns, prefix)
    new = [c for c in latest.columns if c != registry_key]
    joined = join_unique(ledger, latest.withColumnRenamed(registry_key, "__rk"), {key: "__rk"}, hot=hot)
    return joined.select(*_kept(ledger, new), *new)


def with_filtered_latest(ledger: DataFrame, registry: DataFrame, key: str, registry_key: str, text: str, value: str,
                         ordinal: str | Sequence[str], patterns: Mapping[str, str], hot: Hot = None) -> DataFrame:
    """Per pattern (output -> regex), the last non-null value among the key's matching rows."""
    order = order_value(ordinal)
    picked = {n: F.when(F.col(text).rlike(p), F.col(value)) for n, p in patterns.items()}
    latest = registry.filter(F.col(registry_key).isNotNull()).groupBy(F.col(registry_key).alias("__rk")).agg(
        *[last_filled(c, order).alias(n) for n, c in picked.items()])
    joined = join_unique(ledger, latest, {key: "__rk"}, hot=hot)
    return joined.select(*_kept(ledger, patterns), *patterns)


def pair_counterparts(df: DataFrame, group: str, member: str) -> DataFrame:
    """(group, member, other) for groups of exactly two distinct members; null counts as a member."""
    distinct = df.filter(F.col(group).isNotNull()).select(group, member).distinct()
    two = distinct.groupBy(group).agg(
        F.count(F.lit(1)).alias("__n"), F.count(member).alias("__filled"),
        F.min(member).alias("__lo"), F.max(member).alias("__hi")).filter(F.col("__n") == 2)
    with_null = F.col("__filled") == 1
    one = F.struct(F.col("__lo").alias(member), F.when(~with_null, F.col("__hi")).alias("other"))
    two_ = F.struct(F.when(~with_null, F.col("__hi")).alias(member), F.col("__lo").alias("other"))
    return two.select(group, F.explode(F.array(one, two_)).alias("p")).select(group, "p.*")


def with_counterpart(df: DataFrame, group: str, member: str, out: str = "counterpart") -> DataFrame:
    """Each row of a two-member group gets the other member, all other rows null."""
    pairs = pair_counterparts(df, group, member).withColumnsRenamed({group: "__g", member: "__m", "other": out})
    # Null groups have no pair, so matching nulls concerns only the member.
    return join_unique(df, pairs, {group: "__g", member: "__m"}, null_safe=True).drop("__g", "__m")


def with_first_other(df: DataFrame, group: str, member: str, ordinal: str, out: str = "first_other") -> DataFrame:
    """First other member of the row's group in row order; null if there is none."""
    ranked = df.filter(F.col(group).isNotNull() & F.col(member).isNotNull()).groupBy(group, member).agg(
        F.min(ordinal).alias("__o"))
    w = Window.partitionBy(group).orderBy("__o")
    two = ranked.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= 2).groupBy(
        F.col(group).alias("__g")).agg(F.max(F.when(F.col("__rn") == 1, F.col(member))).alias("__m1"),
                                       F.max(F.when(F.col("__rn") == 2, F.col(member))).alias("__m2"))
    joined = join_unique(df, two, {group: "__g"})
    other = F.when(F.col(member) == F.col("__m1"), F.col("__m2")).when(F.col(member).isNotNull(), F.col("__m1"))
    return joined.withColumn(out, other).drop("__g", "__m1", "__m2")


def attach_counterpart(ledger: DataFrame, registry: DataFrame, key: str, registry_key: str, group: str,
                       ordinal: str | Sequence[str], out: str = "counterpart", hot: Hot = None) -> DataFrame:
    """Ledger rows get their entity's counterpart, from its first registry row that has one."""
    paired = with_counterpart(registry, group, registry_key, "__other").filter(F.col("__other").isNotNull())
    per_key = paired.groupBy(F.col(registry_key).alias("__rk")).agg(F.min_by("__other", order_value(ordinal)).alias(out))
    return join_unique(ledger, per_key, {key: "__rk"}, hot=hot).drop("__rk")


def with_secondary_key_flag(ledger: DataFrame, registry: DataFrame, key: str, registry_key: str, secondary: str,
                            flag: str = "secondary_in_ledger", hot: Hot = None) -> DataFrame:
    """1 for entities with a registry row whose secondary identifier is itself a ledger entity."""
    hits = also_in(registry.select(registry_key, secondary).distinct(), ledger, secondary, key)
    return with_membership(ledger, hits, key, registry_key, flag, hot)


def dict_lookup(ledger: DataFrame, table: DataFrame, key: str, table_key: str, value: str,
                ordinal: str | Sequence[str], out: str) -> DataFrame:
    """Map through a table; rows with null key or value are ignored and the last duplicate wins."""
    filled = table.filter(F.col(table_key).isNotNull() & F.col(value).isNotNull())
    last = filled.groupBy(F.col(table_key).alias("__rk")).agg(F.max_by(value, order_value(ordinal)).alias(out))
    joined = join_unique(ledger, last, {key: "__rk"})
    return joined.select(*_kept(ledger, [out]), out)


def _keys(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).select(F.col(key).alias("__rk")).distinct()


def _kept(df: DataFrame, replaced: Sequence[str] | Mapping) -> list[Column]:
    new = set(names(replaced) if isinstance(replaced, str) else replaced)
    return [F.col(f"`{c}`") for c in df.columns if c not in new]
