"""Folds, metrics, curves and importances."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import count_if
from ledgerline.operators.running import Running, running

# The metrics, in the order of the result.
METRICS = ["accuracy", "precision", "recall", "f1", "f2", "pr_auc", "roc_auc", "bal_acc"]
_ALL = "__all"


def stratified_folds(df: DataFrame, label: str, ordinal: str, k: int = 5, out: str = "fold") -> DataFrame:
    """Fold numbers 0..k-1: each class is cut, in row order, into k contiguous blocks.

    Block sizes deal the rows of the label-sorted table round robin, classes in order
    of first appearance, so every fold gets its share of the odd rows.
    """
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first")).orderBy("first").collect()
    ranked = running(df, [label], [ordinal], {"__r": Running("count", F.lit(1))})
    fold, start = F.lit(None).cast("int"), 0
    for c in classes:
        ends, total = [], 0
        for i in range(k):
            # Positions start..start+n-1 of the sorted table that are i modulo k.
            total += (start + c["n"] - 1 - i) // k - (start - 1 - i) // k
            ends.append(total)
        number = sum((F.col("__r") > e).cast("int") for e in ends[:-1])
        fold = F.when(F.col(label).eqNullSafe(F.lit(c[label])), number).otherwise(fold)
        start += c["n"]
    return ranked.withColumn(out, fold).drop("__r")


def curves(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Precision-recall and ROC points, one per distinct score, highest first.

    Rows are counted per score before anything is sorted.
    """
    keyed, keys, added = _keyed(df, keys)
    y = F.col(label).cast("int") == 1
    points = keyed.groupBy(*keys, F.col(score).alias("threshold")).agg(
        count_if(y).alias("pos"), count_if(~y).alias("neg"))
    summed = running(points, keys, ["threshold"], {"tp": Running("sum", F.col("pos")), "fp": Running("sum", F.col("neg"))},
                     descending=True)
    totals = points.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    tp, fp = F.col("tp"), F.col("fp")
    if added:
        both = summed.withColumns({c: totals.select(c).scalar() for c in ("n_pos", "n_neg")})
    else:
        both = summed.join(totals, list(keys))
    out = both.withColumns({
        "precision": tp / (tp + fp), "recall": F.try_divide(tp, F.col("n_pos")), "fpr": F.try_divide(fp, F.col("n_neg"))})
    return out.drop(*added)


def areas(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Average precision and exact ROC area from the curve points."""
    keyed, keys, added = _keyed(curve, keys)
    step = F.try_divide(F.col("pos"), F.col("n_pos"))
    before = F.col("tp") - F.col("pos") / 2
    strip = F.try_divide(F.col("neg") * before, F.col("n_pos") * F.col("n_neg"))
    return keyed.groupBy(*keys).agg(F.sum(step * F.col("precision")).alias("pr_auc"), F.sum(strip).alias("roc_auc")).drop(*added)


def confusion(df: DataFrame, score: str, label: str, threshold: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of the confusion matrix; only scores above the threshold are positive."""
    keyed, keys, added = _keyed(df, keys)
    y, p = F.col(label).cast("int") == 1, F.col(score) > threshold
    return keyed.groupBy(*keys).agg(
        count_if(y & p).alias("tp"), count_if(~y & p).alias("fp"), count_if(y & ~p).alias("fn"), count_if(~y & ~p).alias("tn")).drop(*added)


def metrics(df: DataFrame, score: str, label: str, threshold: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """All metrics, one row per key."""
    keyed, keys, added = _keyed(df, keys)
    counts = confusion(keyed, score, label, threshold, keys)
    area = areas(curves(keyed, score, label, keys), keys)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    derived = {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn), "f2": ratio(5 * tp, 5 * tp + 4 * fn + fp),
        "bal_acc": (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2}
    return counts.withColumns(derived).join(area, list(keys)).select(*[k for k in keys if k not in added], *METRICS)


def long_metrics(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics as (keys, metric, value) rows."""
    return wide.unpivot(list(keys), METRICS, "metric", "value")


def rank_results(results: DataFrame, metric: str, keys: Sequence[str] = ("param_id", "params")) -> DataFrame:
    """Mean and deviation over folds of one metric per parameter set, best first with ranks.

    The ranked table has one row per parameter set.
    """
    per_set = results.filter(F.col("metric") == metric).groupBy(*keys).agg(
        F.avg("value").alias("mean_score"), F.stddev_pop("value").alias("std_score"))
    return per_set.withColumn("rank", F.rank().over(Window.orderBy(F.desc("mean_score")))).orderBy("rank", keys[0])


def mean_accuracy(df: DataFrame, prediction: str, label: str) -> DataFrame:
    return df.agg(F.avg((F.col(prediction) == F.col(label)).cast("int")).alias("accuracy"))


def permuted(df: DataFrame, columns: Sequence[str], ordinal: str, repeats: int, seed: int = 42,
             block_rows: int = 10_000) -> DataFrame:
    """One copy of the rows per (feature, repeat), with that feature's values exchanged between rows.

    Rows are dealt at random into blocks of bounded size and each value moves to
    another row of its block, so the values as a whole stay the same and no sort
    spans the table. One exchange serves all copies.
    """
    n = df.count()
    blocks = max(1, -(-n // block_rows))
    block = F.pmod(F.xxhash64(F.col(ordinal), F.lit(seed)), F.lit(blocks)).alias("__block")
    moved = df.select("*", block)
    values = F.struct(*columns)
    for r in range(repeats):
        order = [F.xxhash64(F.col(ordinal), F.lit(seed + 1 + r)), F.col(ordinal)]
        w = Window.partitionBy("__block").orderBy(*order)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        moved = moved.withColumn(f"__p{r}", F.coalesce(F.lead(values).over(w), F.first(values).over(whole)))
    copies = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(r).alias("repeat"),
                 F.struct(*[(F.col(f"__p{r}.{c}") if c == k else F.col(k)).alias(k) for k in columns]).alias("x"))
        for c in columns for r in range(repeats)])
    others = [c for c in df.columns if c not in columns]
    return moved.select(*others, F.inline(copies)).select(*others, "feature", "repeat", "x.*")


def permutation(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where each number below ``n`` goes in the permutation of all of them that ``key`` names.

    A number is a pair of digits to two bases of about the root of ``n``, and each digit is
    moved in turn by a hash of the other, which can be undone, so no two numbers meet.
    What falls beyond ``n`` goes through it again until it is below.
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    mix = np.uint64(0xBF58476D1CE4E5B9)

    def moved(digit: np.ndarray, turn: int, base: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = digit.astype(np.uint64) + np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0x94D049BB133111EB) % (1 << 64))
            for _ in range(2):
                h = (h ^ (h >> np.uint64(31))) * mix
            return ((h ^ (h >> np.uint64(32))) % np.uint64(base)).astype(np.int64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x % a, x // a
        for turn in range(4):
            left = (left + moved(right, 2 * turn, a)) % a
            right = (right + moved(left, 2 * turn + 1, b)) % b
        return left + a * right

    out = once(np.asarray(index, np.int64))
    while (far := np.flatnonzero(out >= n)).size:
        out[far] = once(out[far])
    return out


def shuffled(df: DataFrame, columns: Sequence[str], index: str, repeats: int, seed: int = 42) -> DataFrame:
    """One copy of the rows per (feature, repeat), with that feature's values dealt to any rows.

    ``index`` numbers the rows from 0 without gaps. Row i of repeat r has the value of the
    row that i goes to in a keyed permutation of all numbers; one join fetches the rows of
    all repeats, and the features are told apart after it.
    """
    n = df.count()

    @F.pandas_udf("array<long>")
    def sources(i: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack([permutation(i.to_numpy(), n, seed * 1_000_003 + r) for r in range(repeats)], axis=1)) if len(i) else [], dtype=object)

    asked = df.select("*", F.posexplode(sources(index)).alias("repeat", "__from"))
    values = df.select(F.col(index).alias("__from"), F.struct(*columns).alias("__other"))
    both = asked.join(values, "__from")
    copies = F.array(*[F.struct(F.lit(c).alias("feature"), F.struct(*[(F.col(f"__other.{k}") if c == k else F.col(k)).alias(k) for k in columns]).alias("x"))
                       for c in columns])
    others = [c for c in df.columns if c not in columns]
    return both.select(*others, "repeat", F.inline(copies)).select(*others, "feature", "repeat", "x.*")


def named_vector(spark, names: Sequence[str], values: Sequence[float], out: str) -> DataFrame:
    """Model coefficients or importances with their feature names, largest first."""
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, f"feature string, `{out}` double").orderBy(F.desc(out), "feature")


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """The keys, or one constant key for the whole table, and the columns added for that."""
    return (df, list(keys), []) if keys else (df.withColumn(_ALL, F.lit(0)), [_ALL], [_ALL])
