"""Quality rules: base counts of a text, and robust multivariate outliers.

Counts of words, symbols and repeats are turned into a vector of five transformed
statistics. For each language and source the minimum covariance determinant estimate of
their centre and scatter is found by concentration steps: the covariance of the h
vectors nearest to the last estimate, until the steps are done. Texts whose Mahalanobis
distance from it is too large are rejected. Everything is DataFrame operations; a group
is only ever summed, so a source may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import ASCII_SPACE, sized
from ledgerline.sources.shared import stored

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics are whole multiples of 1 / SCALE, so that their sums do not depend on the order of rows.
SCALE = 1024
_VECTOR = ("words", "length", "symbols", "lines", "repeats")
_MEDIAN_CHI2_5 = 4.351  # fixed value: median of chi-square with five degrees of freedom
_BINS = 32


@dataclass(frozen=True)
class Outliers:
    """Parameters.

    ``share`` of a group's vectors (the h of the estimate) form the subset of least
    scatter; ``steps`` concentration steps are made. ``least_spread`` is added in square
    to the variances, so that statistics that hardly vary do not make small differences
    large. Groups of fewer than ``least_rows`` texts are joined with the others of their
    language, and those with all others. ``cutoff`` is the largest squared distance kept,
    on the scale of chi-square with five degrees of freedom. Up to ``broadcast_groups``
    groups are sent to all tasks, more are joined.
    """

    least_words: int = 50
    most_repeats: int = 50
    share: float = 0.75
    steps: int = 3
    least_spread: tuple[float, ...] = (0.4, 0.1, 0.4, 0.15, 0.15)
    least_rows: int = 200
    cutoff: float = 60.0
    broadcast_groups: int = 50_000


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the five base counts, from columns text only; a null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, ASCII_SPACE, "") != "")
    step = docs.withColumns({
        "__words": F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != ""),
        "__lines": lines,
        "word_chars": F.length(F.translate(text, ASCII_SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")})
    words = F.col("__words")

    def window(i: Column) -> Column:
        return F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))

    n = F.size(words)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    step = step.withColumns({"n_words": n.cast("long"), "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
                             "__windows": F.sort_array(windows)}).drop("__words", "__lines")
    ordered = F.col("__windows")

    def twice(x: Column, k: Column) -> Column:
        before = F.when(k > 0, F.get(ordered, k - 1)["h"] == x["h"])
        return F.coalesce(before, F.lit(False)) | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False))

    step = step.withColumn("__starts", F.sort_array(F.transform(F.filter(ordered, twice), lambda x: x["i"]))).drop("__windows")
    starts = F.col("__starts")
    # a repeated window covers three words, or as many as lie before the next repeated one
    covered = F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - s, F.lit(3))))
    return step.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("__starts")


def base_failed(p: Outliers) -> Column:
    return (F.col("n_words") < p.least_words) | (100 * F.col("n_repeat_words") > p.most_repeats * F.col("n_words"))


def _statistics() -> list[Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    raw = [F.log(words), F.log(chars / words), F.log1p(1000 * F.col("n_symbols") / chars),
           F.log1p(F.col("n_dup_lines")) / F.log1p(words) * 2, F.sqrt(F.col("n_repeat_words") / words)]
    return [F.round(x * SCALE).cast("long").alias(f"__{name}") for x, name in zip(raw, _VECTOR)]


def _with_groups(rows: DataFrame, p: Outliers) -> DataFrame:
    """``__group``: the language and source, or the language, or one for all, as there are enough judged rows."""
    lang, source = F.struct(F.col("lang").alias("lang")), F.struct(F.col("lang").alias("lang"), F.col("source").alias("source"))
    counts = rows.groupBy("lang", "source").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n"))
    few = F.sum(F.when(F.col("n") < p.least_rows, F.col("n")).otherwise(0)).over(Window.partitionBy("lang"))  # a row per language and source
    group = F.when(F.col("n") >= p.least_rows, F.to_json(source)).when(few >= p.least_rows, F.to_json(lang)).otherwise("{}")
    groups = stored(counts.select(F.col("lang").alias("__l"), F.col("source").alias("__s"), group.alias("__group")))
    return rows.join(sized(groups, p.broadcast_groups), F.col("lang").eqNullSafe(F.col("__l")) & F.col("source").eqNullSafe(F.col("__s"))).drop("__l", "__s")


def _moments(rows: DataFrame, p: Outliers) -> DataFrame:
    """Centre and the triangular root of the scatter of each group, a column per entry."""
    x = [F.col(f"__{name}") for name in _VECTOR]
    sums = [F.sum(x[i].cast("decimal(18,0)")).alias(f"s{i}") for i in range(5)]
    sums += [F.sum((x[i] * x[j]).cast("decimal(18,0)")).alias(f"s{i}{j}") for i in range(5) for j in range(i + 1)]
    out = rows.groupBy("__group").agg(F.count(F.lit(1)).cast("double").alias("n"), *sums)
    out = out.withColumns({f"m{i}": F.col(f"s{i}").cast("double") / F.col("n") / SCALE for i in range(5)})
    scatter = {}
    for i in range(5):
        for j in range(i + 1):
            cov = F.col(f"s{i}{j}").cast("double") / F.col("n") / SCALE ** 2 - F.col(f"m{i}") * F.col(f"m{j}")
            scatter[f"c{i}{j}"] = cov + (p.least_spread[i] ** 2 if i == j else 0.0)
    out = out.withColumns(scatter)
    for i in range(5):  # Cholesky, row by row
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.select("__group", *_parameters())


def _parameters() -> list[str]:
    return [f"m{i}" for i in range(5)] + [f"l{i}{j}" for i in range(5) for j in range(i + 1)]


def _with_distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """``__d2``: squared Mahalanobis distance, by substitution into the triangular root."""
    out = rows.join(estimate, "__group", "left")
    for i, name in enumerate(_VECTOR):
        rest = F.col(f"__{name}") / SCALE - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"z{j}")
        out = out.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    total = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, 5)), F.col("z0") * F.col("z0"))
    return out.withColumn("__d2", total).drop(*_parameters(), *[f"z{i}" for i in range(5)])


def _bin(d2: Column) -> Column:
    return F.floor(_BINS * F.log2(1 + 16 * d2)).cast("int")


def _quantile_bins(distances: DataFrame, shares: dict[str, float]) -> DataFrame:
    """For each group the first bins of distance below which the shares of its rows lie."""
    counts = distances.groupBy("__group", _bin(F.col("__d2")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("__group").orderBy("bin"))  # a row per group and bin
    total = F.sum("n").over(Window.partitionBy("__group"))
    ranked = counts.select("__group", "bin", upto.alias("upto"), total.alias("total"))
    return ranked.groupBy("__group").agg(*[F.min(F.when(F.col("upto") >= share * F.col("total"), F.col("bin"))).alias(name)
                                           for name, share in shares.items()])


def estimates(rows: DataFrame, p: Outliers) -> DataFrame:
    """The estimate of each group (``__group``, its parameters, ``scale``) from the rows that the base rules keep.

    The first subset are the vectors nearest to the medians, each statistic measured by
    its own spread about them.
    """
    used = rows.filter(~F.col("base_failed")).select("__group", *[f"__{name}" for name in _VECTOR])
    middles = used.groupBy("__group").agg(*[F.percentile_approx(f"__{name}", [0.25, 0.5, 0.75]).alias(f"q{i}") for i, name in enumerate(_VECTOR)])
    start = {f"m{i}": F.col(f"q{i}")[1] / SCALE for i in range(5)}
    for i in range(5):
        spread = F.col(f"q{i}")[2] - F.col(f"q{i}")[0]
        start |= {f"l{i}{j}": F.sqrt(F.pow(spread / SCALE / 1.349, 2) + p.least_spread[i] ** 2) if i == j else F.lit(0.0) for j in range(i + 1)}
    estimate = stored(middles.select("__group", *[c.alias(k) for k, c in start.items()]))
    for _ in range(p.steps):
        distances = _with_distance(used, sized(estimate, p.broadcast_groups))
        edges = sized(stored(_quantile_bins(distances, {"edge": p.share})), p.broadcast_groups)  # a row a group
        estimate = stored(_moments(distances.join(edges, "__group").filter(_bin(F.col("__d2")) <= F.col("edge")), p))
    middle = _quantile_bins(_with_distance(used, sized(estimate, p.broadcast_groups)), {"edge": 0.5})
    scale = F.greatest((F.pow(2.0, (F.col("edge") + 0.5) / _BINS) - 1) / 16 / _MEDIAN_CHI2_5, F.lit(0.25))
    return stored(estimate.join(middle.select("__group", scale.alias("scale")), "__group"))


def judge(docs: DataFrame, p: Outliers = Outliers(), keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every document, its base counts, base_failed, distance (squared) and kept.

    ``docs`` has text, lang and source; null languages and sources are groups of their
    own, and a null text has no words and fails the base rules. Texts of one group that
    are all alike are all kept. Repeated rows are judged each, an empty table gives no
    rows, and columns of the input with the names of results are replaced.
    """
    results = [*COUNTS, "base_failed", "distance", "kept"]
    carried = [c for c in keep if c not in results]
    needed = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carried, "text", "lang", "source"])])
    counted = with_counts(needed).withColumn("base_failed", base_failed(p))
    held = stored(counted.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carried, "lang", "source"])], *COUNTS, "base_failed", *_statistics()))
    rows = _with_groups(held, p)
    estimate = sized(estimates(_with_groups(held.drop(*[c for c in carried if c not in ("lang", "source")]), p), p), p.broadcast_groups)
    judged = _with_distance(rows, estimate)
    distance = F.round(F.col("__d2") / F.col("scale"), 6)
    kept = ~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= p.cutoff)
    return judged.select(*[F.col(f"`{c}`") for c in carried], *COUNTS, "base_failed", distance.alias("distance"), kept.alias("kept"))
