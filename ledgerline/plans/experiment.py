"""Model search, out-of-fold evaluation and importances on an entity table."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import boosting, forest
from ledgerline.operators import evaluation as ev
from ledgerline.operators import models as md
from ledgerline.operators import stats
from ledgerline.operators.features import (
    Features, apply_features, encode_inputs, feature_names, fit_features, missing, model_inputs, plan_features,
)
from ledgerline.sources.shared import stored
from ledgerline.sources.spec import Experiment
from ledgerline.sources.tables import with_row_order


@dataclass
class Fitted:
    """A prepared and fitted classifier; a boosted one bins its inputs itself and has no preparation."""

    name: str
    spec: Features
    preparation: PipelineModel | None
    model: object

    def score(self, inputs: DataFrame) -> DataFrame:
        """Score rows prepared by ``model_inputs``."""
        if self.preparation is None:
            return self.model.score(inputs, out=md.SCORE)
        return md.score_rows(self.name, self.model, apply_features(self.preparation, inputs)).drop("features")

    @property
    def names(self) -> list[str]:
        return self.model.binning.names if self.preparation is None else feature_names(self.preparation, self.spec)

    def odds_ratios(self, spark) -> DataFrame:
        """Exponentials of the coefficients."""
        coefficients = ev.named_vector(spark, self.names, self.model.coefficients.toArray(), "coefficient")
        return coefficients.select("feature", F.exp("coefficient").alias("odds_ratio")).orderBy(F.desc("odds_ratio"))

    def importances(self, spark) -> DataFrame:
        values = self.model.importances() if self.preparation is None else self.model.featureImportances.toArray()
        return ev.named_vector(spark, self.names, values, "importance")

    def rules(self) -> str:
        """The tree as text with feature names in place of positions."""
        text = self.model.toDebugString
        for i, name in reversed(list(enumerate(self.names))):
            text = text.replace(f"feature {i} ", f"{name} ")
        return text


@dataclass
class Folded:
    """Inputs with label and fold, and the class counts per fold."""

    rows: DataFrame
    spec: Features
    counts: dict[int, tuple[int, int]]

    def train_counts(self, held_out: int | None = None) -> tuple[int, int]:
        kept = [c for f, c in self.counts.items() if f != held_out]
        return sum(c[0] for c in kept), sum(c[1] for c in kept)


def fold_inputs(df: DataFrame, label: str, ordinal: str, numeric: Sequence[str], categorical: Sequence[str],
                classifier: str, folds: int = 5) -> Folded:
    """Model inputs cut into stratified folds, computed once for all the fits to come.

    The inputs are stored first, so finding gaps, classes and ranks does not derive
    them again.
    """
    base = stored(md.with_label(df, label).select(ordinal, md.LABEL, *numeric, *categorical))
    spec = plan_features(base, numeric, categorical, md.is_scaled(classifier))
    rows = stored(ev.stratified_folds(model_inputs(base, spec), md.LABEL, ordinal, folds))
    y = F.col(md.LABEL) == 1
    found = rows.groupBy("fold").agg(F.count_if(~y).alias("neg"), F.count_if(y).alias("pos")).collect()
    return Folded(rows, spec, {r["fold"]: (r["neg"], r["pos"]) for r in found})


def _boosted(data: Folded, classifier: str, points: Sequence[Mapping], folds: Sequence[int | None], scheme: str | None) -> list[boosting.Boosted]:
    """The model of each point without each fold (folds within points), all grown in the same passes.

    Bin edges and categories are those of all rows; labels have no part in them.
    """
    binning = boosting.plan_bins(data.rows, data.spec.numeric, data.spec.categorical)
    tasks = [boosting.Task(md.boosting_params(classifier, p), f, md.class_weights(*data.train_counts(f), scheme)) for p in points for f in folds]
    return boosting.fit_boosted(data.rows, binning, md.LABEL, tasks, "fold")


def fit(data: Folded, classifier: str, params: Mapping, scheme: str | None, held_out: int | None = None, seed: int = 33) -> Fitted:
    if classifier in md.BOOSTED:
        return Fitted(classifier, data.spec, None, _boosted(data, classifier, [params], [held_out], scheme)[0])
    train = data.rows if held_out is None else data.rows.filter(F.col("fold") != held_out)
    preparation = fit_features(train, data.spec)
    weight, total = md.weight_column(*data.train_counts(held_out), scheme)
    prepared = apply_features(preparation, train).withColumn(md.WEIGHT, weight)
    model = md.build_classifier(classifier, params, total, seed).fit(prepared)
    return Fitted(classifier, data.spec, preparation, model)


def _numbered(scored: DataFrame, numbers: Sequence[int]) -> DataFrame:
    """A row for each of the scores in an array, with the number of the grid point that it belongs to."""
    each = F.posexplode("scores").alias("__at", md.SCORE)
    ids = F.element_at(F.array(*map(F.lit, numbers)), F.col("__at") + 1).alias("param_id")
    return scored.select("fold", md.LABEL, each).select(ids, "fold", md.LABEL, md.SCORE)


def _search_boosted(data: Folded, classifier: str, points: list[dict], scheme: str | None) -> DataFrame:
    """Scores of every point on every fold: the first trees of the longest model are the shorter ones."""
    groups, folds = md.prefix_groups(classifier, points), sorted(data.counts)
    models = _boosted(data, classifier, [p for p, _ in groups], folds, scheme)
    prefixes = sorted({n for _, own in groups for _, n in own})
    by_fold = {f: [models[g * len(folds) + k] for g in range(len(groups))] for k, f in enumerate(folds)}
    wanted = {(g, n): i for g, (_, own) in enumerate(groups) for i, n in own}
    numbers = [wanted.get((g, n), -1) for g in range(len(groups)) for n in prefixes]
    return _numbered(boosting.score_folds(data.rows, "fold", by_fold, prefixes), numbers).filter("param_id >= 0")


def search(data: Folded, classifier: str, grid: Mapping[str, list] | None = None, scheme: str | None = "default",
           seed: int = 33, parallelism: int = 4) -> DataFrame:
    """Every metric of every parameter set on every fold, as (param_id, params, fold, metric, value).

    The preparation is fitted once per fold and its output kept for all parameter
    sets; one metrics job per fold scores them together. Of forests and boosted models
    that differ only in the number of trees, the largest is fitted and scored at each
    number; boosted models of all folds and sets grow in the same passes.
    """
    points = md.grid_points(classifier, grid)
    scheme = md.default_scheme(classifier) if scheme == "default" else scheme
    threshold = md.decision_threshold(classifier)
    keys = ["param_id", "fold"]

    def measured(scored: DataFrame) -> DataFrame:
        return ev.long_metrics(ev.metrics(scored, md.SCORE, md.LABEL, threshold, keys), keys)

    def one_fold(fold: int) -> DataFrame:
        train_part = F.col("fold") != fold
        preparation = fit_features(data.rows.filter(train_part), data.spec)
        prepared = stored(apply_features(preparation, data.rows).select(md.LABEL, "fold", "features"))
        weight, total = md.weight_column(*data.train_counts(fold), scheme)
        train = prepared.filter(train_part).withColumn(md.WEIGHT, weight)
        test = prepared.filter(~train_part)
        scored = []
        if classifier == "RandomForest":
            for params, own in md.prefix_groups(classifier, points):
                trees = forest.trees_of(md.build_classifier(classifier, params, total, seed).fit(train))
                scored.append(_numbered(forest.prefix_scores(test, trees, [n for _, n in own]), [i for i, _ in own]))
        else:
            for i, params in enumerate(points):
                model = md.build_classifier(classifier, params, total, seed).fit(train)
                rows = md.score_rows(classifier, model, test).select(F.lit(i).alias("param_id"), "fold", md.LABEL, md.SCORE)
                scored.append(rows)
        return measured(reduce(DataFrame.unionByName, scored))

    if classifier in md.BOOSTED:
        parts = [measured(stored(_search_boosted(data, classifier, points, scheme)))]
    else:
        with ThreadPool(parallelism) as pool:
            parts = pool.map(one_fold, sorted(data.counts))
    texts = data.rows.sparkSession.createDataFrame(
        [(i, json.dumps(p)) for i, p in enumerate(points)], "param_id int, params string")
    return reduce(DataFrame.unionByName, parts).join(F.broadcast(texts), "param_id").select(
        "param_id", "params", "fold", "metric", "value")


def best_params(results: DataFrame, criteria: str) -> dict:
    """Parameters of the first-ranked set."""
    return json.loads(ev.rank_results(results, criteria).first()["params"])


def out_of_fold(data: Folded, classifier: str, params: Mapping, scheme: str | None = "default", seed: int = 33,
                parallelism: int = 4) -> DataFrame:
    """Scores of each row from the model that was fitted without its fold."""
    scheme = md.default_scheme(classifier) if scheme == "default" else scheme
    if classifier in md.BOOSTED:
        folds = sorted(data.counts)
        models = dict(zip(folds, ([m] for m in _boosted(data, classifier, [params], folds, scheme))))
        scored = boosting.score_folds(data.rows, "fold", models, [md.boosting_params(classifier, params).rounds])
        return scored.withColumn(md.SCORE, F.element_at("scores", 1)).drop("scores")

    def one_fold(fold: int) -> DataFrame:
        fitted = fit(data, classifier, params, scheme, fold, seed)
        return fitted.score(data.rows.filter(F.col("fold") == fold))

    with ThreadPool(parallelism) as pool:
        return reduce(DataFrame.unionByName, pool.map(one_fold, sorted(data.counts)))


def permutation_importance(data: Folded, fitted: Fitted, ordinal: str, metric: str = "roc_auc", repeats: int = 10,
                           seed: int = 42) -> DataFrame:
    """Drop of the metric when one input column is dealt to other rows: mean and deviation over repeats.

    A value may go to any row of the table; the rows are numbered in the order of ``ordinal``.
    """
    threshold = md.decision_threshold(fitted.name)
    base = ev.metrics(fitted.score(data.rows), md.SCORE, md.LABEL, threshold).first()[metric]
    numbered = stored(with_row_order(stored(data.rows.orderBy(ordinal)), "__index"))
    copies = ev.shuffled(numbered, data.spec.columns, "__index", repeats, seed)
    if data.spec.gaps:
        copies = copies.withColumns({f"{c}_missing": missing(c).cast("double") for c in data.spec.gaps})
    scored = stored(fitted.score(copies).select("feature", "repeat", md.LABEL, md.SCORE))  # the metrics read it several times
    scores = ev.metrics(scored, md.SCORE, md.LABEL, threshold, ["feature", "repeat"])
    drop = F.lit(base) - F.col(metric)
    return scores.groupBy("feature").agg(F.avg(drop).alias("importance"), F.stddev_pop(drop).alias("std")).orderBy(
        F.desc("importance"), "feature")


def flatten_results(results: DataFrame, run: str) -> DataFrame:
    """Search results as (run, key, value) text rows for a metrics table."""
    key = F.concat_ws("/", F.lit("param"), F.col("param_id").cast("string"), F.lit("fold"), F.col("fold").cast("string"), "metric")
    return results.select(F.lit(run).alias("run"), key.alias("key"), F.col("value").cast("string").alias("value"))


def average_results(results: DataFrame) -> DataFrame:
    """Mean and deviation over folds of every metric of every parameter set."""
    return results.groupBy("param_id", "params", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def run(table: DataFrame, spec: Experiment, ordinal: str, classifier: str = "RandomForest", criteria: str = "roc_auc",
        class_weights: bool = True, grid: Mapping[str, list] | None = None, repeats: int = 10) -> dict:
    """A whole experiment on an entity table; every entry but ``params`` and ``rules`` is a DataFrame."""
    spark = table.sparkSession
    df, numeric, categorical = encode_inputs(table, spec.num_features, spec.cat_features)
    inputs = list(dict.fromkeys(numeric + categorical))
    df = stored(md.with_label(df, spec.target).select(ordinal, *inputs, F.col(md.LABEL).cast("int").alias("label")))
    out: dict = {
        "check": stats.pattern_check(df, inputs, "label"), "conflicts": stats.label_conflicts(df, inputs, "label"),
        "conflict_rows": stats.conflict_rows(df, inputs, "label"), "fingerprint": stats.fingerprint(df, [*inputs, "label"]),
        "balance": stats.class_balance(df, "label"),
        "distributions": {c: stats.class_distribution(df, c, "label") for c in inputs}}
    scheme = md.default_scheme(classifier) if class_weights else None
    data = fold_inputs(df, "label", ordinal, numeric, categorical, classifier)
    results = stored(search(data, classifier, grid, scheme, spec.seed))
    params = best_params(results, criteria)
    fitted = fit(data, classifier, params, scheme, seed=spec.seed)
    scores = stored(out_of_fold(data, classifier, params, scheme, spec.seed))
    threshold = md.decision_threshold(classifier)
    out |= {"results": results, "ranking": ev.rank_results(results, criteria), "params": params, "scores": scores,
            "metrics": ev.metrics(scores, md.SCORE, md.LABEL, threshold), "confusion": ev.confusion(scores, md.SCORE, md.LABEL, threshold),
            "curves": ev.curves(scores, md.SCORE, md.LABEL), "log": flatten_results(results, classifier)}
    if classifier == "LogisticRegression":
        out["odds_ratios"] = fitted.odds_ratios(spark)
    if classifier == "DecisionTree":
        out["rules"] = fitted.rules()
    if classifier in md.BOOSTED:
        out["importances"] = fitted.importances(spark)
    if classifier == "RandomForest":
        out["importances"] = fitted.importances(spark)
        out["permutation"] = permutation_importance(data, fitted, ordinal, criteria, repeats, spec.seed)
    return out
