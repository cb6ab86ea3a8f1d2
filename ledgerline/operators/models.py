"""The classifiers and their parameter grids."""

from __future__ import annotations

import itertools
from collections.abc import Mapping

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.boosting import Boosting
from ledgerline.operators.features import FEATURES
from ledgerline.operators.margins import CalibratedSVM

LABEL, WEIGHT, SCORE = "__label", "__weight", "score"
DEEPEST = 30  # the deepest tree MLlib grows stands for "no limit"

# The parameter grids.
GRIDS: dict[str, dict[str, list]] = {
    "LogisticRegression": {"C": [0.001, 0.01, 0.1, 1, 10, 100]},
    "RandomForest": {"n_estimators": [100, 200, 500, 1000], "max_depth": [3, 5, 10, None], "min_samples_split": [2, 5, 10]},
    "XGBoost": {"n_estimators": [100, 200, 500, 1000], "max_depth": [3, 5, 8], "learning_rate": [0.001, 0.01, 0.1, 0.3]},
    "SVM": {"C": [0.1, 1, 10], "kernel": ["linear", "rbf"]},
    "DecisionTree": {"max_depth": [3, 5, 10, None], "min_samples_split": [2, 5, 10]},
    "HistGradientBoosting": {"max_iter": [100, 200, 500, 1000], "max_depth": [3, 5, 8], "learning_rate": [0.001, 0.01, 0.1, 0.3]},
}


# What the two boosted classifiers differ in besides the parameters of their grids.
BOOSTED = {"XGBoost": {"l2": 1.0, "least_hessian": 1.0}, "HistGradientBoosting": {"l2": 0.0, "least_hessian": 0.001, "least_rows": 20}}

# The parameter of which a fit has all smaller values in it: the number of trees.
TREES = {"RandomForest": "n_estimators", "XGBoost": "n_estimators", "HistGradientBoosting": "max_iter"}


def check_classifier(name: str) -> str:
    if name not in GRIDS:
        raise ValueError(f"unknown classifier {name!r}; options: {list(GRIDS)}")
    return name


def grid_points(name: str, grid: Mapping[str, list] | None = None) -> list[dict]:
    grid = grid or GRIDS[check_classifier(name)]
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def prefix_groups(name: str, points: list[dict]) -> list[tuple[dict, list[tuple[int, int]]]]:
    """Grid points that one fit serves: (parameters with the most trees, [(number of the point, its trees)])."""
    key = TREES[name]
    groups: dict[tuple, list[tuple[int, int]]] = {}
    for i, params in enumerate(points):
        rest = tuple(sorted((k, v) for k, v in params.items() if k != key))
        groups.setdefault(rest, []).append((i, params.get(key, 100)))
    return [({**dict(rest), key: max(n for _, n in own)}, own) for rest, own in groups.items()]


def boosting_params(name: str, params: Mapping) -> Boosting:
    return Boosting(params.get(TREES[name], 100), params.get("max_depth", 6 if name == "XGBoost" else 5) or DEEPEST,
                    params.get("learning_rate", 0.3 if name == "XGBoost" else 0.1), **BOOSTED[name])


def is_scaled(name: str) -> bool:
    return check_classifier(name) == "LogisticRegression"


def build_classifier(name: str, params: Mapping, total_weight: float, seed: int = 33):
    """Estimator for one grid point.

    The inverse penalty C sums the loss over rows where MLlib averages it, hence the
    total weight. A minimum of s rows to split is read as s/2 rows per child.
    """
    common = {"featuresCol": FEATURES, "labelCol": LABEL, "weightCol": WEIGHT}
    check_classifier(name)
    if name in ("LogisticRegression", "SVM"):
        penalty = 1.0 / (params.get("C", 1.0) * total_weight)
        if name == "SVM":
            return CalibratedSVM(penalty, params.get("kernel", "linear"), seed)
        return LogisticRegression(**common, regParam=penalty, elasticNetParam=0.0, maxIter=1000, standardization=False)
    depth = params.get("max_depth", 5) or DEEPEST
    leaf = max(1, params.get("min_samples_split", 2) // 2)
    if name == "RandomForest":
        return RandomForestClassifier(**common, numTrees=params.get("n_estimators", 100), maxDepth=depth,
                                      minInstancesPerNode=leaf, seed=seed)
    return DecisionTreeClassifier(**common, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)


def with_label(df: DataFrame, label: str) -> DataFrame:
    """Binary label: equal to 1, missing is 0."""
    return df.withColumn(LABEL, F.col(label).cast("int").eqNullSafe(F.lit(1)).cast("double"))


def class_weights(n_neg: int, n_pos: int, scheme: str | None) -> tuple[float, float]:
    """Weights of a negative and of a positive row from the class counts of the training rows."""
    n = n_neg + n_pos
    if scheme is None or not n_pos or not n_neg:
        return 1.0, 1.0
    if scheme == "balanced":
        return n / (2.0 * n_neg), n / (2.0 * n_pos)
    if scheme == "pos_weight":
        return 1.0, n_neg / n_pos
    raise ValueError(f"unknown weight scheme {scheme!r}; known: balanced, pos_weight")


def weight_column(n_neg: int, n_pos: int, scheme: str | None) -> tuple[Column, float]:
    """Row weight from the class counts of the training rows, and the sum of all weights."""
    neg, pos = class_weights(n_neg, n_pos, scheme)
    return F.when(F.col(LABEL) == 1, F.lit(pos)).otherwise(F.lit(neg)), neg * n_neg + pos * n_pos


def default_scheme(name: str) -> str:
    return "pos_weight" if name == "XGBoost" else "balanced"


def decision_threshold(name: str) -> float:
    """Scores above this are positive; all scores are probabilities."""
    check_classifier(name)
    return 0.5


def score_rows(name: str, model, df: DataFrame) -> DataFrame:
    """Add the score of the positive class: its probability."""
    check_classifier(name)
    scored = model.transform(df).withColumn(SCORE, vector_to_array("probability")[1])
    return scored.drop("rawPrediction", "probability", "prediction")
