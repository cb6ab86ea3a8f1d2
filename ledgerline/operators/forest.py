"""Scores by the first trees of a forest: one fitted forest serves every smaller one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.features import FEATURES
from ledgerline.sources.shared import new_path


@dataclass
class Nodes:
    """The nodes of one tree; a node without children has left -1."""

    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    sets: dict[int, frozenset[float]]  # values that go left, of nodes that split a category
    share: np.ndarray  # of the positive class

    def shares(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            inner = self.left[at] >= 0
            if not inner.any():
                return self.share[at]
            value = x[rows, np.maximum(self.feature[at], 0)]
            left = value <= self.cut[at]
            for node, values in self.sets.items():
                here = at == node
                if here.any():
                    left[here] = np.isin(value[here], list(values))
            at = np.where(inner, np.where(left, self.left[at], self.right[at]), at)


def trees_of(model) -> list[Nodes]:
    """The trees of a fitted forest, in order, from its saved form in the shared folder."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = new_path(spark)
    model.save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").toPandas()
    out = []
    for _, nodes in sorted(rows.groupby("treeID")):
        nodes = nodes.sort_values("id")
        place = {i: k for k, i in enumerate(nodes["id"])}
        split = nodes["split"].tolist()
        stats = np.stack([np.asarray(s, np.float64) for s in nodes["impurityStats"]])
        child = lambda c: np.array([place.get(i, -1) for i in nodes[c]])
        kinds = [s["numCategories"] if s is not None else -1 for s in split]
        cuts = [np.asarray(s["leftCategoriesOrThreshold"] if s is not None else [], np.float64) for s in split]
        out.append(Nodes(child("leftChild"), child("rightChild"), np.array([s["featureIndex"] if s is not None else -1 for s in split]),
                         np.array([c[0] if k < 0 and len(c) else np.nan for k, c in zip(kinds, cuts)]),
                         {i: frozenset(c.tolist()) for i, (k, c) in enumerate(zip(kinds, cuts)) if k >= 0 and child("leftChild")[i] >= 0},
                         stats[:, 1] / stats.sum(axis=1)))
    return out


def prefix_scores(df: DataFrame, trees: list[Nodes], prefixes: Sequence[int], out: str = "scores") -> DataFrame:
    """``df`` with the mean share of the positive class over the first trees, an item for each prefix."""
    wanted = list(prefixes)

    @F.pandas_udf("array<double>")
    def scores(features: pd.Series) -> pd.Series:
        x = np.stack(features.to_numpy()) if len(features) else np.empty((0, 0))
        total, found = np.zeros(len(x)), np.empty((len(x), len(wanted)))
        for i, tree in enumerate(trees, 1):
            total += tree.shares(x)
            for k, prefix in enumerate(wanted):
                if prefix == i:
                    found[:, k] = total / i
        return pd.Series(list(found))

    return df.withColumn(out, scores(vector_to_array(FEATURES)))
