"""Sigmoids, random cosine features and forest prefixes against plain numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ledgerline.operators import forest
from ledgerline.operators import margins as mg
from ledgerline.operators import models as md
from ledgerline.plans import experiment as ex


def numpy_sigmoid(m, y, steps=200):
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 0.0, math.log((neg + 1) / (pos + 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(a * m + b))
        g = np.array([(m * (t - p)).sum(), (t - p).sum()])
        w = p * (1 - p)
        a, b = np.array([a, b]) - 0.5 * np.linalg.solve([[(m * m * w).sum(), (m * w).sum()], [(m * w).sum(), w.sum()]], g)
    return a, b


def test_sigmoid_matches_newton_in_numpy(spark):
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.3).astype(float)
    m = rng.normal(y * 1.5 - 0.7, 1.0)
    df = spark.createDataFrame(list(zip(m.tolist(), y.tolist())), f"{mg.MARGIN} double, {mg.LABEL} double").repartition(3)
    s = mg.fit_sigmoid(df)
    assert (s.a, s.b) == pytest.approx(numpy_sigmoid(m, y), abs=1e-5)
    far = spark.createDataFrame([(1e4, 1.0), (-1e4, 0.0), (2e4, 1.0)], f"{mg.MARGIN} double, {mg.LABEL} double")
    s = mg.fit_sigmoid(far)
    assert all(0 <= r[0] <= 1 for r in far.select(s.column(F.col(mg.MARGIN))).collect())
    one = far.filter(f"{mg.LABEL} = 1")
    assert math.isfinite(mg.fit_sigmoid(one).b) and math.isfinite(mg.fit_sigmoid(one.limit(0)).b)


def test_cosines_stand_for_the_kernel(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (12, 4))
    f = mg.Fourier(0.3, 20_000, 7)
    z = f.project(x)
    want = np.exp(-0.3 * ((x[:, None] - x[None, :]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - want).max() < 0.05
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, a array<double>").select("i", array_to_vector("a").alias("features"))
    small = mg.Fourier(0.3, 50, 7)
    got = {r.i: r.a for r in small.apply(df).select("i", vector_to_array("features").alias("a")).collect()}
    assert np.allclose([got[i] for i in range(12)], small.project(x))
    assert mg.scale_gamma(df) == pytest.approx(1 / (4 * x.var()))
    assert small.apply(df.limit(0)).count() == 0 and mg.scale_gamma(df.limit(0)) == 1.0


def ring(spark, n=300):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        x, z = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, x, z, rng.choice(["a", "b"]), int(x * x + z * z > 1.4)))
    return spark.createDataFrame(rows, "i long, x double, z double, c string, y int")


def test_kernel_tells_a_ring_and_scores_are_probabilities(spark):
    data = ex.fold_inputs(ring(spark), "y", "i", ["x", "z"], ["c"], "SVM", folds=3)
    areas = {}
    for kernel in ("linear", "rbf"):
        scores = ex.out_of_fold(data, "SVM", {"C": 1, "kernel": kernel}).collect()
        assert all(0 < r.score < 1 for r in scores)
        y, s = np.array([r[md.LABEL] for r in scores]), np.array([r.score for r in scores])
        areas[kernel] = np.mean(s[y == 1][:, None] > s[y == 0][None, :])
        assert abs(s.mean() - y.mean()) < 0.1  # the sigmoid calibrates
    assert areas["rbf"] > 0.9 > areas["linear"]
    with pytest.raises(ValueError, match="kernel"):
        ex.fit(data, "SVM", {"kernel": "cubic"}, None)
    assert {p["kernel"] for p in md.grid_points("SVM")} == {"linear", "rbf"}


def test_machines_are_those_of_linear_svc_in_shared_passes(spark):
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(0, 1, 3000), rng.normal(300, 40, 3000), rng.integers(0, 2, 3000), np.ones(3000)])
    y = (x[:, 0] + x[:, 1] / 40 + 0.6 * x[:, 2] + rng.normal(0, 0.8, 3000) > 8).astype(float)
    rows = [(r.tolist(), t, 1.0 + t, i % 4) for i, (r, t) in enumerate(zip(x, y.tolist()))]
    df = spark.createDataFrame(rows, f"a array<double>, {mg.LABEL} double, {mg.WEIGHT} double, fold int").withColumn(mg.FEATURES, array_to_vector("a")).repartition(3).persist()
    sc, group = spark.sparkContext, "machines of shared passes"
    sc.setJobGroup(group, group)
    fitted = md.build_classifier("SVM", {"C": 1, "kernel": "linear"}, 3000.0).fit(df)
    jobs = len(sc.statusTracker().getJobIdsForGroup(group))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 300  # five machines one after the other took several times that
    blocks = mg._blocks(df, None, 3)
    found = mg.fit_machines(blocks, [2, None], 1 / 3000)
    plain = LinearSVC(featuresCol=mg.FEATURES, labelCol=mg.LABEL, weightCol=mg.WEIGHT, regParam=1 / 3000, maxIter=100, standardization=False)
    for machine, part in zip(found, (df.filter("fold <> 2"), df)):
        want = plain.fit(part)
        assert np.allclose(machine.coefficients, want.coefficients.toArray(), rtol=1e-2, atol=1e-3)
        assert machine.intercept == pytest.approx(want.intercept, rel=1e-2)
    assert np.allclose(fitted.machine.coefficients, found[1].coefficients)


def test_forest_prefixes(spark):
    data = ex.fold_inputs(ring(spark), "y", "i", ["x", "z"], ["c"], "RandomForest", folds=3)
    fitted = ex.fit(data, "RandomForest", {"n_estimators": 12, "max_depth": 4}, "balanced")
    rows = ex.apply_features(fitted.preparation, data.rows)
    trees = forest.trees_of(fitted.model)
    assert len(trees) == 12
    found = forest.prefix_scores(fitted.model.transform(rows), trees, [1, 5, 12]).select("i", "scores", vector_to_array("probability").alias("p")).collect()
    assert all(r.scores[2] == pytest.approx(r.p[1], abs=1e-9) for r in found)
    votes = [{r.i: r.p[1] for r in t.transform(rows.select("i", "features")).select("i", vector_to_array("probability").alias("p")).collect()}
             for t in fitted.model.trees[:5]]
    assert all(r.scores[0] == pytest.approx(votes[0][r.i]) and r.scores[1] == pytest.approx(np.mean([v[r.i] for v in votes])) for r in found)


@pytest.mark.parametrize("name, key", [("RandomForest", "n_estimators"), ("HistGradientBoosting", "max_iter"), ("XGBoost", "n_estimators")])
def test_search_by_prefixes_equals_single_fits(spark, name, key):
    data = ex.fold_inputs(ring(spark), "y", "i", ["x", "z"], ["c"], name, folds=2)
    grid = {key: [2, 5], "max_depth": [2, 3]}
    results = {(r.params, r.fold, r.metric): r.value for r in ex.search(data, name, grid).collect()}
    assert len(results) == 4 * 2 * 8
    params = {key: 5, "max_depth": 3}
    fitted = ex.fit(data, name, params, md.default_scheme(name), held_out=0)
    from ledgerline.operators import evaluation as ev

    alone = ev.metrics(fitted.score(data.rows.filter("fold = 0")), md.SCORE, md.LABEL).first()
    import json

    assert results[json.dumps(params), 0, "roc_auc"] == pytest.approx(alone.roc_auc, abs=1e-6)
    assert len(md.prefix_groups(name, md.grid_points(name))) == 12


def test_blocks_keep_the_features_as_given(spark):
    x = np.random.default_rng(4).normal(0, 1, (5000, 3))
    rows = [(r.tolist(), float(i % 2), 1.0, i % 3) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, f"a array<double>, {mg.LABEL} double, {mg.WEIGHT} double, fold int").withColumn(mg.FEATURES, array_to_vector("a")).coalesce(1)
    fourier = mg.Fourier(0.3, 256, 7)
    blocks = mg._blocks(df, fourier, 1)
    sizes = blocks.map(lambda b: (len(b.y), sum(v.nbytes for v in vars(b).values() if isinstance(v, np.ndarray)))).collect()
    assert sum(n for n, _ in sizes) == 5000
    assert max(n for n, _ in sizes) <= 2048 and all(size == n * 8 * (3 + 3) for n, size in sizes)  # 256 cosines a row are not kept
    made = np.concatenate(blocks.map(lambda b: b.x).collect())
    assert np.allclose(made, fourier.project(x))
    blocks.unpersist()
