"""Dense vectors by a randomised decomposition, against the exact one of numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators.vectors import fit_projection, project


def table(spark, m):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "i long, v array<double>")


def test_projection_keeps_what_the_best_one_keeps(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(300, 20)) @ rng.normal(size=(20, 90)) + 0.05 * rng.normal(size=(300, 90))
    df = table(spark, m).repartition(70)  # more tasks than are added at once
    w = fit_projection(df, "v", dims=12, extra=8)
    assert w.shape == (90, 12) and np.allclose(w.T @ w, np.eye(12), atol=1e-9)
    s = np.linalg.svd(m, compute_uv=False)
    best = (s[12:] ** 2).sum()
    assert np.linalg.norm(m - m @ w @ w.T) ** 2 <= 1.02 * best
    got = {r.i: r.dense for r in project(df, w, "v").collect()}
    assert np.allclose([got[i] for i in range(300)], m @ w, rtol=1e-4, atol=1e-4)
    again = fit_projection(df.repartition(3), "v", dims=12, extra=8)
    assert np.allclose(again, w, atol=1e-6)


def test_projection_of_odd_tables(spark):
    few = table(spark, np.eye(3)).unionByName(spark.createDataFrame([(8, None), (9, [])], "i long, v array<double>"))
    w = fit_projection(few, "v", dims=64)
    assert w.shape == (3, 3)
    out = {r.i: r.dense for r in project(few, w, "v").collect()}
    assert out[8] is None and out[9] is None and sum(x * x for x in out[0]) == pytest.approx(1)
    assert fit_projection(few.limit(0), "v").shape == (0, 64)
    assert project(few.filter(F.col("i") > 7), np.zeros((0, 64)), "v").filter("dense IS NULL").count() == 2
