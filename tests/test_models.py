"""Folds, metrics, curves, features and model search."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import evaluation as ev
from ledgerline.operators import features as ft
from ledgerline.operators import models as md
from ledgerline.plans import experiment as ex


def expected_folds(labels, k=5):
    """Fold of each row by the definition: deal the label-sorted rows, then cut each class in blocks."""
    order = {c: i for i, c in enumerate(dict.fromkeys(labels))}
    coded = [order[c] for c in labels]
    dealt = sorted(coded)
    folds = [None] * len(labels)
    for c in set(coded):
        sizes = [dealt[i::k].count(c) for i in range(k)]
        members = [i for i, x in enumerate(coded) if x == c]
        blocks = [f for f, n in enumerate(sizes) for _ in range(n)]
        for i, f in zip(members, blocks):
            folds[i] = f
    return folds


@pytest.mark.parametrize("split", [False, True])
def test_stratified_folds(spark, request, split):
    if split:
        request.getfixturevalue("split_groups")
    rnd = random.Random(3)
    labels = [int(rnd.random() < 0.3) for _ in range(53)]
    df = spark.createDataFrame(list(enumerate(labels)), "i long, y int").repartition(4)
    got = [r.fold for r in ev.stratified_folds(df, "y", "i").orderBy("i").collect()]
    assert got == expected_folds(labels)


def brute_metrics(rows):
    y = np.array([r[0] for r in rows])
    s = np.array([r[1] for r in rows])
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for a in s[y == 1] for b in s[y == 0]]
    ap, before = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp, n = ((s >= t) & (y == 1)).sum(), (s >= t).sum()
        recall = tp / (y == 1).sum()
        ap += (recall - before) * tp / n
        before = recall
    return ap, float(np.mean(pairs))


@pytest.mark.parametrize("split", [False, True])
def test_areas_match_brute_force(spark, request, split):
    if split:
        request.getfixturevalue("split_groups")
    rnd = random.Random(1)
    rows = [(g, y, round(min(1.0, max(0.0, rnd.gauss(0.4 + 0.2 * y, 0.2))), 1 + g)) for g in (0, 1) for y in (0, 1, 0) for _ in range(40)]
    df = spark.createDataFrame(rows, "g int, y int, s double")
    got = {r.g: r for r in ev.metrics(df, "s", "y", 0.5, ["g"]).collect()}
    for g in (0, 1):
        ap, auc = brute_metrics([(y, s) for k, y, s in rows if k == g])
        assert got[g].pr_auc == pytest.approx(ap) and got[g].roc_auc == pytest.approx(auc)
    whole = ev.metrics(df, "s", "y").first()
    ap, auc = brute_metrics([(y, s) for _, y, s in rows])
    assert whole.pr_auc == pytest.approx(ap) and whole.roc_auc == pytest.approx(auc)


def test_threshold_is_strict_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.6), (0, 0.5), (0, 0.4)], "y int, s double")
    assert tuple(ev.confusion(df, "s", "y").first()) == (1, 0, 1, 2)
    one = ev.metrics(df.filter("y = 0"), "s", "y").first()
    assert one.roc_auc is None and one.recall == 0 and one.accuracy == 1


def test_ranking(spark):
    rows = [(p, f"{p}", f, "roc_auc", v) for p, vs in enumerate([(0.5, 0.7), (0.9, 0.9), (0.6, 0.6)]) for f, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "param_id int, params string, fold int, metric string, value double")
    got = [(r.param_id, r["rank"], round(r.std_score, 6)) for r in ev.rank_results(df, "roc_auc").collect()]
    assert got == [(1, 1, 0.0), (0, 2, 0.1), (2, 2, 0.0)]
    assert ex.flatten_results(df, "run").count() == 6
    assert ex.average_results(df).count() == 3


def toy(spark, n=120):
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        x = rnd.gauss(0, 1)
        c = rnd.choice(["a", "b", None])
        y = int(x + (0.8 if c == "a" else 0) + rnd.gauss(0, 0.7) > 0.5)
        rows.append((i, x if rnd.random() > 0.1 else None, rnd.gauss(0, 1), c, y))
    return spark.createDataFrame(rows, "i long, x double, noise double, c string, y int")


def test_features(spark):
    df = toy(spark)
    spec = ft.plan_features(df, ["x", "noise"], ["c"], scaled=False)
    assert spec.gaps == ("x",)
    inputs = ft.model_inputs(df, spec)
    prep = ft.fit_features(inputs.filter("c = 'a' or c = '__null__'"), spec)
    names = ft.feature_names(prep, spec)
    assert names == ["num__x", "num__noise", "num__x_missing", "cat__c___null__", "cat__c_a"]
    rows = ft.apply_features(prep, inputs).select("c", "features").collect()
    assert all(r.features.size == len(names) for r in rows)
    # A category without slot gives zeros.
    assert all(r.features[3] == r.features[4] == 0 for r in rows if r.c == "b")
    scaled = ft.plan_features(df, ["x"], [], scaled=True)
    prep = ft.fit_features(ft.model_inputs(df, scaled), scaled)
    xs = [r.features[0] for r in ft.apply_features(prep, ft.model_inputs(df, scaled)).collect()]
    assert abs(np.mean(xs)) < 1e-9 and np.std(xs) == pytest.approx(1)
    filled = ft.most_frequent_fill(spark.createDataFrame([("a",), ("b",), ("b",), ("a",), (None,)], "c string"), ["c"])
    assert filled.filter("c = 'a'").count() == 3


def test_encoding(spark):
    df = spark.createDataFrame([("Masculino", "SI"), ("Femenino", None), (None, "NO")], "Sexo string, IAE_PREVIO_CORREGIDO string")
    out, numeric, cats = ft.encode_inputs(df, ["Sexo", "IAE_PREVIO_CORREGIDO"], ["m"])
    assert numeric == ["Sexo", "IAE_PREVIO_SI", "IAE_PREVIO_NO"] and cats == ["m"]
    assert [tuple(r) for r in out.select(*numeric).collect()] == [(1, 1, 0), (0, 0, 0), (0, 0, 1)]


def test_search_and_importance(spark):
    data = ex.fold_inputs(toy(spark), "y", "i", ["x", "noise"], ["c"], "LogisticRegression")
    results = ex.search(data, "LogisticRegression", {"C": [0.01, 1]})
    assert results.count() == 2 * 5 * len(ev.METRICS)
    params = ex.best_params(results, "roc_auc")
    oof = ex.out_of_fold(data, "LogisticRegression", params)
    assert oof.count() == 120 and oof.select("i").distinct().count() == 120
    auc = ev.metrics(oof, md.SCORE, md.LABEL).first().roc_auc
    assert 0.7 < auc <= 1
    fitted = ex.fit(data, "LogisticRegression", params, "balanced")
    odds = {r.feature: r.odds_ratio for r in fitted.odds_ratios(spark).collect()}
    assert odds["num__x"] > 1.1 and set(odds) == set(fitted.names)
    drops = [r.feature for r in ex.permutation_importance(data, fitted, "i", repeats=3).collect()]
    assert drops[0] == "x" and set(drops) == {"x", "noise", "c"}


def test_trees(spark):
    data = ex.fold_inputs(toy(spark), "y", "i", ["x", "noise"], ["c"], "DecisionTree")
    fitted = ex.fit(data, "DecisionTree", {"max_depth": 2}, "balanced")
    assert "num__x" in fitted.rules() and "feature 0" not in fitted.rules()
    assert sum(r.importance for r in fitted.importances(spark).collect()) == pytest.approx(1)


def test_permutation_keeps_values(spark):
    df = spark.createDataFrame([(i, float(i), str(i % 7)) for i in range(100)], "i long, a double, b string")
    out = ev.permuted(df, ["a", "b"], "i", 2, block_rows=30)
    assert out.count() == 400
    for r in (0, 1):
        part = out.filter((F.col("repeat") == r) & (F.col("feature") == "a")).collect()
        assert sorted(x.a for x in part) == [float(i) for i in range(100)]
        assert all(x.b == str(x.i % 7) for x in part) and sum(x.a != x.i for x in part) > 80


def test_permutations_are_bijections():
    for n in (1, 2, 3, 7, 100, 101, 4096, 9973):
        seen = [tuple(ev.permutation(np.arange(n), n, key)) for key in (0, 1, 42)]
        assert all(sorted(p) == list(range(n)) for p in seen)
        assert n < 7 or len(set(seen)) == 3
    far = np.array([0, 10 ** 12 - 1, 5 * 10 ** 11])
    assert (ev.permutation(far, 10 ** 12, 3) < 10 ** 12).all() and len(ev.permutation(np.arange(0), 0, 1)) == 0
    moved = ev.permutation(np.arange(9973), 9973, 5)
    assert abs(np.corrcoef(moved, np.arange(9973))[0, 1]) < 0.05


def test_importances_equal_numpy_with_the_same_permutation(spark):
    df = spark.createDataFrame([(i, float(i), str(i % 7)) for i in range(200)], "i long, a double, b string")
    rows = ev.shuffled(df, ["a", "b"], "i", 2, seed=9).collect()
    assert len(rows) == 800
    for r in (0, 1):
        goes = ev.permutation(np.arange(200), 200, 9 * 1_000_003 + r)
        for x in rows:
            if x.repeat == r:
                assert (x.a, x.b) == ((float(goes[x.i]), str(x.i % 7)) if x.feature == "a" else (float(x.i), str(goes[x.i] % 7)))
    data = ex.fold_inputs(toy(spark), "y", "i", ["x", "noise"], ["c"], "DecisionTree")
    fitted = ex.fit(data, "DecisionTree", {"max_depth": 3}, "balanced")
    got = {r.feature: (r.importance, r.std) for r in ex.permutation_importance(data, fitted, "i", repeats=3, seed=4).collect()}
    plain = data.rows.orderBy("i").toPandas()

    def auc(frame):
        scored = fitted.score(spark.createDataFrame(frame, data.rows.schema)).toPandas()
        return brute_metrics(list(zip(scored["__label"].astype(int), scored["score"])))[1]

    base = auc(plain)
    drops = []
    for r in range(3):
        copy = plain.copy()
        goes = ev.permutation(np.arange(len(plain)), len(plain), 4 * 1_000_003 + r)
        copy["noise"] = plain["noise"].to_numpy()[goes]
        drops.append(base - auc(copy))
    assert got["noise"] == pytest.approx((np.mean(drops), np.std(drops)), abs=1e-9)


def test_weights_and_names():
    with pytest.raises(ValueError, match="options"):
        md.grid_points("Perceptron")
    assert len(md.grid_points("RandomForest")) == 48 and len(md.grid_points("LogisticRegression")) == 6
    assert md.weight_column(30, 10, "pos_weight")[1] == 60 and md.weight_column(30, 10, "balanced")[1] == 40
    assert md.build_classifier("RandomForest", {"max_depth": None, "min_samples_split": 10}, 1).getMaxDepth() == 30
    assert math.isclose(md.build_classifier("LogisticRegression", {"C": 0.1}, 40).getRegParam(), 0.25)


def test_whole_experiment(spark):
    from ledgerline.sources.spec import Experiment

    rnd = random.Random(9)
    rows = [(i, rnd.choice(["Masculino", "Femenino"]), rnd.choice(["SI", "NO", "NO SE INDICA"]), float(rnd.randrange(12)) * 5 + 2.5) for i in range(90)]
    rows = [(*r, rnd.choice(["x", "y"]), int(r[3] > 30 and rnd.random() < 0.8)) for r in rows]
    df = spark.createDataFrame(rows, "i long, Sexo string, IAE_PREVIO_CORREGIDO string, GRUPO_EDAD_ double, METODO_IAE_PREVIO_ string, CAT_SUI_ int")
    spec = Experiment(1, "-", ["GRUPO_EDAD_", "Sexo", "IAE_PREVIO_CORREGIDO"], ["METODO_IAE_PREVIO_"], "CAT_SUI_")
    out = ex.run(df, spec, "i", "RandomForest", grid={"n_estimators": [5], "max_depth": [2, 3]}, repeats=2)
    assert out["params"]["n_estimators"] == 5 and out["ranking"].count() == 2
    assert out["metrics"].first().roc_auc > 0.6 and out["scores"].count() == 90
    assert {r.feature for r in out["permutation"].collect()} == {"GRUPO_EDAD_", "Sexo", "IAE_PREVIO_SI", "IAE_PREVIO_NO", "METODO_IAE_PREVIO_"}
    assert out["check"].first().consistent and out["distributions"]["GRUPO_EDAD_"].count() > 2
    c = out["confusion"].first()
    assert c.tp + c.fp + c.fn + c.tn == 90
