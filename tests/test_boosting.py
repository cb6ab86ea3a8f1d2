"""Boosting against a plain version that sums rows one by one."""

import math
import random

import numpy as np
import pytest

from ledgerline.operators import boosting as bo


def rows(n=300, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, z, c = rng.gauss(0, 1), rng.gauss(0, 1), rng.choice(["a", "b", None])
        y = int(x + (1.2 if c == "a" else 0) + 0.5 * rng.gauss(0, 1) > 0.4)
        # missing cells of x tell something about the label
        out.append((i, None if rng.random() < (0.5 if y else 0.1) else x, float("nan") if rng.random() < 0.1 else z, float(round(z)), c, y, i % 3))
    return out


SCHEMA = "i long, x double, z double, k double, c string, y int, fold int"


def plain_tree(codes, g, h, p, depth):
    """Nested tuples: a leaf's value, or (feature, cut, missing left, left, right)."""
    def leaf(rows):
        return -p.rate * sum(g[r] for r in rows) / (sum(h[r] for r in rows) + p.l2)

    def part(rows, f, cut, missing_left):
        left = [r for r in rows if (missing_left if codes[r][f] == 0 else codes[r][f] <= cut)]
        return left, [r for r in rows if r not in set(left)]

    def score(rows):
        return sum(g[r] for r in rows) ** 2 / (sum(h[r] for r in rows) + p.l2)

    def grow(rows, depth):
        best = (1e-9, None)
        if depth:
            for missing_left in (True, False):
                for f in range(len(codes[0])):
                    for cut in sorted({codes[r][f] for r in rows} - {0}):
                        left, right = part(rows, f, cut, missing_left)
                        if min(len(left), len(right)) < max(1, p.least_rows) or min(sum(h[r] for r in s) for s in (left, right)) < p.least_hessian:
                            continue
                        gain = (score(left) + score(right) - score(rows)) / 2
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, cut, missing_left, left, right))
        if best[1] is None:
            return leaf(rows)
        f, cut, missing_left, left, right = best[1]
        return f, cut, missing_left, grow(left, depth - 1), grow(right, depth - 1)

    return grow(list(range(len(codes))), depth)


def walk(tree, code):
    while isinstance(tree, tuple):
        f, cut, missing_left, left, right = tree
        tree = left if (missing_left if code[f] == 0 else code[f] <= cut) else right
    return tree


def plain_boosting(codes, y, p, weights):
    w = [weights[v] for v in y]
    pos, neg = sum(a for a, v in zip(w, y) if v), sum(a for a, v in zip(w, y) if not v)
    margin, base, trees = [math.log(pos / neg)] * len(y), math.log(pos / neg), []
    for _ in range(p.rounds):
        q = [1 / (1 + math.exp(-m)) for m in margin]
        tree = plain_tree(codes, [a * (b - v) for a, b, v in zip(w, q, y)], [a * b * (1 - b) for a, b in zip(w, q)], p, p.depth)
        trees.append(tree)
        margin = [m + walk(tree, c) for m, c in zip(margin, codes)]
    return base, trees


@pytest.mark.parametrize("p", [bo.Boosting(4, 3, 0.3), bo.Boosting(3, 2, 0.1, l2=0.0, least_hessian=0.001, least_rows=20)])
def test_models_equal_the_plain_version(spark, p):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    binning = bo.plan_bins(df, ["x", "z", "k"], ["c"], bins=12)
    assert binning.names == ["num__x", "num__z", "num__k", "cat__c_a", "cat__c_b"]
    tasks = [bo.Task(p, None, (1.0, 1.0)), bo.Task(p, 1, (1.0, 2.5))]
    models = bo.fit_boosted(df, binning, "y", tasks, "fold", stored_rounds=2)

    def code(r):
        numbers = [0 if v is None or math.isnan(v) else 1 + sum(e < v for e in edges) for v, edges in zip(r[1:4], binning.edges)]
        return [*numbers, *(1 + (r[4] == v) for _, v in binning.categories)]

    for task, model in zip(tasks, models):
        mine = [r for r in data if r[6] != task.held_out]
        base, trees = plain_boosting([code(r) for r in mine], [r[5] for r in mine], p, task.weights)
        assert model.base == pytest.approx(base)
        for prefix in (0, 1, p.rounds):
            want = {r[0]: 1 / (1 + math.exp(-base - sum(walk(t, code(r)) for t in trees[:prefix]))) for r in data}
            got = {r.i: r.s[0] for r in model.score(df, [prefix], "s").collect()}
            assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)
    assert models[0].importances().sum() == pytest.approx(1)
    assert any(t.missing_left[t.feature >= 0].any() for t in models[0].trees) and any((~t.missing_left[t.feature >= 0]).any() for t in models[0].trees)


def test_prefixes_are_models(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    binning = bo.plan_bins(df, ["x", "z"], ["c"])
    short, long = (bo.fit_boosted(df, binning, "y", [bo.Task(bo.Boosting(n, 2, 0.2))])[0] for n in (3, 6))
    staged = {r.i: r.s for r in long.score(df, [3, 6], "s").collect()}
    assert {r.i: r.score for r in short.score(df).collect()} == pytest.approx({i: s[0] for i, s in staged.items()})
    assert {r.i: r.score for r in long.score(df).collect()} == pytest.approx({i: s[1] for i, s in staged.items()})


def test_models_of_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    binning = bo.plan_bins(empty, ["x"], ["c"])
    model = bo.fit_boosted(empty, binning, "y", [bo.Task(bo.Boosting(2))])[0]
    one = spark.createDataFrame([(1, None, None, None, None, 1, 0), (2, 3.0, None, None, "q", 1, 0)], SCHEMA)
    assert [r.score for r in model.score(one).collect()] == [0.5, 0.5]
    sure = bo.fit_boosted(one, bo.plan_bins(one, ["x", "z"], ["c"]), "y", [bo.Task(bo.Boosting(2))])[0]
    assert all(r.score > 0.99 for r in sure.score(one).collect())
    assert not np.any([t.feature[1] >= 0 for t in sure.trees])


def test_rows_are_dealt_to_all_cores(spark):
    df = spark.range(100_000).selectExpr("id % 7 AS x", "id % 2 AS y")
    state = bo._state(df, bo.plan_bins(df, ["x"]), "y", None, [0.0] * 4, 100_000)
    assert state.rdd.getNumPartitions() == 8 and state.count() == 100_000
