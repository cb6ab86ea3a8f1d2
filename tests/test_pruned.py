"""The pruned search gives what the full one gives, and looks at less."""

import numpy as np
import pytest

from ledgerline.operators import pruned
from ledgerline.operators.vectors import topk_similar


def vectors(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width)) * 3
    return centres[rng.integers(0, 12, n)] + rng.normal(size=(n, width)) * 0.4


@pytest.mark.parametrize("block, k, first", [(50_000, 5, 2), (37, 5, 1), (50_000, 400, 1)])
def test_pruned_search_is_exact(spark, monkeypatch, block, k, first):
    monkeypatch.setattr(pruned, "BLOCK_ROWS", block)
    m = vectors(600, 16, 1)
    m[5] = m[4]  # a tie
    corpus = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)] + [(900, None), (901, []), (902, [0.0] * 16)], "id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(np.vstack([vectors(20, 16, 2), m[4:6], -m[:2]]))] + [(99, None)], "q int, embedding array<double>")
    index = pruned.fit_clusters(corpus, "id", clusters=20)
    hits = pruned.pruned_topk(index, asked, k, "q", first=first)
    got = sorted((r.q, r["rank"], r.id, round(r.score, 8)) for r in hits.collect())
    plain = topk_similar(corpus.filter("size(embedding) > 0"), asked.filter("embedding IS NOT NULL"), k, "id", "q")
    assert got == sorted((r.q, r["rank"], r.id, round(r.score, 8)) for r in plain.collect())
    if k == 5:
        assert pruned.share_visited(index, asked, hits, "q") < 0.5


def test_pruned_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    one = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<double>")
    asked = one.withColumnRenamed("id", "q")
    assert pruned.pruned_topk(pruned.fit_clusters(none, "id"), asked, 3, "q").count() == 0
    assert pruned.pruned_topk(pruned.fit_clusters(one, "id"), asked.filter("q > 1"), 3, "q").count() == 0
    assert pruned.pruned_topk(pruned.fit_clusters(one, "id"), asked, 3, "q").first().score == pytest.approx(1)
