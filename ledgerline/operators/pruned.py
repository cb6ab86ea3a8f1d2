"""Exact nearest neighbours that pass over clusters which cannot hold any.

The corpus is cut into clusters around centres, each with its radius. On the unit sphere a
cluster's vectors are no nearer to a question than its centre is, less the radius. A first
visit to each question's nearest clusters gives the distance of its k-th best so far; only
clusters whose bound is below that are visited after, so nothing that is passed over could
have been among the k.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.vectors import SCORE_DIGITS
from ledgerline.sources.shared import stored

BLOCK_ROWS = 50_000  # vectors of a cluster that a task compares at once
SAMPLE_ROWS = 20_000  # vectors that the centres are fitted on
_SLACK = 1e-6  # bounds give way by this, as distances are rounded


@dataclass
class Clusters:
    """``rows`` (id, unit, cluster, block) are stored; ``table`` has the radius, rows and blocks of each cluster."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    size: np.ndarray
    id: str


def _unit(column: pd.Series) -> np.ndarray:
    m = np.stack(column.to_numpy()).astype("float64")
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _nearest(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(m @ centres.T - (centres ** 2).sum(axis=1) / 2, axis=1)


def fit_clusters(corpus: DataFrame, id: str, vector: str = "embedding", clusters: int = 64, turns: int = 8, seed: int = 1) -> Clusters:
    """Clusters of a corpus. The centres come from up to SAMPLE_ROWS vectors; every vector is in the index.

    Null and empty vectors are left out. A cluster is dealt into blocks of about BLOCK_ROWS
    vectors, so one with a large part of the corpus is no task's alone.
    """
    filled = corpus.filter(F.size(vector) > 0).select(id, vector)
    n = filled.count()
    if not n:
        return Clusters(filled, np.zeros((0, 0)), np.zeros(0), np.zeros(0, np.int64), id)
    share = min(1.0, SAMPLE_ROWS / n)
    picked = filled.filter(F.pmod(F.xxhash64(F.lit(seed), id, F.col(vector).cast("string")), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = picked.orderBy(F.xxhash64(F.lit(seed), id)).limit(SAMPLE_ROWS).toPandas()  # bounded by SAMPLE_ROWS
    m = _unit(sample[vector] if len(sample) else filled.limit(1).toPandas()[vector])
    rng = np.random.default_rng(seed)
    centres = m[rng.choice(len(m), min(clusters, len(m)), replace=False)]
    for _ in range(turns):
        of = _nearest(m, centres)
        centres = np.stack([m[of == c].mean(axis=0) if (of == c).any() else centres[c] for c in range(len(centres))])
    shared = corpus.sparkSession.sparkContext.broadcast(centres)
    kind = corpus.schema[id].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                unit = _unit(pdf[vector])
                of = _nearest(unit, shared.value)
                yield pd.DataFrame({id: pdf[id], "unit": list(unit), "cluster": of, "away": np.linalg.norm(unit - shared.value[of], axis=1)})

    placed = filled.mapInPandas(place, f"`{id}` {kind}, unit array<double>, cluster long, away double")
    placed = stored(placed)
    facts = placed.groupBy("cluster").agg(F.max("away").alias("r"), F.count(F.lit(1)).alias("n")).collect()  # a row a cluster
    radius, size = np.full(len(centres), -1.0), np.zeros(len(centres), np.int64)
    for f in facts:
        radius[f.cluster], size[f.cluster] = f.r, f.n
    return Clusters(placed.drop("away"), centres, radius, size, id)


def pruned_topk(index: Clusters, queries: DataFrame, k: int, query_id: str, vector: str = "embedding", first: int = 2) -> DataFrame:
    """(query_id, id, score, rank) of the k vectors of the index most similar to each query by cosine; the lower id wins ties.

    Exact. ``first`` clusters are visited at once, more where they hold fewer than k vectors.
    """
    kinds = {query_id: queries.schema[query_id].dataType.simpleString(), index.id: index.rows.schema[index.id].dataType.simpleString()}
    ddl = ", ".join(f"`{c}` {kind}" for c, kind in kinds.items()) + ", score double"
    asked = queries.filter(F.size(vector) > 0).select(query_id, vector)
    if not len(index.centres):
        return queries.sparkSession.createDataFrame([], ddl).withColumn("rank", F.lit(0))
    shared = queries.sparkSession.sparkContext.broadcast((index.centres, index.radius, index.size))

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, radius, size = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            unit = _unit(pdf[vector])
            bound = np.maximum(np.linalg.norm(unit[:, None, :] - centres[None, :, :], axis=2) - radius[None, :], 0.0)
            bound[:, size == 0] = np.inf
            order = np.argsort(bound, axis=1, kind="stable")
            for i, own in enumerate(order):
                held = np.cumsum(size[own])
                now = max(first, int(np.searchsorted(held, k)) + 1)
                used = own[size[own] > 0]
                yield pd.DataFrame({query_id: pdf[query_id].iloc[i], "unit": [unit[i]] * len(used), "cluster": used, "bound": bound[i, used],
                                    "turn": (np.arange(len(used)) >= now).astype(np.int64)})

    wanted = stored(asked.mapInPandas(visits, f"`{query_id}` {kinds[query_id]}, unit array<double>, cluster long, bound double, turn long"))
    soon = stored(_best(_scan(index, wanted.filter("turn = 0"), k, query_id, ddl), k, query_id, index.id))
    # a distance d on the unit sphere is a cosine of 1 - d * d / 2
    kth = soon.groupBy(query_id).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    limit = F.when(F.col("n") >= k, F.sqrt(F.greatest(2 - 2 * F.col("least"), F.lit(0.0))) + _SLACK).otherwise(float("inf"))
    later = wanted.filter("turn = 1").join(kth.select(query_id, limit.alias("limit")), query_id).filter(F.col("bound") <= F.col("limit"))
    both = soon.drop("rank").unionByName(_scan(index, later.drop("limit"), k, query_id, ddl))
    return _best(both, k, query_id, index.id)


def _best(scored: DataFrame, k: int, query_id: str, id: str) -> DataFrame:
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc(id))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _scan(index: Clusters, visits: DataFrame, k: int, query_id: str, ddl: str) -> DataFrame:
    """The best k of each block of vectors for each question that visits its cluster."""
    id, blocks = index.id, np.maximum(1, -(-index.size // BLOCK_ROWS)).tolist()
    number = F.element_at(F.array(*map(F.lit, blocks)), (F.col("cluster") + 1).cast("int"))
    rows = index.rows.withColumn("block", F.pmod(F.xxhash64(id), number))
    asked = visits.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (number - 1).cast("long"))))

    def best(questions: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(questions) and len(vectors):
            m, ids = np.stack(vectors["unit"].to_numpy()), vectors[id].to_numpy()
            step = max(1, 4_000_000 // len(m))
            for at in range(0, len(questions), step):
                part = questions.iloc[at:at + step]
                scores = np.round(np.stack(part["unit"].to_numpy()) @ m.T, SCORE_DIGITS)
                for q, s in zip(part[query_id].to_numpy(), scores):
                    use = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
                    out.append(pd.DataFrame({query_id: q, id: ids[use], "score": s[use]}).sort_values(["score", id], ascending=[False, True]).head(k))
        empty = pd.DataFrame({query_id: questions[query_id].iloc[:0], id: vectors[id].iloc[:0], "score": pd.Series(dtype="float64")})
        return pd.concat(out, ignore_index=True) if out else empty

    return asked.groupBy("cluster", "block").cogroup(rows.groupBy("cluster", "block")).applyInPandas(best, ddl)


def share_visited(index: Clusters, queries: DataFrame, hits: DataFrame, query_id: str, vector: str = "embedding") -> float:
    """Share of (query, vector) pairs whose clusters had to be looked at, given the final hits."""
    kth = {r[query_id]: r.least for r in hits.groupBy(query_id).agg(F.min("score").alias("least")).collect()}
    seen = total = 0
    for r in queries.filter(F.size(vector) > 0).select(query_id, vector).toLocalIterator():
        unit = _unit(pd.Series([r[vector]]))[0]
        bound = np.linalg.norm(unit - index.centres, axis=1) - index.radius
        seen += int(index.size[bound <= np.sqrt(max(2 - 2 * kth[r[query_id]], 0)) + _SLACK].sum())
        total += int(index.size.sum())
    return seen / total if total else 0.0
