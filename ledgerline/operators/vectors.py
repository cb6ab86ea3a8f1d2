"""Text vectors and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Question vectors sent to every task are limited to this size; more are dealt into blocks of it.
QUERY_BYTES = 64 * 1024 * 1024
SCORE_DIGITS = 9


def fit_text_vectors(texts: DataFrame, text: str, dims: int = 1024) -> PipelineModel:
    """Hashed term weights with inverse document frequency, scaled to length one."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="__tokens", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=dims),
        IDF(inputCol="__tf", outputCol="__tfidf"),
        Normalizer(inputCol="__tfidf", outputCol="__unit"),
    ]
    return Pipeline(stages=stages).fit(texts)


def text_vectors(model: PipelineModel, texts: DataFrame, out: str = "embedding") -> DataFrame:
    rows = model.transform(texts)
    return rows.withColumn(out, vector_to_array("__unit", "float32")).drop("__tokens", "__tf", "__tfidf", "__unit")


def fit_projection(vectors: DataFrame, vector: str = "embedding", dims: int = 64, extra: int = 16, passes: int = 2, seed: int = 7) -> np.ndarray:
    """Directions (width x ``dims``, orthonormal) that keep most of the vectors, by a randomised singular value decomposition.

    Random directions are pulled through the vectors ``passes`` times, which turns them
    towards the largest singular ones; a last small decomposition orders them. A pass reads
    the vectors once: each task adds up a matrix of width x (dims + extra), and the matrices
    are added by rows, 64 tasks at a time at most. Only such matrices reach the driver. The
    directions are fewer than ``dims`` where the vectors are.
    """
    first = vectors.select(F.size(vector).alias("n")).filter("n > 0").first()
    if first is None:
        return np.zeros((0, dims))
    width = first.n
    span = min(width, dims + extra)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, span)))[0]
    for _ in range(passes):
        basis, _ = np.linalg.qr(_through(vectors, vector, basis))
    # the vectors' part in the span, in its coordinates: eigenvectors of its small Gram matrix
    gram = basis.T @ _through(vectors, vector, basis)
    values, turns = np.linalg.eigh((gram + gram.T) / 2)
    best = np.argsort(-values, kind="stable")[:min(dims, span)]
    found = basis @ turns[:, best]
    largest = np.abs(found).argmax(axis=0)
    return found * np.where(found[largest, np.arange(found.shape[1])] < 0, -1.0, 1.0)  # one of both signs


def _through(vectors: DataFrame, vector: str, basis: np.ndarray) -> np.ndarray:
    """Transposed vectors times vectors times ``basis``, summed over all rows."""
    shared = vectors.sparkSession.sparkContext.broadcast(basis)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shared.value.shape)
        for pdf in batches:
            rows = [v for v in pdf[vector] if v is not None and len(v)]
            if rows:
                m = np.stack(rows).astype("float64")
                total += m.T @ (m @ shared.value)
        task = TaskContext.get().partitionId()
        yield pd.DataFrame({"line": np.arange(len(total)), "task": task, "sums": list(total)})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"line": [pdf["line"].iloc[0]], "task": [pdf["task"].iloc[0]], "sums": [np.sum(np.stack(pdf["sums"].to_numpy()), axis=0)]})

    ddl = "line long, task long, sums array<double>"
    sums, tasks = vectors.select(vector).mapInPandas(part, ddl), vectors.rdd.getNumPartitions()
    while tasks > 1:  # the matrices of 64 tasks become one
        sums = sums.withColumn("task", F.floor(F.col("task") / 64)).groupBy("line", "task").applyInPandas(added, ddl)
        tasks = -(-tasks // 64)
    return np.stack(sums.orderBy("line").toPandas()["sums"].to_numpy())


def project(vectors: DataFrame, directions: np.ndarray, vector: str = "embedding", out: str = "dense") -> DataFrame:
    """``vectors`` with their coordinates in the directions; a null or empty vector has none (null)."""
    shared = vectors.sparkSession.sparkContext.broadcast(directions)

    @F.pandas_udf("array<float>")
    def dense(column: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or not len(v) else (np.asarray(v, np.float64) @ shared.value).astype(np.float32) for v in column], dtype=object)

    return vectors.withColumn(out, dense(vector))


def topk_similar(corpus: DataFrame, queries: DataFrame, k: int, corpus_id: str, query_id: str,
                 vector: str = "embedding", max_query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k corpus rows most similar to each query by cosine: (query_id, corpus_id, score, rank).

    Exact; the lower id wins ties. Pairs never leave a task: it scores its corpus rows
    against queries by matrix product and passes on k rows per query. Queries of up to
    ``max_query_bytes`` (one count and one length tell) are sent to all tasks; more are
    dealt into blocks, and each block of queries meets each block of the corpus once.
    """
    queries = queries.select(F.col(query_id).alias("__q"), F.col(vector).alias("__v"))
    facts = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("__v")).alias("dims")).first()
    types = {query_id: queries.schema["__q"].dataType, corpus_id: corpus.schema[corpus_id].dataType}
    ddl = ", ".join(f"`{c}` {t.simpleString()}" for c, t in types.items()) + ", score double"
    if not facts["n"]:
        return corpus.sparkSession.createDataFrame([], ddl).withColumn("rank", F.lit(0))
    row_bytes = facts["dims"] * 4
    rows = corpus.select(F.col(corpus_id), F.col(vector))
    if facts["n"] * row_bytes <= max_query_bytes:
        scored = _against_all(rows, queries, k, corpus_id, query_id, vector, ddl)
    else:
        scored = _in_blocks(rows, queries, facts["n"], row_bytes, k, corpus_id, query_id, vector, ddl, max_query_bytes)
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc(corpus_id))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _against_all(corpus: DataFrame, queries: DataFrame, k: int, corpus_id: str, query_id: str, vector: str, ddl: str) -> DataFrame:
    """Best rows of each task of the corpus; the queries' size has been checked."""
    block = queries.toPandas()
    shared = corpus.sparkSession.sparkContext.broadcast((block["__q"].to_numpy(), _unit(np.stack(block["__v"].to_numpy()).astype("float64"))))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, unit = shared.value
        kept = None
        for pdf in batches:
            if pdf.empty:
                continue
            kept = _keep_best(kept, pdf, ids, unit, k, corpus_id, query_id, vector)
        if kept is not None:
            yield kept

    return corpus.mapInPandas(best, ddl)


def _in_blocks(corpus: DataFrame, queries: DataFrame, n: int, row_bytes: int, k: int, corpus_id: str, query_id: str, vector: str,
               ddl: str, block_bytes: int) -> DataFrame:
    """Best rows of each pair of a query block and a corpus block, both of bounded size."""
    query_blocks = -(-n * row_bytes // block_bytes)
    corpus_blocks = max(1, -(-corpus.count() * row_bytes // block_bytes))

    def dealt(df: DataFrame, key: str, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        marked = df.withColumn(own, F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(own_blocks)))
        return marked.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_blocks - 1).cast("long"))))

    q = dealt(queries, "__q", "__qb", query_blocks, "__cb", corpus_blocks)
    c = dealt(corpus, corpus_id, "__cb", corpus_blocks, "__qb", query_blocks)

    def best(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or rows.empty:
            return pd.DataFrame({query_id: asked["__q"].iloc[:0], corpus_id: rows[corpus_id].iloc[:0], "score": pd.Series(dtype="float64")})
        unit = _unit(np.stack(asked["__v"].to_numpy()).astype("float64"))
        return _keep_best(None, rows, asked["__q"].to_numpy(), unit, k, corpus_id, query_id, vector)

    return q.groupBy("__qb", "__cb").cogroup(c.groupBy("__qb", "__cb")).applyInPandas(best, ddl)


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _keep_best(kept, pdf: pd.DataFrame, query_ids, unit, k: int, corpus_id: str, query_id: str, vector: str):
    """Merge one batch into the best k per query; rows tied with the k-th stay until the sort by id."""
    rows = _unit(np.stack(pdf[vector].to_numpy()).astype("float64"))
    ids = pdf[corpus_id].to_numpy()
    found = [] if kept is None else [kept]
    step = max(1, 4_000_000 // len(rows))
    for start in range(0, len(unit), step):
        scores = np.round(unit[start:start + step] @ rows.T, SCORE_DIGITS)
        if scores.shape[1] > k:
            kth = np.partition(scores, -k, axis=1)[:, -k]
            q, c = np.nonzero(scores >= kth[:, None])
        else:
            q, c = np.indices(scores.shape).reshape(2, -1)
        found.append(pd.DataFrame({query_id: query_ids[start + q], corpus_id: ids[c], "score": scores[q, c]}))
    merged = pd.concat(found, ignore_index=True)
    merged = merged.sort_values([query_id, "score", corpus_id], ascending=[True, False, True], kind="stable")
    return merged.groupby(query_id, sort=False).head(k).reset_index(drop=True)
