"""Language identification by nearest centroid.

Letters' n-grams of one to three code points are hashed into a fixed number of
dimensions, weighted by TF-IDF and normalised. Each language has several centroids,
found by spherical k-means on a bounded sample of its texts; a text gets the language of
the centroid with the largest cosine. A text that lies much farther from its centroid
than training texts of the same length do is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_map, arrow_totals, code_points, texts

UNDETERMINED = "und"
_LETTERS: np.ndarray | None = None
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


@dataclass(frozen=True)
class Centroids:
    """Parameters.

    ``sample`` is about how many texts of a language the centroids are fitted on (drawn by
    a hash of the text); document frequencies and rejection distances come from all
    training texts. ``languages`` bounds the number of languages. A text is rejected when
    its distance is more than ``deviations`` standard deviations above the mean of the
    training texts of its language and length (its language, or all texts, where those are
    fewer than ``least_texts``); a deviation counts as ``least_deviation`` at least.
    """

    dimensions: int = 4096
    clusters: int = 4
    sample: int = 1500
    rounds: int = 8
    languages: int = 512
    deviations: float = 6.0
    least_deviation: float = 0.03
    least_texts: int = 30


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def gram_counts(text: str, dimensions: int) -> tuple[np.ndarray, int]:
    """(counts of hashed n-grams of letters, number of letters); a run of anything else is one gap."""
    points = code_points(text.lower())
    letter = _letters()[points]
    n = int(letter.sum())
    if not n:
        return np.zeros(dimensions, np.int64), 0
    points = np.where(letter, points, 0)
    first = np.concatenate(([True], letter[1:] | letter[:-1]))  # keeps one of each run of gaps
    points = np.concatenate(([0], points[first], [0])).astype(np.uint64)
    with np.errstate(over="ignore"):
        one = points * _ODD[0]
        two = one[:-1] + (points[1:] + np.uint64(1)) * _ODD[1]
        three = two[:-1] + (points[2:] + np.uint64(1)) * _ODD[2]
        hashed = np.concatenate((one, two, three))
        hashed = ((hashed ^ (hashed >> np.uint64(29))) * _ODD[1]) >> np.uint64(40)
    return np.bincount((hashed % np.uint64(dimensions)).astype(np.int64), minlength=dimensions), n


def _vectors(counts: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(np.array(counts, np.float32).reshape(-1, len(idf))) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _cluster(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; the starts are the mean and then, each time, the row farthest from all starts."""
    centres = [x.mean(axis=0)]
    for _ in range(1, min(k, len(x))):
        nearest = np.max(x @ (np.array(centres) / np.linalg.norm(centres, axis=1, keepdims=True)).T, axis=1)
        centres.append(x[int(np.argmin(nearest))])
    c = np.array(centres)
    for _ in range(rounds):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = np.argmax(x @ c.T, axis=1)
        c = np.array([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


class Model:
    """Fitted values: all of a size fixed by the parameters and the number of languages."""

    def __init__(self, p: Centroids, idf: np.ndarray, names: list[str], centroids: np.ndarray):
        self.p, self.idf, self.names, self.centroids = p, idf, names, centroids
        self.cutoffs: dict[tuple, float] = {}

    def cutoff(self, lang: str, letters: int) -> float:
        """The largest distance accepted: by language and length, or language, or all, as there were enough texts."""
        return next((self.cutoffs[k] for k in ((lang, _band(letters)), (lang, None), (None, None)) if k in self.cutoffs), 2.0)

    def nearest(self, counts: list[np.ndarray]) -> np.ndarray:
        """Cosine with the nearest centroid of each language, a column per distinct language name in order."""
        cos = np.clip(_vectors(counts, self.idf) @ self.centroids.T, 0, 1)
        langs = sorted(set(self.names))
        return np.stack([cos[:, [i for i, n in enumerate(self.names) if n == lang]].max(axis=1) for lang in langs], axis=1)


def _band(letters: int) -> int:
    return int(letters).bit_length()


def fit(docs: DataFrame, training: Column, p: Centroids = Centroids()) -> Model | None:
    """Learn from the text and non-null lang of the rows where ``training`` holds; None if there is no such text with a letter."""
    known = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")

    def totals():
        df, n = np.zeros(p.dimensions, np.int64), 0

        def add(batch):
            nonlocal n
            for t in texts(batch):
                counts, letters = gram_counts(t, p.dimensions)
                if letters:
                    df[counts > 0] += 1
                    n += 1

        def take(last):
            return {"dimension": [-1, *range(p.dimensions)], "n": [n, *df.tolist()]} if last and n else None

        return add, take

    found = arrow_totals(known.select("text"), "dimension int, n long", totals).groupBy("dimension").agg(F.sum("n").alias("n")).collect()
    if not found:
        return None
    seen = np.zeros(p.dimensions + 1)
    for r in found:  # a row per dimension
        seen[r.dimension] = r.n
    idf = (np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1).astype(np.float32)
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(p.languages + 1).collect()}
    if len(sizes) > p.languages:
        raise ValueError(f"more than {p.languages} languages")
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(p.sample / n)).otherwise(share)
    drawn = known.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / (1 << 30) < share)

    def cluster(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        counted = [gram_counts(t, p.dimensions) for t in sorted(frame["text"])]
        x = _vectors([c for c, n in counted if n], idf)
        centres = _cluster(x, p.clusters, p.rounds) if len(x) else []
        return pd.DataFrame({"lang": [key[0]] * len(centres), "centre": [c.tolist() for c in centres]}, columns=["lang", "centre"])

    rows = drawn.groupBy("lang").applyInPandas(cluster, "lang string, centre array<double>").collect()
    rows = sorted(rows, key=lambda r: (r.lang, r.centre))
    if not rows:
        return None
    model = Model(p, idf, [r.lang for r in rows], np.array([r.centre for r in rows], np.float32))
    _learn_cutoffs(model, known)
    return model


def _learn_cutoffs(model: Model, known: DataFrame) -> None:
    p, langs = model.p, sorted(set(model.names))

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            counted = [gram_counts(t, p.dimensions) for t in texts(batch)]
            cos = model.nearest([c for c, _ in counted])
            place = {lang: i for i, lang in enumerate(langs)}
            at = [place.get(lang) for lang in batch.column("lang").to_pylist()]
            rows = [i for i, (c, n) in enumerate(counted) if n and at[i] is not None]
            return {"lang": [langs[at[i]] for i in rows], "band": [_band(counted[i][1]) for i in rows],
                    "distance": [1 - float(cos[i, at[i]]) for i in rows]}

        return work

    measured = arrow_map(known, "lang string, band int, distance double", make)
    stats = measured.groupBy("lang", "band").agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("sd"))
    sums: dict[tuple, np.ndarray] = {}
    for r in stats.collect():  # a row per language and power of two of the length
        for key in ((r.lang, r.band), (r.lang, None), (None, None)):
            sums[key] = sums.get(key, np.zeros(3)) + r.n * np.array([1, r["mean"], r.sd ** 2 + r["mean"] ** 2])
    for key, (n, first, second) in sums.items():
        if n >= p.least_texts:
            deviation = max(second / n - (first / n) ** 2, 0.0) ** 0.5
            model.cutoffs[key] = first / n + p.deviations * max(deviation, p.least_deviation)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Every row of ``docs`` with lang_pred, score (cosine, 0 to 1), distance and rejected.

    lang_pred is ``und``, the score 0 and the row rejected where the text is null or has
    no letter, or where there is no model. Only the text decides. Columns of the input
    with these four names are replaced; repeated rows are judged each. Of languages with
    equal cosines the first by name is taken.
    """
    names = sorted(set(model.names)) if model else []

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for start in range(0, len(batch), 1024):
                counted = [gram_counts(t or "", model.p.dimensions) if model else (None, 0) for t in batch.iloc[start:start + 1024]]
                cos = model.nearest([c for c, _ in counted]) if model else None
                for i, (_, letters) in enumerate(counted):
                    if not letters:
                        out.append((UNDETERMINED, 0.0, 1.0, True))
                        continue
                    best = int(np.argmax(cos[i]))
                    score = float(cos[i, best])
                    far = 1 - score > model.cutoff(names[best], letters)
                    out.append((names[best], score, 1 - score, far))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "distance", "rejected"])

    judge = F.pandas_udf(predict, "lang_pred string, score double, distance double, rejected boolean")
    rows = docs.drop("lang_pred", "score", "distance", "rejected")
    return rows.withColumn("__found", judge("text")).select(*[F.col(f"`{c}`") for c in rows.columns], "__found.*")
