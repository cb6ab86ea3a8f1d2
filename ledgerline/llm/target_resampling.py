"""Importance resampling of documents towards the n-gram distribution of a target collection.

A table of 256 bytes lower-cases UTF-8 text and blanks its separators, so that splitting
at spaces gives the words. The crc32 of a run of words seeds that of the run one word
longer; runs of one to three words are counted in hashed buckets, Counters within a task
and sums over tasks. A bucket that is likelier in the target than in the documents has a
gain, a document's weight is the sum of the gains of its runs, and the weight with Gumbel
noise from the document's id ranks the documents, so that the highest are a sample.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_map, arrow_totals, texts
from ledgerline.sources.shared import stored

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BLOCK = 1 << 20  # bytes of a text whose words are held at once


@dataclass(frozen=True)
class Resampling:
    """Parameters.

    Runs of up to ``longest`` words fall into ``buckets`` buckets; the table of buckets is
    held by the driver and every task. Of the documents with ``least_words`` words or more,
    ``percent`` of a hundred are drawn; ``seed`` goes into the noise. About ``slice_rows``
    documents are ranked together.
    """

    buckets: int = 10_000
    longest: int = 3
    least_words: int = 20
    percent: int = 5
    seed: int = 42
    slice_rows: int = 1_000_000


def word_blocks(text: str) -> Iterator[list[bytes]]:
    """The words of a text, in blocks of bounded size."""
    data = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + _BLOCK) if start + _BLOCK < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def feature_blocks(text: str, longest: int) -> Iterator[tuple[int, list[int]]]:
    """(number of words, crc32 of every run of up to ``longest`` words that ends in the block) of each block of the text."""
    tail: list[bytes] = []
    for new in word_blocks(text):
        words, held = tail + new, len(tail)
        spaced = [b" " + w for w in words]
        crcs = list(map(zlib.crc32, words))
        found = crcs[held:]
        for more in range(1, longest):
            crcs = list(map(zlib.crc32, spaced[more:], crcs))  # crcs[i] is that of the words i to i + more
            found += crcs[max(held - more, 0):]
        yield len(new), found
        tail = words[-(longest - 1):] if longest > 1 else []


def bucket_counts(docs: DataFrame, p: Resampling) -> DataFrame:
    """bucket and n of every bucket that a run of the texts falls into."""
    def make():
        total: Counter = Counter()

        def add(batch: pa.RecordBatch) -> None:
            for text in texts(batch):
                for _, crcs in feature_blocks(text, p.longest):
                    total.update((np.array(crcs, np.int64) % p.buckets).tolist())

        def take(last: bool) -> dict | None:
            return {"bucket": list(total), "n": list(total.values())} if last else None

        return add, take

    return arrow_totals(docs.select("text"), "bucket int, n long", make).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, p: Resampling) -> np.ndarray:
    """The gain of each bucket, in thousandths of a natural log, rounded down."""
    def counts(df: DataFrame) -> list[int]:
        have = {r.bucket: r.n for r in bucket_counts(df, p).collect()}  # one row a bucket at most
        return [have.get(i, 0) for i in range(p.buckets)]

    raw, wanted = counts(docs), counts(target)
    all_raw, all_wanted = float(sum(raw) + p.buckets), float(sum(wanted) + p.buckets)
    return np.array([math.floor(1000 * math.log((t + 1) * all_raw / ((s + 1) * all_wanted))) for s, t in zip(raw, wanted)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, rounded down, from a hash of the id; a null id counts as empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, p: Resampling) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document."""
    def make():
        def work(batch: pa.RecordBatch) -> dict:
            ids = batch.column("doc_id").to_pylist()
            out = {"doc_id": ids, "n_words": [], "n_features": [], "weight": []}
            for text in texts(batch):
                words = features = weight = 0
                for n, crcs in feature_blocks(text, p.longest):
                    words, features = words + n, features + len(crcs)
                    weight += int(gain[np.array(crcs, np.int64) % p.buckets].sum())
                for k, v in (("n_words", words), ("n_features", features), ("weight", weight)):
                    out[k].append(v)
            out["score"] = [w + noise(i, p.seed) for i, w in zip(ids, out["weight"])]
            return out

        return work

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, n_words long, n_features long, weight long, score long", make)


def ranked(rows: DataFrame, p: Resampling) -> DataFrame:
    """``rows`` (stored) with rank: 1, 2, 3 ... of the drawn, by falling score and then by doc_id, null for the others.

    Scores are cut into slices at approximate quantiles, the slices are counted exactly, and
    rows are numbered within the slices that reach the drawn share; the others never move.
    """
    enough = F.col("n_words") >= p.least_words
    n = rows.filter(enough).count()
    drawn = p.percent * n // 100
    if not drawn:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    slices = min(max(1, -(-drawn // p.slice_rows)), 1000)
    places = [1 - drawn / n * (i + 1) / slices for i in range(slices)]
    bounds = rows.filter(enough).agg(F.percentile_approx("score", places, 10_000).alias("b")).first().b
    bounds = sorted(set(bounds), reverse=True)
    number = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        number = F.when(F.col("score") >= bounds[i], i).otherwise(number) if len(bounds) <= 16 else number
    if len(bounds) > 16:
        number = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b > F.col("score")))
    cut = rows.withColumn("__slice", F.when(enough, number))
    sizes = {r["__slice"]: r.n for r in cut.filter(enough).groupBy("__slice").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a slice
    before, ahead = {}, 0
    for i in sorted(sizes):
        if ahead < drawn:
            before[i] = ahead
        ahead += sizes[i]
    first = F.element_at(F.create_map(*(F.lit(x).cast("long") for i in before for x in (i, before[i]))), F.col("__slice").cast("long"))
    near = F.coalesce(F.col("__slice") <= max(before), F.lit(False))
    place = first + F.row_number().over(Window.partitionBy("__slice").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    inside = cut.filter(near).withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return inside.unionByName(cut.filter(~near).withColumn("rank", F.lit(None).cast("long"))).drop("__slice")


def resampled(docs: DataFrame, target: DataFrame, p: Resampling = Resampling()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; rank is null for those not drawn.

    The counts are over all texts of ``docs`` and ``target``. A null text is empty and has
    neither words nor features nor weight. Null ids share their noise and come last among
    equal scores; repeated rows are documents of their own, and equal ones are ranked in any
    order. An empty table gives no rows, an empty target makes common runs lose. Of ``docs``
    only doc_id and text are read, of ``target`` only text.
    """
    return ranked(stored(scored(docs, gains(docs, target, p), p)), p)


def sample(docs: DataFrame, target: DataFrame, p: Resampling = Resampling()) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns; ids must tell documents apart."""
    drawn = resampled(docs, target, p).filter("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(drawn, docs["doc_id"].cast("long").eqNullSafe(F.col("__drawn")), "left_semi")
