"""Document fingerprints by winnowing.

Every run of k code points is hashed by a rolling polynomial; of each window of w
successive hashes the smallest is chosen, the rightmost of equal ones, and its position
is kept. Two texts that share w + k - 1 code points in a row share a fingerprint, and the
kept positions say where.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerline.llm.common import arrow_map, code_points, shuffle_partitions, texts

_BASE = 0x9E3779B97F4A7C15  # odd multiplier of the rolling polynomial
_MIX = 0xD6E8FEB86659FD93  # odd multiplier of the final mixing
_FLUSH_ROWS = 256


@dataclass(frozen=True)
class Winnow:
    """``k`` is a power of two. Shared runs of ``guarantee`` code points are always found."""

    k: int = 16
    window: int = 49

    @property
    def guarantee(self) -> int:
        return self.k + self.window - 1


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Mixed 64-bit hashes of all runs of k code points; a shorter text counts as one run."""
    if not len(points):
        return np.empty(0, np.uint64)
    h, size = points.astype(np.uint64) + np.uint64(1), 1
    with np.errstate(over="ignore"):
        if len(points) < k:
            powers = np.cumprod(np.full(len(points), _BASE, np.uint64))
            h = (h * powers).sum(keepdims=True, dtype=np.uint64)
        else:
            while size < k:  # the hash of a run is that of its halves
                h = h[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
                size *= 2
        h = (h ^ (h >> np.uint64(32))) * np.uint64(_MIX)
        return h ^ (h >> np.uint64(32))


def chosen(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of each window, the rightmost of equal ones, without repeats."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.int64)
    window = min(window, n)
    at, least, size = np.arange(n), hashes, 1
    while size * 2 <= window:
        at, least = _smaller(at, least, size)
        size *= 2
    if size < window:
        at, least = _smaller(at, least, window - size)
    return np.unique(at)


def _smaller(at: np.ndarray, least: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    later = least[shift:] <= least[:-shift]
    return np.where(later, at[shift:], at[:-shift]), np.where(later, least[shift:], least[:-shift])


def fingerprint(text: str, p: Winnow = Winnow()) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) kept of a text; none of an empty text."""
    hashes = gram_hashes(code_points(text), p.k)
    at = chosen(hashes, p.window)
    return hashes[at], at


def as_text(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """Hashes (16 hex digits each), a colon, positions (8 hex digits each)."""
    hashes, at = print_
    return f"{hashes.astype('>u8').tobytes().hex()}:{at.astype('>u4').tobytes().hex()}"


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two fingerprints' distinct hashes; 1 for two empty ones."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return both / every if every else 1.0


def fingerprints(docs: DataFrame, p: Winnow = Winnow()) -> DataFrame:
    """doc_id, hashes and positions (arrays) of every document.

    A null or empty text has empty arrays; a text shorter than k is one run. Equal texts
    have equal fingerprints. Other columns are not read.
    """
    def make():
        def work(batch: pa.RecordBatch) -> dict:
            found = [fingerprint(t, p) for t in texts(batch)]
            return {"doc_id": batch.column("doc_id"), "hashes": [h.view(np.int64) for h, _ in found], "positions": [a for _, a in found]}

        return work

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, hashes array<long>, positions array<long>", make)


_NEIGHBOURS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
               "near_edited double, near_next double")


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many code points from the start of the following one."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def compare_with_next(docs: DataFrame, p: Winnow = Winnow()) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next document's are.

    The next document is the one with the next smaller doc_id (after the smallest, the
    largest). Repeated ids follow each other in order of text; a null id comes after all
    others; a single document is its own next one; a null text is empty.

    Documents go to ranges of ids by one exchange, and the first document of each range
    also to the range before it, so that every task walks through its sorted range and
    holds two texts at a time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    parts = shuffle_partitions(spark)
    cuts = rows.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 20 * parts).alias("q")).first().q or []
    cuts = sorted(set(cuts))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    place = F.size(F.filter(bounds, lambda c: c >= key)) if cuts else F.lit(0)  # range 0 has the largest ids
    heads = [tuple(r) for r in rows.groupBy(place.alias("part")).agg(F.max(key).alias("head")).orderBy("part").collect()]
    local = spark.createDataFrame([(part, head, heads[i - 1][0]) for i, (part, head) in enumerate(heads)], "part int, head long, before int")
    placed = (rows.withColumns({"part": place.cast("int"), "key": key}).join(F.broadcast(local), "part")  # a row per range
              .withColumn("to", F.explode(F.when(F.col("key") == F.col("head"), F.array(
                  F.struct("part", F.lit(0).alias("guest")), F.struct(F.col("before").alias("part"), F.lit(1).alias("guest"))))
                  .otherwise(F.array(F.struct("part", F.lit(0).alias("guest")))))))
    placed = placed.select("to.part", "to.guest", "key", "doc_id", "text")
    walked = placed.repartition(parts, "part").sortWithinPartitions("part", "guest", F.desc("key"), "text")
    arrow = to_arrow_schema(StructType.fromDDL(_NEIGHBOURS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, waiting, part = [], None, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text"))):
                if row[0] != part:
                    part, waiting = row[0], None
                if row[1] and waiting is None:
                    continue  # only the first of the range after this one counts
                mark = fingerprint(row[3], p)
                if waiting is not None:
                    out.append(_compared(*waiting, row[3], mark, p))
                waiting = None if row[1] else (row[2], row[3], mark)
                if len(out) >= _FLUSH_ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return walked.select("part", "guest", "doc_id", "text").mapInArrow(run, _NEIGHBOURS)


def _compared(doc_id, text: str, mark, following: str, next_mark, p: Winnow) -> dict:
    edited = edited_text(text, following)
    other = fingerprint(edited, p)
    return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
            "fingerprint": as_text(mark), "edited_fingerprint": as_text(other),
            "near_edited": likeness(mark[0], other[0]), "near_next": likeness(mark[0], next_mark[0])}
