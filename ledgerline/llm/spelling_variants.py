"""Grouping of spelling variants: words one edit apart, the rarer led to the far more frequent.

Two words are a single edit apart when the length of their common prefix plus that of
their common suffix reaches the longer length minus one. The edit lies in one half of the
longer word, so the words agree in all before or all after that half: they are put into
buckets by each half and what lies outside it, and buckets that grow large are cut by
halving the part that may differ, down to one place. Within a bucket words are laid out as
padded matrices of code points, once from the front and once from the back, and tiles of
rows are compared pair by pair. A pair counts only where its edit lies in the bucket's
part, so it is met once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_schema, arrow_totals, sized, texts
from ledgerline.sources.shared import stored

_RUN = re.compile("[a-zÀ-ÿ]+")
_GAP = re.compile("[^a-zÀ-ÿ]")
_BLOCK = 1 << 20  # code points of a text whose runs are held at once
_HELD = 200_000  # words a task holds before it passes them on
_TILE_CELLS = 1 << 16  # code points of a pair of tiles, about
_PAIRS = 1 << 16  # pairs of words compared at once


@dataclass(frozen=True)
class Variants:
    """Parameters.

    Runs of letters whose hash ``every`` divides lose one letter. Words have ``least_length``
    letters and ``least_count`` occurrences or more; a form has ``ratio`` times the
    occurrences. Buckets of more than ``bucket_rows`` words are cut, tiles have ``tile``
    words at most. Tables of up to ``broadcast_rows`` rows are sent to all tasks.
    """

    every: int = 31
    least_length: int = 7
    least_count: int = 2
    ratio: int = 10
    bucket_rows: int = 2048
    tile: int = 64
    broadcast_rows: int = 500_000


def runs(text: str) -> Iterator[list[str]]:
    """The runs of letters of a text, A-Z lower-cased, in blocks of bounded size."""
    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: A-Z only
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + _BLOCK) if start + _BLOCK < len(text) else None
        end = gap.start() if gap else len(text)
        yield _RUN.findall(text[start:end] if start or end < len(text) else text)
        start = end


def word_counts(docs: DataFrame, p: Variants) -> DataFrame:
    """word and n of the words of all texts."""
    def make():
        held: Counter = Counter()

        def add(batch: pa.RecordBatch) -> None:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                seed, own = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
                for found in runs(text):
                    own.update(found)
                for word, n in own.items():
                    if len(word) < p.least_length:
                        continue
                    h = zlib.crc32(word.encode(), seed)
                    if h % p.every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    if len(word) >= p.least_length:
                        held[word] += n

        def take(last: bool) -> dict | None:
            if not last and len(held) < _HELD:
                return None
            out = {"word": list(held), "n": list(held.values())}
            held.clear()
            return out

        return add, take

    counted = arrow_totals(docs.select(F.col("doc_id").cast("long"), "text"), "word string, n long", make)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= p.least_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` (word, n, longer, depth, part) with the bounds of the part of the longer word that may differ, and the bucket."""
    whole = F.expr("shiftleft(1L, depth)")
    bounds = rows.withColumns({"lo": F.floor(F.col("part") * F.col("longer") / whole), "hi": F.floor((F.col("part") + 1) * F.col("longer") / whole)})
    front, back = F.expr("left(word, CAST(lo AS INT))"), F.expr("right(word, CAST(longer - hi AS INT))")
    return bounds.filter("lo < hi").withColumn("bucket", F.xxhash64("longer", "lo", "hi", front, back))


def _halved(rows: DataFrame) -> DataFrame:
    """The two halves of each part."""
    return rows.select("word", "n", "longer", (F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("part") * 2, F.col("part") * 2 + 1)).alias("part"))


def _buckets(words: DataFrame, p: Variants) -> DataFrame:
    """bucket, longer, lo, hi, word, n: rows of buckets of bounded size in which all near words meet."""
    size = F.char_length("word").cast("long")
    start = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("longer"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("part"))
    rows, out = _keyed(_halved(start)), None
    while True:
        large = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.max(F.col("hi") - F.col("lo")).alias("room"))
        large = stored(large.filter((F.col("members") > p.bucket_rows) & (F.col("room") > 1)).select("bucket"))
        none = large.limit(1).count() == 0
        here = rows if none else rows.join(sized(large, p.broadcast_rows), "bucket", "left_anti")
        out = here if out is None else out.unionByName(here)
        if none:
            return out.select("bucket", "longer", "lo", "hi", "word", "n")
        rows = stored(_keyed(_halved(rows.join(sized(large, p.broadcast_rows), "bucket", "left_semi"))))


def _matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, code points padded at the end, code points from the back padded at the end)."""
    data = [w.encode("latin-1") for w in words]  # the alphabet ends at U+00FF
    size = np.array([len(d) for d in data])
    width = int(size.max(initial=1))
    front = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in data), np.uint8).reshape(-1, width)
    back = np.frombuffer(b"".join(d[::-1].ljust(width, b"\0") for d in data), np.uint8).reshape(-1, width)
    return size, front, back


def _tiles(bucket: np.ndarray, longer: np.ndarray, tile: int) -> Iterator[tuple[slice, slice]]:
    """Pairs of tiles of rows that may have a pair of one bucket; rows of a bucket lie together, those of long words too."""
    n, at, cuts = len(bucket), 0, []
    while at < n:
        rows = max(1, min(tile, int((_TILE_CELLS / max(int(longer[min(at + tile, n) - 1]), int(longer[at]))) ** 0.5)))
        cuts.append(slice(at, min(at + rows, n)))
        at += rows
    for i, a in enumerate(cuts):
        yield a, a
        for b in cuts[i + 1:]:
            if bucket[b.start] != bucket[a.stop - 1]:
                break
            yield a, b


def near_pairs(bucket: np.ndarray, longer: np.ndarray, lo: np.ndarray, hi: np.ndarray, words: list[str], tile: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the near words of each bucket, i < j; rows of a bucket lie together."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        used, places = np.unique(np.concatenate((i, j)), return_inverse=True)
        size, front, back = _matrices([words[x] for x in used.tolist()])
        a, b = places[:len(i)], places[len(i):]
        step = max(1, _TILE_CELLS * 16 // front.shape[1])
        for at in range(0, len(i), step):
            x, y = a[at:at + step], b[at:at + step]
            prefix = np.argmax(front[x] != front[y], axis=1)
            suffix = np.argmax(back[x] != back[y], axis=1)
            most = np.maximum(size[x], size[y])
            edit = np.minimum(prefix, most - 1)
            of = i[at:at + step]
            near = (prefix + suffix >= most - 1) & (most == longer[of]) & (np.abs(size[x] - size[y]) <= 1) & (lo[of] <= edit) & (edit < hi[of])
            left.append(of[near])
            right.append(j[at:at + step][near])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0
    for a, b in _tiles(bucket, longer, tile):
        i, j = np.nonzero(bucket[a][:, None] == bucket[b][None, :])
        i, j = i + a.start, j + b.start
        keep = i < j
        held.append((i[keep], j[keep]))
        count += int(keep.sum())
        if count >= _PAIRS:
            compare(*(np.concatenate(x) for x in zip(*held)))
            held, count = [], 0
    if count:
        compare(*(np.concatenate(x) for x in zip(*held)))
    return np.concatenate(left), np.concatenate(right)


def _nearest(words: list[str], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> dict:
    """For each word with a near one: how many it has here, and the most frequent (ties: smallest)."""
    mine, other = np.concatenate((i, j)), np.concatenate((j, i))
    ends = np.unique(mine)
    place = np.empty(len(words), np.int64)
    place[sorted(ends.tolist(), key=words.__getitem__)] = np.arange(len(ends))  # every end is one of a pair
    order = np.lexsort((place[other], -n[other], mine))
    mine, other = mine[order], other[order]
    first = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1]))) if len(mine) else np.empty(0, np.int64)
    best = other[first]
    return {"word": [words[x] for x in mine[first].tolist()], "n_near": np.diff(np.append(first, len(mine))),
            "best": [words[x] for x in best.tolist()], "best_n": n[best]}


def neighbours(words: DataFrame, p: Variants) -> DataFrame:
    """word, n_near, best, best_n of every word (of ``words``: word, n) that has a near word."""
    names, schema = ("bucket", "longer", "lo", "hi", "n"), "word string, n_near long, best string, best_n long"
    arrow = arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_words = np.empty((len(names), 0), np.int64), []  # rows of the bucket that may go on in the next batch

        def found(rows: np.ndarray, of: list[str]) -> pa.RecordBatch:
            bucket, longer, lo, hi, n = rows
            return pa.RecordBatch.from_pydict(_nearest(of, n, *near_pairs(bucket, longer, lo, hi, of, p.tile)), schema=arrow)

        for batch in batches:
            held = np.concatenate((held, np.stack([batch.column(c).to_numpy() for c in names])), axis=1)
            held_words += batch.column("word").to_pylist()
            last = np.flatnonzero(held[0] != held[0, -1]) if held.shape[1] else []
            if len(last):
                cut = last[-1] + 1
                yield found(held[:, :cut], held_words[:cut])
                held, held_words = held[:, cut:], held_words[cut:]
        if held.shape[1]:
            yield found(held, held_words)

    dealt = _buckets(words, p).repartition("bucket").sortWithinPartitions("longer", "bucket")
    found = dealt.mapInArrow(work, schema)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("s")
    sums = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return sums.select("word", "n_near", F.col("s.best").alias("best"), (-F.col("s.less")).alias("best_n"))


def roots(forms: DataFrame, p: Variants) -> DataFrame:
    """word and root of ``forms`` (word, form): each step doubles how far the forms are followed."""
    at = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        beyond = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stored(at.join(sized(beyond, p.broadcast_rows), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = new.drop("moved")
        if new.filter("moved").limit(1).count() == 0:
            return at


def variants(docs: DataFrame, p: Variants = Variants()) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the texts.

    A word's form is its most frequent near word (ties: the smallest in code-point order) if
    it has ``ratio`` times the word's occurrences, else null; its root is where the forms
    end, or the word itself. n_near is 0 for words without near ones. A null text is empty,
    a null doc_id counts as empty text in the hash, repeated rows count each, and an empty
    table gives no rows. Only doc_id and text are read.
    """
    words = stored(word_counts(docs, p))
    joined = stored(words.join(neighbours(words, p), "word", "left"))
    leads = F.col("best_n") >= p.ratio * F.col("n")
    formed = joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(leads, F.col("best")).alias("form"),
                           F.when(leads, F.col("best_n")).alias("form_n"))
    ends = roots(formed.filter("form IS NOT NULL"), p)
    return formed.join(sized(ends, p.broadcast_rows), "word", "left").withColumn("root", F.coalesce("root", "word"))


def normalised(docs: DataFrame, p: Variants = Variants()) -> DataFrame:
    """variant and root of the words that have a form: what a text's words may be replaced with."""
    return variants(docs, p).filter("form IS NOT NULL").select(F.col("word").alias("variant"), "root")
