"""Near-duplicate detection by order MinHash.

The k-mers of a text are its runs of three words, labelled with how often they occurred
before. Each of several hash functions picks the few smallest labelled k-mers, and they
are kept in the order they have in the text: texts agree in such a sketch when they share
the k-mers and their order, as texts of small edit distance do. Texts that agree in a
sketch and are of like length are candidates; a banded alignment of their words decides.
Short texts, where each edit spoils a good part of the k-mers, also have sketches of single
pairs of words, and the shortest, where one edit is allowed, agree without each one word.

Exact copies are folded first. The members of the buckets of a few sketches are compared
with one hub each, which finds most classes. In a bucket that still holds several classes
every member is compared with every member of the other classes, however many there are:
counts of hashed words, of which an edit changes two, tell most pairs apart, and the rest
are aligned. Large buckets are cut into blocks, and pairs of blocks are dealt to the tasks.
Buckets of many classes come from k-mers that many unlike texts share, such as a passage,
so these texts are sketched again without the k-mers in more than a few classes, which
finds links that the first sketches do not.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections import OrderedDict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_map, code_points, texts
from ledgerline.sources.shared import stored

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BLOCK = 4096  # k-mers hashed at once
_powers: dict[int, np.ndarray] = {}


@dataclass(frozen=True)
class OrderMinHash:
    """Parameters.

    Texts are linked when 1 - (edits of words) / (words of the longer) is ``similarity``
    or more. ``sketches`` sketches of ``picks`` k-mers of ``k`` words: texts that share a
    part s of their k-mers agree in one with probability s ** picks. With a fifth of the
    words replaced s is 0.34, so one of 40 agrees with probability 0.99. Texts of up to
    ``short`` words also have ``short_sketches`` of one pair of words. The buckets of the
    first ``early`` sketches are looked at before all others. Texts in buckets of more than
    ``few`` classes have second sketches too, of one k-mer of those in no more than ``few``
    classes. Buckets of more than ``block`` texts are compared in blocks of about as many.
    Sets of up to ``broadcast_rows`` ids are sent to all tasks, larger ones are joined.
    """

    k: int = 3
    picks: int = 2
    sketches: int = 40
    short: int = 40
    short_sketches: int = 24
    similarity: float = 0.8
    early: int = 6
    few: int = 16
    block: int = 256
    broadcast_rows: int = 500_000


def _power_table(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2 ... modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = _powers[base] = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1 << 14), base, np.uint64))))
    return have[:n]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of the lower-cased text, words being separated by ASCII white space."""
    points = code_points(text.lower())
    gap = (points == 32) | ((points >= 9) & (points <= 13))
    edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        n = len(points) + 1
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, n)[:-1])))
        h = (sums[end] - sums[start]) * _power_table(_BASE_INVERSE, n)[start]
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return h ^ (h >> np.uint64(29))


def labelled_kmers(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each k-mer in text order, hash of the k-mer with the number of its earlier occurrences)."""
    k = min(k, len(words))
    with np.errstate(over="ignore"):
        kmers = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            kmers = kmers * np.uint64(_BASE) + words[j:len(words) - k + 1 + j]
        order = np.argsort(kmers, kind="stable")
        ranked = kmers[order]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        at = np.arange(len(ranked))
        occurrence = np.empty(len(ranked), np.uint64)
        occurrence[order] = at - np.maximum.accumulate(np.where(new, at, 0))
        return kmers, kmers + occurrence * np.uint64(_BASE_INVERSE)


def sketch(text: str, p: OrderMinHash) -> tuple[int, list[int]]:
    """(number of words, the key of each sketch, then those that only short texts have); no keys for a text without words."""
    words = word_hashes(text)
    if not len(words):
        return 0, []
    keys = [_keys(words, p.k, p.picks, p.sketches, 0)]
    if len(words) <= p.short:
        keys.append(_keys(words, 2, 1, p.short_sketches, p.sketches))
        if int((1 - p.similarity) * len(words) + 1e-9) <= 1:
            keys.append(_without_one(words))
    return len(words), np.concatenate(keys).view(np.int64).tolist()


def sketch_without(text: str, p: OrderMinHash, common: np.ndarray) -> list[int]:
    """The keys of second sketches, from the k-mers (and pairs of words) that are not in ``common``."""
    words = word_hashes(text)
    if not len(words):
        return []
    first = p.sketches + p.short_sketches  # other numbers than the first sketches have
    keys = [_keys(words, p.k, 1, p.sketches, first, common)]  # what is rare needs no second k-mer, and may be a small part of the text
    if len(words) <= p.short:
        keys.append(_keys(words, 2, 1, p.short_sketches, first + p.sketches, common))
    return np.concatenate(keys).view(np.int64).tolist()


def units(text: str, p: OrderMinHash) -> np.ndarray:
    """The different k-mers of a text, and its pairs of words if it is short, as hashes."""
    words = word_hashes(text)
    if not len(words):
        return np.empty(0, np.int64)
    found = [labelled_kmers(words, k)[0] for k in ((p.k, 2) if len(words) <= p.short else (p.k,))]
    return np.unique(np.concatenate(found)).view(np.int64)


def _keys(words: np.ndarray, k: int, picks: int, sketches: int, first: int, common: np.ndarray | None = None) -> np.ndarray:
    """The keys of sketches, which are numbered from ``first``; k-mers in ``common`` are not picked."""
    kmers, labelled = labelled_kmers(words, k)
    if common is not None and len(common):
        rare = ~np.isin(kmers, common)
        kmers, labelled = kmers[rare], labelled[rare]
        if not len(kmers):
            return np.empty(0, np.uint64)
    picks = min(picks, len(kmers))
    with np.errstate(over="ignore"):
        mixed = labelled ^ (labelled >> np.uint64(31))
        factors = _factors(sketches)
        held = [_least(mixed[at:at + _BLOCK], factors, picks) for at in range(0, len(mixed), _BLOCK)]
        hashes = np.concatenate([h for h, _ in held], axis=1)
        places = np.concatenate([i + _BLOCK * at for at, (_, i) in enumerate(held)], axis=1)
        least = np.sort(np.take_along_axis(places, np.argsort(hashes, axis=1, kind="stable")[:, :picks], axis=1), axis=1)
        keys = np.arange(first, first + sketches, dtype=np.uint64)
        for x in kmers[least].T:
            keys = (keys ^ (keys >> np.uint64(32))) * _MIX + x
        return keys


def _without_one(words: np.ndarray) -> np.ndarray:
    """Keys of the text and of what is left of it without each one word: texts one edit apart share one."""
    left = [words.tolist()] + [np.delete(words, i).tolist() for i in range(len(words))]
    return np.array(list({sum((x + 1) * pow(_BASE, i, 1 << 64) for i, x in enumerate(ws)) % (1 << 64) for ws in left if ws}), np.uint64)


@lru_cache(4)
def _factors(sketches: int) -> np.ndarray:
    return np.array([pow(_BASE, 2 * s + 3, 1 << 64) for s in range(sketches)], np.uint64)[:, None]


def _least(mixed: np.ndarray, factors: np.ndarray, picks: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the smallest ``picks`` of a block for each hash function."""
    h = mixed[None, :] * factors
    h ^= h >> np.uint64(32)
    h *= _MIX
    rows, hashes, places = np.arange(len(h)), [], []
    for _ in range(min(picks, h.shape[1])):
        at = np.argmin(h, axis=1)
        hashes.append(h[rows, at])
        places.append(at)
        h[rows, at] = np.uint64(0xFFFFFFFFFFFFFFFF)
    return np.stack(hashes, axis=1), np.stack(places, axis=1)


def banded_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Edit distance of two sequences if it is ``limit`` or less.

    Only cells within ``limit`` of the main diagonal are looked at. A column of the band is
    kept as the bits of its steps up and down, so that one column takes a few operations on
    whole numbers of as many bits as the band is wide (Hyyroe's banded form of Myers'
    bit vectors).
    """
    if len(a) < len(b):
        a, b = b, a
    same = len(b)
    differ = np.flatnonzero(a[:same] != b)
    head = int(differ[0]) if len(differ) else same
    a, b = a[head:], b[head:]
    same = len(b)
    differ = np.flatnonzero(a[len(a) - same:][::-1] != b[::-1])
    tail = int(differ[0]) if len(differ) else same
    a, b = a[:len(a) - tail].tolist(), b[:len(b) - tail].tolist()
    if len(a) - len(b) > limit:
        return None
    if not b:
        return len(a)
    limit = min(limit, len(a))
    width = 2 * limit + 2
    every, top, row = (1 << width) - 1, 1 << (width - 1), 1 << (width - 2)
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    up, down = every ^ ((1 << (width - limit - 1)) - 1), 0
    distance, start, turn = limit, limit + 1 - width, len(a) - limit
    for j, x in enumerate(b):
        bits = where.get(x, 0)
        bits = (bits >> start if start >= 0 else bits << -start) & every
        level = ((((bits & up) + up) ^ up) | bits | down) & every
        right, left = down | (every ^ (level | up)), level & up
        if j < turn:
            distance += not level & top
        else:
            distance += bool(right & row) - bool(left & row)
            row >>= 1
        level >>= 1
        up, down = left | (every ^ (level | right)), level & right
        start += 1
    return distance if distance <= limit else None


_recent: OrderedDict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = OrderedDict()  # pairs that share a text come near one another
_RECENT_WORDS = 1 << 20  # words of the texts remembered, so that a run of very long ones stays small
_held = 0  # words of those in _recent


def _words_and_pairs(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, sorted labelled pairs of neighbouring words, their places in the text)."""
    global _held
    found = _recent.pop(text, None)
    if found is None:
        words = word_hashes(text)
        pairs = labelled_kmers(words, 2)[1] if len(words) > 1 else words
        order = np.argsort(pairs)
        found = (words, pairs[order], order)
        _held += len(words)
    _recent[text] = found
    while len(_recent) > 1 and (_held > _RECENT_WORDS or len(_recent) > 256):
        _held -= len(_recent.popitem(last=False)[1][0])
    return found


def _rising(j: np.ndarray) -> np.ndarray:
    """The places of a longest rising run of entries, in order."""
    least, ends, before = [], [], []  # by length of a run: its least last entry and that entry's place
    for k, v in enumerate(j.tolist()):
        at = len(least) if not least or v > least[-1] else bisect_left(least, v)
        before.append(ends[at - 1] if at else -1)
        least[at:at + 1], ends[at:at + 1] = [v], [k]
    found, k = [], ends[-1] if ends else -1
    while k >= 0:
        found.append(k)
        k = before[k]
    return np.array(found[::-1], np.int64)


def _edits_by_pairs(sizes: tuple[int, int], i: np.ndarray, j: np.ndarray, limit: int) -> int:
    """No fewer edits than are needed between texts of so many words whose pairs of words at ``i`` and ``j`` are the same.

    Pairs in the same order in both texts are kept as they are, and what lies between is replaced: first those
    before or behind all others in both, and if that takes more than ``limit`` edits, as many as there can be.
    """
    order = np.argsort(i)
    i, j = i[order], j[order]

    def edits(i: np.ndarray, j: np.ndarray) -> int:
        if not len(i):
            return max(sizes)
        di, dj = np.diff(i), np.diff(j)
        apart = np.minimum(di, dj) > 1  # otherwise the two pairs share a word in a text, and the first one's second word is not counted on
        between = np.maximum(di, dj) - 1 - apart
        return int(max(i[0], j[0]) + between.sum(where=(di > 1) | (dj > 1)) + max(sizes[0] - i[-1], sizes[1] - j[-1]) - 2)

    steady = (np.maximum.accumulate(j) == j) & (np.minimum.accumulate(j[::-1])[::-1] == j)
    found = edits(i[steady], j[steady])
    if found > limit:
        kept = _rising(j)
        found = edits(i[kept], j[kept])
    return found


def alike(a: str, b: str, least: float) -> bool:
    """Whether ``word_similarity(a, b, least)`` is ``least`` or more; only texts that their pairs of words do not settle are aligned."""
    (x, xs, xo), (y, ys, yo) = _words_and_pairs(a), _words_and_pairs(b)
    longer, shorter = max(len(x), len(y)), min(len(x), len(y))
    limit = int((1 - least) * longer + 1e-9)
    if longer - shorter > limit:
        return False
    if shorter > 1:
        at = np.minimum(np.searchsorted(ys, xs), len(ys) - 1)
        same = ys[at] == xs
        if np.count_nonzero(same) < longer - 1 - 2 * limit:
            return False
        edits = _edits_by_pairs((len(x), len(y)), xo[same], yo[at[same]], limit)
        if edits <= limit and 1 - edits / longer >= least:
            return True
    edits = banded_distance(x, y, limit)
    return edits is not None and (not longer or 1 - edits / longer >= least)


def word_similarity(a: str, b: str, least: float) -> float:
    """1 - edits / words of the longer if that is ``least`` or more, else 0; of lower-cased words.

    Each edit touches two pairs of neighbouring words, so texts that share too few of
    those are told apart before the alignment.
    """
    (x, xs, _), (y, ys, _) = _words_and_pairs(a), _words_and_pairs(b)
    longer = max(len(x), len(y))
    if not longer:
        return 1.0
    limit = int((1 - least) * longer + 1e-9)
    if longer - min(len(x), len(y)) > limit:
        return 0.0
    if min(len(x), len(y)) > 1:
        shared = len(np.intersect1d(xs, ys, assume_unique=True))
        if shared < longer - 1 - 2 * limit:
            return 0.0
    edits = banded_distance(x, y, limit)
    return 0.0 if edits is None else 1 - edits / longer


def _sketched(docs: DataFrame, p: OrderMinHash) -> DataFrame:
    """Row number, doc_id, digest, words and sketch keys of every row, stored."""
    def make():
        first, seen = TaskContext.get().partitionId() << 36, 0

        def work(batch: pa.RecordBatch) -> dict:
            nonlocal seen
            found, values = [], texts(batch)
            for t in values:
                found.append(sketch(t, p))
            rows = range(first + seen, first + seen + len(values))
            seen += len(values)
            return {"row": list(rows), "doc_id": batch.column("doc_id"), "words": [n for n, _ in found], "keys": [k for _, k in found],
                    "digest": [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in values]}

        return work

    return stored(arrow_map(docs.select(F.col("doc_id").cast("long"), "text"),
                            "row long, doc_id long, digest binary, words long, keys array<long>", make))


def components(links: DataFrame) -> DataFrame:
    """node and comp (its smallest node) of every node in ``links`` (a, b)."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("seen"))
        step = labels.join(near, "node").select("node", F.least("comp", "seen").alias("next"), "comp")
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("beyond"))
        new = stored(step.join(jump, "next").select("node", F.least("next", "beyond").alias("comp"), (F.least("next", "beyond") != F.col("comp")).alias("moved")))
        moved = new.filter("moved").limit(1).count()
        labels = new.drop("moved")
        if not moved:
            return labels


def joined_components(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links: only the components that these touch are looked at again."""
    ends = links
    for side in ("a", "b"):
        named = comps.select(F.col("node").alias(side), "comp")
        ends = ends.join(named, side, "left").withColumn(side, F.coalesce("comp", side)).drop("comp")
    merged = components(ends.filter("a <> b"))
    alone = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(comps, "node", "left_anti").withColumn("comp", F.col("node"))
    known = comps.unionByName(alone)
    return known.join(merged.toDF("comp", "whole"), "comp", "left").select("node", F.coalesce("whole", "comp").alias("comp"))


def _checked(pairs: DataFrame, words: DataFrame, p: OrderMinHash) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    least = p.similarity

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            found = [alike(x, y, least) for x, y in zip(texts(batch, "ta"), texts(batch, "tb"))]
            return {k: [v for v, ok in zip(batch.column(k).to_pylist(), found) if ok] for k in ("a", "b")}

        return work

    sides = (pairs.join(words.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
             .join(words.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b"))
    return arrow_map(sides.select("a", "b", "ta", "tb"), "a long, b long", make)


def _small(df: DataFrame, p: OrderMinHash) -> DataFrame:
    """``df`` (stored), sent to all tasks if it has few rows."""
    return F.broadcast(df) if df.limit(p.broadcast_rows + 1).count() <= p.broadcast_rows else df


def _placed(keyed: DataFrame, p: OrderMinHash) -> DataFrame:
    """node, words, sketch, own, bucket: texts (node, words, keys) of like length that agree in a sketch share a bucket.

    sketch is the number of the bucket's sketch, and own marks rows in the bucket of the text's own length class.
    """
    # texts whose lengths differ by less than the similarity allows share one of the two length classes
    size = F.floor(F.log("words") / math.log(1 / p.similarity) + 1e-9)
    each = keyed.filter("words > 0").select("node", "words", F.posexplode("keys").alias("sketch", "key"), F.array(size, size + 1).alias("sizes"))
    sketch = F.least("sketch", F.lit(p.sketches + p.short_sketches)).cast("short")  # those without a word have no order
    placed = each.select("node", "words", sketch.alias("sketch"), "key", F.posexplode("sizes").alias("next", "size"))
    return placed.select("node", "words", "sketch", (F.col("next") == 0).alias("own"), F.xxhash64("key", "size").alias("bucket"))


def _shared(placed: DataFrame) -> DataFrame:
    """The rows of ``placed`` in buckets of two nodes or more, with the bucket's smallest node as hub."""
    full = placed.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("most")).filter("hub < most").select("bucket", "hub")
    return placed.join(full, "bucket")


def _several(members: DataFrame, comps: DataFrame, p: OrderMinHash) -> DataFrame:
    """The rows (bucket, node, words, sketch, own) in buckets of several classes, with comp, size (rows of the bucket), classes, and n (rows of the class there, if more than a block)."""
    labelled = members.select("bucket", "node", "words", "sketch", "own").join(_small(comps, p), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    each = labelled.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    size = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("size"), F.max("n").alias("most")).filter("classes > 1")
    found = stored(labelled.join(size, "bucket"))
    large = stored(found.filter(F.col("most") > p.block).groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > p.block))
    return found.drop("most").join(_small(large, p), ["bucket", "comp"], "left")


_BINS = 1024  # counts of hashed words, four bits each
_COARSE = 512  # sums of these, which tell most pairs apart at less cost


def signature(words: np.ndarray) -> bytes:
    """Counts of the words by bins of their hashes, none above 15, two to a byte."""
    counts = np.minimum(np.bincount((words >> np.uint64(40)).astype(np.int64) % _BINS, minlength=_BINS), 15).astype(np.uint8)
    return (counts[::2] << 4 | counts[1::2]).tobytes()


def _signatures(words: DataFrame) -> DataFrame:
    """node, keys and signature of texts (node, text, keys)."""
    def make():
        return lambda batch: {"node": batch.column("node"), "keys": batch.column("keys"), "signature": [signature(word_hashes(t)) for t in texts(batch)]}

    return arrow_map(words.select("node", "text", "keys"), "node long, keys array<int>, signature binary", make)


def _blocks(several: DataFrame, signatures: DataFrame, p: OrderMinHash) -> DataFrame:
    """bucket, sketch, block, size, whole (the class, of a block of one class alone) and members of buckets of several classes.

    Classes stay together, except those larger than a block, which have blocks of their own.
    """
    pieces = lambda c: F.ceil(F.col(c) / p.block)
    own = F.xxhash64("comp", F.pmod(F.xxhash64("node"), pieces("n")))
    placed = several.select("bucket", "sketch", "own", "size", "node", "comp", "words", F.when(F.col("n").isNotNull(), F.col("comp")).alias("whole"),
                            F.when(F.col("n").isNotNull(), own).otherwise(F.pmod(F.xxhash64("comp"), pieces("size"))).alias("block"))
    member = F.struct("node", "comp", "words", "signature", "keys", "own")
    return placed.join(signatures, "node").groupBy("bucket", "sketch", "size", "whole", "block").agg(F.collect_list(member).alias("members"))


def _compared(blocks: DataFrame, p: OrderMinHash) -> DataFrame:
    """Pairs (a, b) of members of different classes, of rows with one block (x) or two (x, y), that their signatures do not tell apart.

    Texts that agree in an earlier sketch too, or in two length classes, are compared in the first of these buckets only.
    """
    least, ordered = p.similarity, p.sketches + p.short_sketches

    def make():
        def side(cells: pa.ListArray) -> tuple:
            flat = cells.flatten()
            packed = np.frombuffer(b"".join(flat.field("signature").to_pylist()), np.uint8).reshape(len(flat), _BINS // 2)
            size = np.array([0 if n is None else n for n in pc.list_value_length(cells).to_pylist()], np.int64)
            own, keys = flat.field("own").to_numpy(zero_copy_only=False), np.zeros((len(flat), ordered), np.int32)
            keys[np.arange(ordered) < pc.list_value_length(flat.field("keys")).to_numpy()[:, None]] = flat.field("keys").flatten().to_numpy()
            return (np.cumsum(size) - size, size, *(flat.field(c).to_numpy() for c in ("node", "comp", "words")), packed, own, keys)

        def work(batch: pa.RecordBatch) -> dict:
            x, y, sketches = side(batch.column("x")), side(batch.column("y")), batch.column("sketch").to_pylist()
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for row in range(batch.num_rows):
                ours, alone = slice(x[0][row], x[0][row] + x[1][row]), not y[1][row]
                other = x if alone else y
                theirs = slice(other[0][row], other[0][row] + other[1][row])
                one, two = [v[ours] for v in x[2:]], [v[theirs] for v in other[2:]]
                longer = np.maximum(one[2][:, None], two[2][None, :])
                limit = ((1 - least) * longer + 1e-9).astype(np.int64)
                apart = np.abs(one[2][:, None] - two[2][None, :])
                asked = (one[1][:, None] != two[1][None, :]) & (apart <= limit) & (one[4][:, None] | two[4][None, :])
                for k in range(sketches[row]):
                    asked &= one[5][:, k, None] != two[5][None, :, k]
                i, j = np.nonzero(np.triu(asked, 1) if alone else asked)
                if not len(i):
                    continue
                most = 2 * limit[i, j] - apart[i, j]  # an edit changes two counts, but one if it changes the length
                wide = [np.concatenate((s >> 4, s & 15), axis=1).astype(np.int8) for s in (one[3], two[3])]
                coarse = [w.reshape(len(w), -1, _COARSE).sum(axis=1, dtype=np.int16) for w in wide]
                for at in range(0, len(i), _BLOCK):
                    m, n, limits = i[at:at + _BLOCK], j[at:at + _BLOCK], most[at:at + _BLOCK]
                    for counts in (coarse, wide):  # sums differ by no more than what they sum
                        like = np.abs(counts[0][m] - counts[1][n]).sum(axis=1, dtype=np.int64) <= limits
                        m, n, limits = m[like], n[like], limits[like]
                    u, v = one[0][m], two[0][n]
                    a.append(np.minimum(u, v))
                    b.append(np.maximum(u, v))
            return {"a": np.concatenate(a), "b": np.concatenate(b)}

        return work

    return arrow_map(blocks.select("sketch", "x", "y"), "a long, b long", make)


def _class_pairs(several: DataFrame, words: DataFrame, keyed: DataFrame, p: OrderMinHash) -> DataFrame:
    """Pairs (a, b) of members of different classes of a bucket: all but those too unlike by length or signature; ``keyed`` has the keys of each node."""
    wanted = several.select("node").distinct()
    ordered = F.transform(F.slice("keys", 1, p.sketches + p.short_sketches), lambda k: F.shiftright(k, 32).cast("int"))  # enough to compare by
    signatures = stored(_signatures(words.join(wanted, "node", "left_semi").join(keyed.select("node", ordered.alias("keys")), "node")))
    blocks = stored(_blocks(several, signatures, p))
    none = F.lit(None).cast(blocks.schema["members"].dataType)
    within = blocks.filter("whole IS NULL").select("sketch", F.col("members").alias("x"), none.alias("y"))
    names = blocks.filter(F.col("size") > p.block).select("bucket", "sketch", "whole", "block")
    second = names.drop("sketch").toDF("bucket", "whole2", "block2")
    # each two blocks of a bucket once: by number, those of a large class after all others
    rank = lambda whole, block: F.struct(F.col(whole).isNotNull(), F.col(whole), F.col(block))
    both = names.join(second, "bucket").filter((rank("whole", "block") < rank("whole2", "block2")) & ~F.coalesce(F.col("whole") == F.col("whole2"), F.lit(False)))
    held = blocks.select("bucket", "block", F.coalesce("whole", F.lit(-1)).alias("whole"), "members")
    numbered = both.select("bucket", "sketch", "block", "block2", F.coalesce("whole", F.lit(-1)).alias("whole"), F.coalesce("whole2", F.lit(-1)).alias("whole2"))
    across = numbered.join(held.withColumnRenamed("members", "x"), ["bucket", "whole", "block"])
    across = across.join(held.toDF("bucket", "block2", "whole2", "y"), ["bucket", "whole2", "block2"])
    return _compared(within.unionByName(across.select("sketch", "x", "y")), p).distinct()


def _units_of(texts_of: DataFrame, p: OrderMinHash) -> DataFrame:
    """node, comp, unit of the k-mers of texts (node, comp, text)."""
    def make():
        def work(batch: pa.RecordBatch) -> dict:
            found = [units(t, p) for t in texts(batch)]
            sizes = [len(u) for u in found]
            return {"node": np.repeat(batch.column("node").to_numpy(), sizes), "comp": np.repeat(batch.column("comp").to_numpy(), sizes),
                    "unit": np.concatenate([np.empty(0, np.int64), *found])}

        return work

    return arrow_map(texts_of.select("node", "comp", "text"), "node long, comp long, unit long", make)


def _sketched_again(texts_of: DataFrame, common: DataFrame, units_of: DataFrame, p: OrderMinHash) -> DataFrame:
    """node, words and keys of second sketches of texts (node, text), from the k-mers that are not in ``common`` (unit).

    Up to ``broadcast_rows`` common k-mers are sent to all tasks; of more, each text gets its own by a join.
    """
    known = None
    if common.limit(p.broadcast_rows + 1).count() <= p.broadcast_rows:
        known = common.sparkSession.sparkContext.broadcast(common.toPandas()["unit"].to_numpy(np.int64).view(np.uint64))
        texts_of = texts_of.withColumn("common", F.lit(None).cast("array<long>"))
    else:
        lists = units_of.join(common, "unit").groupBy("node").agg(F.collect_list("unit").alias("common"))  # k-mers of one text
        texts_of = texts_of.join(lists, "node", "left")

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            if known is None:
                left_out = [np.array(c if c is not None else [], np.int64).view(np.uint64) for c in batch.column("common").to_pylist()]
            else:
                left_out = [known.value] * batch.num_rows
            found = texts(batch)
            return {"node": batch.column("node"), "words": [len(word_hashes(t)) for t in found], "keys": [sketch_without(t, p, c) for t, c in zip(found, left_out)]}

        return work

    return arrow_map(texts_of.select("node", "text", "common"), "node long, words long, keys array<long>", make)


def _rarer_buckets(inside: DataFrame, words: DataFrame, comps: DataFrame, p: OrderMinHash) -> DataFrame:
    """Rows (bucket, node, words, sketch, own) of the second sketches of the texts in buckets of many classes (``inside``: node)."""
    inside = inside.select("node").distinct()
    named = stored(inside.join(_small(comps, p), "node", "left").select("node", F.coalesce("comp", "node").alias("comp")))
    texts_of = words.join(_small(named, p), "node")
    found = stored(_units_of(texts_of, p))
    common = found.select("unit", "comp").distinct().groupBy("unit").agg(F.count(F.lit(1)).alias("classes")).filter(F.col("classes") > p.few).select("unit")
    again = _sketched_again(texts_of.select("node", "text"), stored(common), found, p)
    # a text without rare k-mers has no keys of these, so the places of keys do not tell their sketches
    return stored(_shared(_placed(again, p)).select("bucket", "node", "words", F.lit(0).cast("short").alias("sketch"), "own"))


def _classes(docs: DataFrame, p: OrderMinHash) -> tuple[DataFrame, DataFrame]:
    """(sketched rows, nodes): nodes are distinct texts with digest, doc_id (smallest), copies and comp."""
    rows = _sketched(docs, p)
    nodes = stored(rows.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"),
                                              F.first("words").alias("words"), F.first("keys").alias("keys")))
    members = stored(_shared(_placed(nodes.select("node", "words", "keys"), p)))
    pairs = stored(members.filter((F.col("sketch") < p.early) & (F.col("hub") < F.col("node"))).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    wanted = stored(nodes.join(members.select("node").distinct(), "node").select("node", F.col("digest").alias("__digest"), F.col("doc_id").alias("__doc")))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("digest", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    match = (F.col("digest") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("__doc"))
    words = stored(plain.join(_small(wanted, p), match).select("node", "text").dropDuplicates(["node"]))
    comps = components(_checked(pairs, words, p))
    several = stored(_several(members, comps, p))
    rarer = _rarer_buckets(several.filter(F.col("classes") > p.few), words, comps, p)
    near = stored(_class_pairs(stored(several.unionByName(_several(rarer, comps, p))), words, nodes, p))
    found = stored(_checked(near.join(pairs, ["a", "b"], "left_anti"), words, p))
    comps = stored(joined_components(comps, found))
    labelled = nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    return rows, stored(labelled.select("digest", "node", "doc_id", "copies", "comp"))


def near_duplicates(docs: DataFrame, p: OrderMinHash = OrderMinHash()) -> DataFrame:
    """doc_id, class_id, copies, class_docs, kept of every document.

    class_id is the smallest doc_id of the class, copies the number of rows with the same
    text, class_docs the rows of the class; kept marks the rows of the text that stays.
    A null text is empty; empty texts are copies of each other; texts of fewer words than
    a k-mer have one k-mer. Null ids come last when the smallest is chosen, and class_id
    is null where a class has no other. Repeated rows are copies. Only doc_id and text
    are read.
    """
    rows, nodes = _classes(docs, p)
    whole = nodes.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_docs"))
    named = nodes.join(whole, "comp").select("digest", "class_id", "copies", "class_docs")
    return rows.select("doc_id", "digest").join(named, "digest").select(
        "doc_id", "class_id", "copies", "class_docs", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def deduplicated(docs: DataFrame, p: OrderMinHash = OrderMinHash()) -> DataFrame:
    """One document of each class, with all columns: that with the smallest doc_id (null ids last)."""
    rows, nodes = _classes(docs, p)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node"))
    stay = nodes.groupBy("comp").agg(first.alias("s")).select(F.col("s.node").alias("node"))
    chosen = nodes.join(stay, "node").select("digest", F.col("doc_id").alias("first"), F.lit(True).alias("stays"))
    marked = rows.select("doc_id", "digest").join(chosen, "digest", "left")
    lost = F.col("stays").isNull() | ~F.col("doc_id").eqNullSafe(F.col("first"))
    tally = marked.groupBy("digest", "doc_id").agg(F.max(lost).alias("lost"), F.count(F.lit(1)).alias("n"))
    return _without(docs, stored(tally.filter("lost OR n > 1")), p)


def _without(docs: DataFrame, odd: DataFrame, p: OrderMinHash) -> DataFrame:
    """``docs`` without rows that are lost, and with one row of those that stay but are repeated."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    plain = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__digest": F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))})
    match = (F.col("__digest") == F.col("digest")) & F.col("__id").eqNullSafe(F.col("id"))
    named = odd.withColumnRenamed("doc_id", "id")
    stay = plain.join(_small(named, p), match, "left_anti")
    repeated = plain.join(_small(stored(named.filter("NOT lost")), p), match, "left_semi").dropDuplicates(["__id", "__digest"])
    return stay.union(repeated).select(*names)
