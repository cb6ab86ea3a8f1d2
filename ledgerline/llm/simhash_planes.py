"""SimHash near-duplicates compared in bit slices.

A document's fingerprint has the bits that are set in over half the hashes of its word
shingles. Equal fingerprints are folded first. Two fingerprints that differ in at most
``radius`` bits agree in whole blocks of bits, so each is put into a bucket for every
choice of blocks; buckets that grow large are cut again by the bits that are still free,
until the number of different fingerprints that fit into one is small. Within a bucket bit
planes lie vertically: one word of a plane has the same bit of 64 fingerprints, a shifted
plane is compared with itself, and counters in carry-save form add up 64 distances at once.
Words whose distances all exceed the radius are given up. What a bucket links is passed on
as a star to its smallest member, and the stars are joined to components.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_map, arrow_schema, sized, texts
from ledgerline.llm.order_minhash import components
from ledgerline.sources.shared import stored

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_BLOCK = 1 << 16  # shingles whose bits are counted at once
_PLANES = [(29 * i) % 64 for i in range(64)]  # neighbouring bits are apart in this order
_LOOK = 4  # planes between two looks at what can be given up


@dataclass(frozen=True)
class SimHash:
    """Shingles have ``width`` words, hashes ``seed``; fingerprints link at ``radius`` differing bits or fewer.

    Buckets of more than ``bucket_rows`` different fingerprints are cut by further bits.
    Tables of up to ``broadcast_rows`` rows are sent to all tasks.
    """

    width: int = 3
    seed: int = 42
    radius: int = 3
    bucket_rows: int = 1024
    broadcast_rows: int = 500_000


def fingerprint(text: str, p: SimHash) -> int:
    """The fingerprint of a text, 0 if it has no words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    joined = b" ".join(words)
    starts = [0, *ends[:-1]]
    stops = ends[p.width - 1:] or ends[-1:]
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(stops), _BLOCK):
        digests = b"".join(xxhash.xxh64_digest(joined[s:e - 1], p.seed) for s, e in zip(starts[at:at + _BLOCK], stops[at:at + _BLOCK]))
        set_bits += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(stops)).tobytes(), "big")


def fingerprints(docs: DataFrame, p: SimHash) -> DataFrame:
    """doc_id and node (the fingerprint as a signed number) of every row."""
    def make():
        def work(batch: pa.RecordBatch) -> dict:
            found = np.array([fingerprint(t, p) for t in texts(batch)], np.uint64)
            return {"doc_id": batch.column("doc_id"), "node": found.view(np.int64)}

        return work

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, node long", make)


def finer_masks(mask: int, blocks: int, fixed: int) -> list[int]:
    """``mask`` with each choice of ``fixed`` of the ``blocks`` blocks of its free bits."""
    free = [b for b in range(64) if not mask >> b & 1]
    cut = [sum(1 << b for b in free[len(free) * i // blocks:len(free) * (i + 1) // blocks]) for i in range(blocks)]
    return [mask | sum(chosen) for chosen in itertools.combinations(cut, fixed)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _buckets(nodes: DataFrame, p: SimHash) -> DataFrame:
    """mask, part (the masked bits) and node: rows of buckets of bounded size in which all linked nodes meet."""
    spark = nodes.sparkSession
    masks = finer_masks(0, p.radius + 2, 2)
    rows = nodes.select("node", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"))
    out = None
    while True:
        rows = rows.withColumn("part", F.col("node").bitwiseAND(F.col("mask")))
        large = stored(rows.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > p.bucket_rows).drop("n"))
        none = large.limit(1).count() == 0
        here = rows if none else rows.join(sized(large, p.broadcast_rows), ["mask", "part"], "left_anti")
        out = here if out is None else out.unionByName(here)
        if none:
            return out
        finer = [(_signed(m), _signed(f)) for m in masks for f in finer_masks(m, 2 * p.radius, p.radius)]
        table = F.broadcast(spark.createDataFrame(finer, "mask long, finer long"))  # as many rows as there are masks
        inside = rows.join(sized(large, p.broadcast_rows), ["mask", "part"], "left_semi")
        rows = stored(inside.join(table, "mask").select("node", F.col("finer").alias("mask")).distinct())
        masks = sorted({f & (1 << 64) - 1 for _, f in finer})


def _planes(nodes: np.ndarray) -> np.ndarray:
    """64 rows: the bits of all nodes, 64 nodes a word, and two empty words at the end."""
    bits = np.zeros((64, (len(nodes) + 63) // 64 * 64 + 128), np.uint8)
    bits[:, :len(nodes)] = np.unpackbits(nodes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _near(nodes: np.ndarray, group: np.ndarray, far: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, i + d) of one group, 64 * far <= d < 64 * far + 64, that differ in ``radius`` bits or fewer; i, j."""
    n, planes = len(nodes), _planes(nodes)
    groups = np.full(n + 64 * far + 64, -1, np.int64)
    groups[:n] = group
    lags = np.arange(64) + 64 * far
    valid = np.zeros((64, (n + 63) // 64 * 64), np.uint8)
    for s, d in enumerate(lags):
        if d:
            valid[s, :n] = groups[d:n + d] == group
    valid = np.packbits(valid, axis=1, bitorder="little").view(np.uint64)
    shift, word = np.nonzero(valid)
    over = ~valid[shift, word]
    s = shift.astype(np.uint64)
    counters = [np.zeros(len(word), np.uint64) for _ in range(radius.bit_length())]
    exact = radius + 1 == 1 << len(counters)  # the counters run over just beyond the radius
    for turn, b in enumerate(_PLANES):
        plane = planes[b]
        other = (plane[word + far] >> s) | ((plane[word + far + 1] << np.uint64(1)) << (np.uint64(63) - s))
        carry = plane[word] ^ other
        for c in counters:  # add one bit to the vertical counters
            c ^= carry
            carry &= ~c
        over |= carry
        if not exact:
            over |= _above(counters, radius)
        if turn % _LOOK == _LOOK - 1:
            alive = over != _ALL
            if not alive.all():
                shift, word, over, s = shift[alive], word[alive], over[alive], s[alive]
                counters = [c[alive] for c in counters]
                if not len(word):
                    break
    at, bit = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")) if len(over) else (np.empty(0, int), np.empty(0, int))
    i = 64 * word[at] + bit
    return i, i + lags[shift[at]]


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits of the counters whose number is above ``radius``."""
    above, same = np.zeros_like(counters[0]), np.full_like(counters[0], _ALL)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            same &= counters[k]
        else:
            above |= same & counters[k]
            same &= ~counters[k]
    return above


def linked(nodes: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest linked one of its group; rows of a group lie together, its nodes rise."""
    left, right = [], []
    at, far = np.arange(len(nodes)), 0
    while len(at):
        i, j = _near(nodes[at], group[at], far, radius)
        left.append(at[i])
        right.append(at[j])
        far += 1
        _, number, size = np.unique(group[at], return_inverse=True, return_counts=True)
        at = at[size[number] > 64 * far]
    i, j = np.concatenate([np.empty(0, np.int64), *left]), np.concatenate([np.empty(0, np.int64), *right])
    least = np.arange(len(nodes))
    while len(i):
        low = np.minimum(least[i], least[j])
        if (low == least[i]).all() and (low == least[j]).all():
            break
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
        least = least[least]
    ends = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[least[ends]], nodes[ends]


def links(nodes: DataFrame, p: SimHash) -> DataFrame:
    """Links (a, b) between different fingerprints (column node) that connect all within the radius."""
    arrow = arrow_schema("a long, b long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((3, 0), np.int64)  # rows of the bucket that may go on in the next batch

        def found(rows: np.ndarray) -> pa.RecordBatch:
            new = np.concatenate(([False], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)))
            a, b = linked(rows[2], np.cumsum(new), p.radius)
            return pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=arrow)

        for batch in batches:
            held = np.concatenate((held, np.stack([batch.column(c).to_numpy() for c in ("mask", "part", "node")])), axis=1)
            if held.shape[1]:
                last = np.flatnonzero((held[:2] != held[:2, -1:]).any(axis=0))
                if len(last):
                    yield found(np.ascontiguousarray(held[:, :last[-1] + 1]))
                    held = held[:, last[-1] + 1:]
        if held.shape[1]:
            yield found(np.ascontiguousarray(held))

    dealt = _buckets(nodes, p).select("mask", "part", "node").repartition("mask", "part").sortWithinPartitions("mask", "part", "node")
    return dealt.mapInArrow(work, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, p: SimHash = SimHash()) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every document.

    component_id is the smallest doc_id that links reach; null ids count only where a
    component has no other, which then has a null component_id. A null text is empty, and
    texts without words have the fingerprint 0 and link like others. Texts of fewer words
    than a shingle are one shingle. Repeated rows are copies of each other, an empty table
    gives no rows, and only doc_id and text are read.
    """
    rows = stored(fingerprints(docs, p))
    nodes = stored(rows.groupBy("node").agg(F.min("doc_id").alias("first")))
    comps = components(links(nodes.select("node"), p))
    named = nodes.join(sized(comps, p.broadcast_rows), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    whole = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    classes = stored(named.join(whole, "comp").select("node", "component_id"))
    hexed = F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint")
    return rows.join(sized(classes, p.broadcast_rows), "node").select("doc_id", hexed, "component_id")
