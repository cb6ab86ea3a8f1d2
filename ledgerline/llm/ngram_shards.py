"""Trigrams of documents joined with counts of trusted trigrams, part by part, for ``kneser_ney.py``.

The trigrams (u, v, w) are dealt into parts by their middle word v: the counts of (u, v, w),
(u, v), (v, w) and v then lie in one part, where they are joined with the documents' trigrams
of the part. Slices of text send each part one row of packed trigrams, so no trigram is a row.
Parts are done in several passes over the text, and the shuffle files of a pass go when it ends.
A middle word of many trigrams has several parts, dealt by u; each gets the word's bigrams.
Such parts are dealt in turn, and a part is unpacked some trigrams at a time, so that a task
holds the packed trigrams and the different trusted ones of its part only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_schema
from ledgerline.sources.shared import stored

START, END, UNKNOWN = 0, 1, 2
PLACE_BITS = 36  # a row is known by the number of its partition, and its place there in so many bits
_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SPLIT_BYTES = 1 << 20  # what is split into words at once stays in the cache
_SPECIAL = np.array([START, END, UNKNOWN], np.int64)
#: What a part gets: packed trigrams of a slice, a bigram of a split word, a trigram around unknown, a word's probability.
GRAMS, PAIR, AROUND, WORD = 0, 1, 2, 3
#: Rows of counts: counts of trigrams and of bigrams by size, bigrams by last word, and PAIR and AROUND.
TRI_SIZES, BI_SIZES, LAST = 10, 11, 12
_PACKED = "part int, kind int, at long, size int, words binary, grams binary, of binary, trusted binary, u long, v long, w long, n double"


@dataclass(frozen=True)
class Deal:
    """How trigrams are dealt: ``parts`` parts in each of ``passes`` passes; ``split`` words (sorted hashes) have ``pieces`` parts.

    Slices of text have ``slice_bytes`` bytes or one document; words of more than ``word_bytes`` bytes are unknown.
    About ``chunk`` trigrams of a part are unpacked at once.
    """

    passes: int
    parts: int
    split: np.ndarray
    pieces: np.ndarray
    slice_bytes: int
    word_bytes: int
    chunk: int = 1 << 19

    def parts_of(self, v: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """The number, over all passes, of the part of each v (hash) and piece; the pieces of all split words are dealt in turn."""
        at, hit = found(self.split, v)
        part = (mixed(v, piece) >> np.uint64(20)).astype(np.int64)
        part[hit] = (np.cumsum(self.pieces) - self.pieces)[at[hit]] + piece[hit]
        return part % (self.passes * self.parts)

    def pieces_of(self, v: np.ndarray) -> np.ndarray:
        at, hit = found(self.split, v)
        return np.where(hit, self.pieces[at], 1) if len(self.split) else np.ones(len(v), np.int64)


def mixed(*columns: np.ndarray) -> np.ndarray:
    """A 64-bit key of several columns of 64-bit hashes."""
    key = np.zeros(len(columns[0]), np.uint64)
    with np.errstate(over="ignore"):
        for x in columns:
            key = (key ^ (key >> np.uint64(32))) * _MIX + x.astype(np.int64).view(np.uint64)
        key = (key ^ (key >> np.uint64(31))) * _MIX
    return key ^ (key >> np.uint64(29))


def found(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted ``keys``, whether it is there) of each x."""
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1), base, np.uint64))))


def hashed_words(data: bytes, word_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of each lower-cased word of UTF-8 text; that of a word of too many bytes is UNKNOWN."""
    points = _LOWER[np.frombuffer(data, np.uint8)]
    edge = np.diff(np.concatenate(([True], _GAP[points], [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = end - start
    h = np.zeros(len(start), np.uint64)
    powers = _powers(_BASE, word_bytes)
    with np.errstate(over="ignore"):
        order = np.argsort(-size, kind="stable")  # words still going come first
        at, longest = start[order], -size[order]
        for j in range(min(word_bytes, int(size.max(initial=0)))):
            live = order[:np.searchsorted(longest, -j, side="left")]
            h[live] += (points[start[live] + j].astype(np.uint64) + np.uint64(1)) * powers[j]
    return start, _finished(h, size, word_bytes)


def _finished(h: np.ndarray, size: np.ndarray, word_bytes: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h ^= h >> np.uint64(29)
    h[size > word_bytes] = UNKNOWN
    return h.view(np.int64)


def _hashes(words: pa.StringArray, word_bytes: int) -> np.ndarray:
    """What ``hashed_words`` gives for lower-cased words, by sums over the bytes of many words at once."""
    if not len(words):
        return np.zeros(0, np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    data, powers, out = np.frombuffer(words.buffers()[2], np.uint8), _powers(_BASE, word_bytes), []
    for i in range(0, len(words), 1 << 16):
        edge = offsets[i:i + (1 << 16) + 1]
        start, size = edge[:-1] - edge[0], np.diff(edge)
        place = np.minimum(np.arange(edge[-1] - edge[0]) - np.repeat(start, size), word_bytes)
        with np.errstate(over="ignore"):
            out.append(np.add.reduceat((data[edge[0]:edge[-1]].astype(np.uint64) + np.uint64(1)) * powers[place], start))
    return _finished(np.concatenate(out), np.diff(offsets), word_bytes)


# --- slices of text ---------------------------------------------------------------

@dataclass
class Slice:
    """Trigrams of some rows: u, v, w are places in ``hashes``, ``of`` the number of the row in the slice."""

    at: int
    batch: pa.RecordBatch
    hashes: np.ndarray
    u: np.ndarray
    v: np.ndarray
    w: np.ndarray
    of: np.ndarray


def _sliced(batch: pa.RecordBatch, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + slice_bytes, side="right"))
        yield batch.slice(start, max(end - start, 1))
        start = max(end, start + 1)


def _slice(batch: pa.RecordBatch, at: int, word_bytes: int) -> Slice:
    of, words, rows = [], [], 0
    for own in _sliced(batch, _SPLIT_BYTES):
        found_words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(own.column("text"), "")))
        of.append(pc.list_parent_indices(found_words).to_numpy(zero_copy_only=False) + rows)
        words.append(pc.list_flatten(found_words))
        rows += own.num_rows
    of, coded = np.concatenate(of), pa.chunked_array(words).dictionary_encode().combine_chunks()
    number, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    empty = pc.index(distinct, "").as_py()  # before and after white space at the ends
    if empty >= 0:
        real = number != empty
        of, number = of[real], number[real]
        number = number - (number > empty)
        distinct = distinct.filter(pc.not_equal(distinct, ""))
    hashes = np.concatenate((_hashes(distinct, word_bytes), _SPECIAL[:2]))
    start, end, n = len(hashes) - 2, len(hashes) - 1, np.bincount(of, minlength=batch.num_rows)
    ends = np.cumsum(n + 3)
    ids = np.full(int(ends[-1]), start, np.int32)
    ids[np.arange(len(number)) + 3 * of + 2] = number
    ids[ends - 1] = end
    row = np.repeat(np.arange(batch.num_rows, dtype=np.int32), n + 3)
    keep = np.flatnonzero(row[2:] == row[:-2])  # no trigram goes over two documents
    return Slice(at, batch, hashes, ids[keep], ids[keep + 1], ids[keep + 2], row[keep])


def _map_slices(docs: DataFrame, schema: str, slice_bytes: int, word_bytes: int, make: Callable[[], Callable[[Slice], Iterator[dict]]]) -> DataFrame:
    """Rows made of each slice of ``docs``. The first row of a slice is known by its place in the read table."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, work = TaskContext.get().partitionId() << PLACE_BITS, make()
        for batch in batches:
            for own in _sliced(batch, slice_bytes):
                for out in work(_slice(own, at, word_bytes)):
                    n = len(next(iter(out.values())))
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if f.name in out else pa.nulls(n, f.type) for f in arrow], schema=arrow)
                at += own.num_rows

    return docs.mapInArrow(run, schema)


def _places(s: Slice, deal: Deal, other: np.ndarray, number: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(trigrams, the part of each over all passes), of all or the pass ``number``; ``other`` deals the trigrams of a split v."""
    pieces = deal.pieces_of(s.hashes)
    part, split = deal.parts_of(s.hashes, np.zeros(len(s.hashes), np.int64)), pieces > 1
    at = np.arange(len(s.v)) if number is None else np.flatnonzero(((part % deal.passes == number) | split)[s.v])
    v = s.v[at]
    place, cut = part[v], np.flatnonzero(split[v])
    place[cut] = deal.parts_of(s.hashes[v[cut]], _piece_of(s.hashes[other[at[cut]]], pieces[v[cut]]))
    if number is None or not len(cut):
        return at, place
    mine = place % deal.passes == number
    return at[mine], place[mine]


def _piece_of(u: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    return ((mixed(u) >> np.uint64(24)) % pieces.astype(np.uint64)).astype(np.int64)


def documents(docs: DataFrame, slice_bytes: int, word_bytes: int) -> DataFrame:
    """row, doc_id, lang, n (trigrams) of each document, and v, n of the words that are a thousandth of a slice's trigrams or more."""
    def make():
        def work(s: Slice) -> Iterator[dict]:
            yield {"row": s.at + np.arange(s.batch.num_rows), "doc_id": s.batch.column("doc_id"), "lang": s.batch.column("lang"),
                   "n": np.bincount(s.of, minlength=s.batch.num_rows)}
            n = np.bincount(s.v, minlength=len(s.hashes))
            many = np.flatnonzero(n * 1000 >= len(s.v))
            yield {"v": s.hashes[many], "n": n[many]}

        return work

    return _map_slices(docs, "row long, doc_id long, lang string, v long, n long", slice_bytes, word_bytes, make)


def _packed(docs: DataFrame, deal: Deal, number: int, by_last: bool = False) -> DataFrame:
    """The packed trigrams of the pass ``number``; ``docs`` has text and trusted. A split v is dealt by w instead of u if ``by_last``."""
    def make():
        def work(s: Slice) -> Iterator[dict]:
            mine, place = _places(s, deal, s.w if by_last else s.u, number)
            if not len(mine):
                return
            part = place // deal.passes
            order = np.argsort(part.astype(np.uint16) if deal.parts <= 1 << 16 else part, kind="stable")
            mine, part = mine[order], part[order]
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            trusted = s.batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            used, new = np.zeros(len(s.hashes), bool), np.zeros(len(s.hashes), np.int32)
            rows = []
            for a, b in zip(edges[:-1], edges[1:]):
                at = mine[a:b]
                own, of = np.concatenate((s.u[at], s.v[at], s.w[at])), s.of[at]
                used[own] = True
                words = np.flatnonzero(used)
                used[words] = False
                new[words] = np.arange(len(words))
                rows.append((int(part[a]), int(b - a), s.hashes[words].tobytes(), _bytes(new[own], len(words)), _bytes(of, s.batch.num_rows),
                             np.packbits(trusted[of]).tobytes()))
            yield {"kind": [GRAMS] * len(rows), "at": [s.at] * len(rows), **dict(zip(("part", "size", "words", "grams", "of", "trusted"), zip(*rows)))}

        return work

    return _map_slices(docs, _PACKED, deal.slice_bytes, deal.word_bytes, make)


def _bytes(numbers: np.ndarray, below: int) -> bytes:
    return numbers.astype(np.uint16 if below <= 1 << 16 else np.uint32).tobytes()


def _numbers(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint32 if len(data) == 4 * n else np.uint16)


def _table(schema: pa.Schema, columns: list) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)


# --- counts of the trusted text ---------------------------------------------------

_COUNTS = "kind int, a long, b long, c long, n long"


def _sizes(kind: int, counts: np.ndarray) -> list[tuple[int, ...]]:
    return [(kind, i, 0, 0, int((counts == i).sum())) for i in (1, 2, 3, 4)]


def _around(u: np.ndarray, v: np.ndarray, split: np.ndarray) -> np.ndarray:
    """Trigrams that every part has: a word not in the trusted text is dealt as itself and then looked up as unknown."""
    return (v == UNKNOWN) | ((u == UNKNOWN) & found(split, v)[1])


def _chunks(slices: pa.Table, chunk: int) -> list[pa.Table]:
    """``slices`` cut into tables of about ``chunk`` trigrams, or one slice."""
    ends, out, start = np.cumsum(slices.column("size").to_numpy(), dtype=np.int64), [], 0
    while start < len(ends):
        end = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + chunk, side="right"))
        out.append(slices.slice(start, max(end - start, 1)))
        start = max(end, start + 1)
    return out


def _tallied(grams: Iterable[tuple[np.ndarray, ...]], chunk: int) -> tuple[np.ndarray, ...]:
    """(key, u, v, w, count) of the different trigrams among arrays u, v, w and n, by key; no more than these and about as many more are held."""
    def merged() -> tuple[np.ndarray, ...]:
        u, v, w, n = (np.concatenate(x) for x in zip(*held))
        key, at, which = np.unique(mixed(u, v, w), return_index=True, return_inverse=True)
        return key, u[at], v[at], w[at], np.bincount(which, n, len(key))

    held, new = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)], 0
    for own in grams:
        if new and new + len(own[0]) > max(chunk, len(held[0][0])):
            held, new = [merged()[1:]], 0
        held.append(own)
        new += len(own[0])
    return merged()


def _count(deal: Deal) -> Callable[[pa.Table], pa.Table]:
    """Counts of a part's trigrams, in which bigrams are whole."""
    schema, split = arrow_schema(_COUNTS), deal.split

    def grams(slices: pa.Table) -> tuple[np.ndarray, ...]:
        found_grams = [np.frombuffer(r["words"], np.int64)[_numbers(r["grams"], 3 * r["size"]).reshape(3, -1)] for r in slices.to_pylist()]
        u, v, w = np.concatenate(found_grams, axis=1)
        return u, v, w, np.ones(len(u))

    def run(part: pa.Table) -> pa.Table:
        _, u, v, w, c = _tallied(map(grams, _chunks(part.select(["size", "words", "grams"]), deal.chunk)), deal.chunk)
        around = np.flatnonzero(_around(u, v, split))
        _, at, c2 = np.unique(mixed(v, w), return_index=True, return_counts=True)
        last, n = np.unique(w[at], return_counts=True)
        pair = found(split, v[at])[1] & (v[at] != UNKNOWN)
        kind, a, b, m, size = map(list, zip(*_sizes(TRI_SIZES, c), *_sizes(BI_SIZES, c2)))
        return _table(schema, [np.concatenate([np.asarray(y, np.int64) for y in x]) for x in (
            (kind, np.full(len(last), LAST), np.full(pair.sum(), PAIR), np.full(len(around), AROUND)), (a, last, v[at][pair], u[around]),
            (b, np.zeros(len(last)), w[at][pair], w[around]), (m, np.zeros(len(last) + pair.sum()), v[around]), (size, n, c2[pair], c[around]))])

    return run


def counts(marked: DataFrame, deal: Deal, passes: int) -> DataFrame:
    """Counts over the trusted rows: kind, words a, b and c, n. Stored."""
    own = marked.filter("trusted")
    deal = replace(deal, passes=passes)
    parts = (_packed(own, deal, i, True).groupBy("part").applyInArrow(_count(deal), _COUNTS) for i in range(deal.passes))
    return reduce(DataFrame.union, [stored(x.groupBy("kind", "a", "b", "c").agg(F.sum("n").alias("n")), free=True) for x in parts])


# --- scores -----------------------------------------------------------------------

@dataclass(frozen=True)
class Model:
    """What all parts share: discounts of trigrams and bigrams, probabilities of ``common`` words (sorted hashes), of a word not
    in the trusted text, and whether such words count as unknown."""

    trigrams: tuple[float, float, float]
    bigrams: tuple[float, float, float]
    common: np.ndarray
    p: np.ndarray
    rest: float
    unknown: bool


def uncommon(docs: DataFrame, deal: Deal, model: Broadcast) -> DataFrame:
    """place (part over all passes), w: the last words of trigrams that are not common, and the others if such words may be unknown."""
    def make():
        m = model.value

        def work(s: Slice) -> Iterator[dict]:
            rare = ~found(m.common, s.hashes)[1] & ~np.isin(s.hashes, _SPECIAL)
            place = _places(s, deal, s.u)[1]
            ats = [(x, np.flatnonzero(rare[x])) for x in ((s.u, s.v, s.w) if m.unknown else (s.w,))]
            part, w = np.concatenate([place[at] for _, at in ats]), np.concatenate([s.hashes[x[at]] for x, at in ats])
            at = np.unique(mixed(part, w), return_index=True)[1]
            yield {"place": part[at], "w": w[at]}

        return work

    return _map_slices(docs, "place long, w long", deal.slice_bytes, deal.word_bytes, make)


def _pairs(pairs: DataFrame, deal: Deal) -> DataFrame:
    """place, v, w, n: bigrams of split words (a, b, n), for each piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n = (batch.column(x).to_numpy() for x in "abn")
            pieces = deal.pieces_of(a)
            row = np.repeat(np.arange(len(a)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            yield pa.RecordBatch.from_pydict({"place": deal.parts_of(a[row], piece), "v": a[row], "w": b[row], "n": n[row].astype(float)})

    return pairs.select("a", "b", "n").mapInArrow(run, "place long, v long, w long, n double")


_SCORES = "at long, of binary, total binary, n binary"


def _off(d: tuple[float, float, float], c: np.ndarray) -> np.ndarray:
    return np.array((0.0, *d))[np.minimum(c, 3).astype(np.int64)]


def _score(deal: Deal, model: Broadcast) -> Callable[[pa.Table], pa.Table]:
    """Sums of logs by slice and row of a part's trigrams."""
    schema, split = arrow_schema(_SCORES), deal.split

    def run(part: pa.Table) -> pa.Table:
        m = model.value
        rows = {k: part.filter(pc.equal(part.column("kind"), k)) for k in (GRAMS, PAIR, AROUND, WORD)}
        column = lambda k, name: rows[k].column(name).to_numpy()
        order = np.argsort(column(WORD, "w"))
        rare, rare_p = column(WORD, "w")[order], column(WORD, "n")[order]
        chunks = _chunks(rows[GRAMS].select(["at", "size", "words", "grams", "of", "trusted"]), deal.chunk)
        if not chunks:
            return schema.empty_table()

        @lru_cache(1)  # a part of one chunk is unpacked once
        def unpacked(number: int) -> tuple:
            grams, last, own, slices = [], [], [], chunks[number].to_pylist()
            for r in slices:
                words, places = np.frombuffer(r["words"], np.int64), _numbers(r["grams"], 3 * r["size"]).reshape(3, -1)
                (at, hit), (rare_at, rare_hit) = found(m.common, words), found(rare, words)
                p = np.full(len(words), m.rest)
                p[hit], p[rare_hit] = m.p[at[hit]], rare_p[rare_at[rare_hit]]
                if m.unknown:
                    new = ~(hit | rare_hit | np.isin(words, _SPECIAL))
                    words, p = np.where(new, UNKNOWN, words), np.where(new, m.p[np.searchsorted(m.common, UNKNOWN)], p)
                grams.append(words[places])
                last.append(p[places[2]])
                own.append(np.unpackbits(np.frombuffer(r["trusted"], np.uint8), count=r["size"]).astype(bool))
            return slices, *np.concatenate(grams, axis=1), np.concatenate(last), np.concatenate(own)

        def trusted(number: int) -> tuple[np.ndarray, ...]:
            _, u, v, w, _, own = unpacked(number)
            at = np.flatnonzero(own & ~_around(u, v, split))
            return u[at], v[at], w[at], np.ones(len(at))

        around = tuple(column(AROUND, x) for x in "uvwn")
        tri, tu, tv, tw, c3 = _tallied(chain(map(trusted, range(len(chunks))), [around]), deal.chunk)
        context, which = np.unique(mixed(tu, tv), return_inverse=True)
        total3, off3 = np.bincount(which, c3, len(context)), np.bincount(which, _off(m.trigrams, c3), len(context))

        whole = np.flatnonzero(~found(split, tv)[1] | (tv == UNKNOWN))  # the bigrams of split words are in PAIR
        bi, at, c2 = np.unique(mixed(tv[whole], tw[whole]), return_index=True, return_counts=True)
        bi = np.concatenate((bi, mixed(column(PAIR, "v"), column(PAIR, "w"))))
        bv, c2 = np.concatenate((tv[whole][at], column(PAIR, "v"))), np.concatenate((c2, column(PAIR, "n")))
        bi, at = np.unique(bi, return_index=True)  # two pieces of a word can be in the same part
        bv, c2 = bv[at], c2[at]
        middle, which = np.unique(bv, return_inverse=True)
        total2, off2 = np.bincount(which, c2, len(middle)), np.bincount(which, _off(m.bigrams, c2), len(middle))
        del tu, tv, tw, bv, which

        def level(lower: np.ndarray, keys, c, d, x, contexts, total, off, context_x) -> np.ndarray:
            out, (at, hit) = lower.copy(), found(contexts, context_x)
            at = at[hit]
            out[hit] *= off[at] / total[at]
            n, there = found(keys, x)
            own = np.zeros(len(x))
            own[there] = c[n[there]] - _off(d, c[n[there]])
            out[hit] += own[hit] / total[at]
            return out

        out = []
        for number in range(len(chunks)):
            slices, u, v, w, last, _ = unpacked(number)
            p = level(last, bi, c2, m.bigrams, mixed(v, w), middle, total2, off2, v)
            log = np.log(level(p, tri, c3, m.trigrams, mixed(u, v, w), context, total3, off3, mixed(u, v)))
            start = 0
            for r in slices:
                of = _numbers(r["of"], r["size"])
                n = np.bincount(of)
                there = np.flatnonzero(n)
                total = np.bincount(of, log[start:start + r["size"]])[there]
                start += r["size"]
                out.append((r["at"], there.astype(np.uint32).tobytes(), total.tobytes(), n[there].astype(np.uint32).tobytes()))
        return _table(schema, list(zip(*out)))

    return run


def _sum(scores: pa.Table) -> pa.Table:
    """Sums by row of the scores of one slice from all parts."""
    of, total, n = (np.concatenate([np.frombuffer(x, t) for x in scores.column(c).to_pylist()]) for c, t in (("of", np.uint32), ("total", float), ("n", np.uint32)))
    rows = np.unique(of)
    at = np.searchsorted(rows, of)
    first = scores.column("at")[0].as_py()
    return pa.table({"row": first + rows.astype(np.int64), "total": np.bincount(at, total), "n": np.bincount(at, n).astype(np.int64)})


def scored(marked: DataFrame, table: DataFrame, words: DataFrame, deal: Deal, model: Broadcast) -> DataFrame:
    """row, total (sum of logs), n (trigrams) of each row: ``table`` has the counts, ``words`` place, w, p of uncommon words."""
    spark, passes = marked.sparkSession, []
    at = F.col("place") % deal.passes
    part = (F.col("place") / deal.passes).cast("int").alias("part")
    around = table.filter(F.col("kind") == AROUND).select(F.col("a").alias("u"), F.col("c").alias("v"), F.col("b").alias("w"), F.col("n").cast("double").alias("n"))
    kinds = {PAIR: (_pairs(table.filter(F.col("kind") == PAIR), deal), ("v", "w", "n")), WORD: (words.withColumnRenamed("p", "n"), ("w", "n"))}
    for number in range(deal.passes):
        rows = _packed(marked, deal, number)
        for kind, (df, columns) in kinds.items():
            rows = rows.unionByName(df.filter(at == number).select(part, F.lit(kind).alias("kind"), *columns), allowMissingColumns=True)
        if model.value.unknown:
            each = around.crossJoin(F.broadcast(spark.range(deal.parts).select(F.col("id").cast("int").alias("part"))))
            rows = rows.unionByName(each.withColumn("kind", F.lit(AROUND)), allowMissingColumns=True)
        sums = rows.groupBy("part").applyInArrow(_score(deal, model), _SCORES).groupBy("at").applyInArrow(_sum, "row long, total double, n long")
        passes.append(stored(sums, free=True))
    return reduce(DataFrame.union, passes).groupBy("row").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
