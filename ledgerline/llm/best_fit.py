"""Best-fit-decreasing packing of documents into sequences of a fixed length.

Documents are tokenised, ended by an end token and cut into pieces only where they are
longer than a sequence. Pieces are placed from the longest to the shortest, each into the
open sequence with the least room that is enough, which a segment tree over remaining
capacities finds in a number of steps that is logarithmic in the capacity. Pieces of equal
length are alike, so the driver packs the counts of the lengths, of which there are no more
than a sequence has tokens: sequences of equal room lie in runs, and a step places as many
pieces as a run takes. Pieces then find their place by their number among those of their
length, each task by itself.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_map, sized, texts
from ledgerline.sources.shared import stored


@dataclass(frozen=True)
class Packing:
    """``path`` is the tokenizer file, at the same place on every executor. Tables of up to ``broadcast_rows`` rows go to all tasks."""

    path: str
    length: int = 1024
    end_token: int = 2
    broadcast_rows: int = 500_000


class CapacityTree:
    """Segment tree over capacities 0 to ``capacity``: how many open sequences have each as their room, and which runs they are."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.base)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, first: int, n: int) -> None:
        """``n`` open sequences from number ``first`` on; those without room are closed."""
        if room and n:
            self.runs[room].append((first, n))
            self._change(room, n)

    def _change(self, room: int, by: int) -> None:
        node, count = room + self.base, self.count
        while node:
            count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The least room of an open sequence that is ``need`` or more."""
        node, count = need + self.base, self.count
        while not count[node]:  # climb until a subtree to the right has an open sequence
            while node & 1:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
        while node < self.base:
            node *= 2
            if not count[node]:
                node += 1
        return node - self.base

    def take(self, room: int) -> tuple[int, int]:
        """A run (first, n) of sequences with this room, which is closed."""
        first, n = self.runs[room].pop()
        self._change(room, -n)
        return first, n


def plan(counts: Mapping[int, int], capacity: int) -> dict[int, np.ndarray]:
    """How the pieces of each length are placed: rows of (number of the first piece, its sequence, pieces a sequence takes, offset).

    The pieces of a row fill its sequences one after the other. What comes out is best-fit
    decreasing: after a piece of its length a sequence is tighter than all others that can
    take one more, so it takes as many as it can.
    """
    tree, used, rows = CapacityTree(capacity), 0, {}
    for length in sorted(counts, reverse=True):
        own, left, rank = rows.setdefault(length, []), counts[length], 0
        while left:
            room = tree.tightest(length)
            first, n = (used, left) if room is None else tree.take(room)
            if room is None:
                room = capacity
            each = room // length
            some = min(n, -(-left // each))
            if first == used:
                used += some
            else:
                tree.add(room, first + some, n - some)
            placed = min(left, some * each)
            full, rest = divmod(placed, each)
            own.append((rank, first, each, capacity - room))
            tree.add(room - each * length, first, full)
            tree.add(room - rest * length, first + full, 1 if rest else 0)
            left, rank = left - placed, rank + placed
    return {length: np.array(own, np.int64) for length, own in rows.items()}


def places(rows: np.ndarray, ranks: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the pieces of a length, by their numbers."""
    start, first, each, offset = rows[np.searchsorted(rows[:, 0], ranks, side="right") - 1].T
    return first + (ranks - start) // each, offset + (ranks - start) % each * length


def best_fit(lengths: Iterable[int], capacity: int) -> tuple[list[int], list[int]]:
    """(sequence, offset) of each length."""
    lengths = list(lengths)
    rows, seen, out = plan(Counter(lengths), capacity), Counter(), []
    for n in lengths:
        out.append([int(x[0]) for x in places(rows[n], np.array([seen[n]]), n)])
        seen[n] += 1
    return [s for s, _ in out], [o for _, o in out]


class Encoder:
    """Ids of the byte-level vocabulary, by the library that reads its merges as ranks."""

    def __init__(self, path: str):
        import json

        import tiktoken

        from ledgerline.llm.bpe_automaton import byte_symbols

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes([byte_of[c] for c in s]): i for s, i in spec["model"]["vocab"].items() if s not in special}
        self.model = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.special, self.path, self.library = set(special), path, None

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.model.encode_to_numpy(text, allowed_special=self.special)
        except ValueError:  # its pattern runs out of stack on about a million white-space characters in a row
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
                self.library.no_truncation()
                self.library.no_padding()
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


# Fixed value: how the byte-level vocabulary splits text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def cut_points(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces; only a first piece may be shorter than ``most``."""
    first = length % most or most
    return [(0, first), *[(at, most) for at in range(first, length, most)]]


def pieces(docs: DataFrame, p: Packing, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, binary) of the pieces of every document.

    ``part`` and ``rank`` number the pieces of each length within the task that made them.
    """
    names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", *(["ids"] if with_ids else []))

    def make():
        encoder, part, seen = Encoder(p.path), TaskContext.get().partitionId(), Counter()

        def work(batch: pa.RecordBatch) -> dict:
            out = {k: [] for k in names}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                ids = np.append(encoder.encode(text), np.uint32(p.end_token)).astype("<u4")
                for i, (start, length) in enumerate(cut_points(len(ids), p.length)):
                    own = ids[start:start + length].tobytes()
                    for k, v in zip(names, (doc_id, i, start, length, zlib.crc32(own), part, seen[length], own)):
                        out[k].append(v)
                    seen[length] += 1
            return out

        return work

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + (", ids binary" if with_ids else "")
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), schema, make)


def pack(cut: DataFrame, p: Packing) -> DataFrame:
    """``cut`` (stored; length, part, rank) with sequence_id and offset by best-fit decreasing over all its rows.

    The pieces of each task and length are counted, earlier tasks' counts are added up, and
    the driver gets one count a length.
    """
    own = stored(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    rows = plan({r.length: r.n for r in own.groupBy("length").agg(F.sum("n").alias("n")).collect()}, p.length)
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    before = stored(own.select("length", "part", earlier.alias("before")))
    numbered = cut.join(sized(before, p.broadcast_rows), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "part")
    kept = [c for c in numbered.columns if c != "rank"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                mine = np.flatnonzero(length == n)
                sequence[mine], offset[mine] = places(rows[n], rank[mine], n)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    kinds = dict(numbered.dtypes)
    return numbered.mapInArrow(work, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", sequence_id bigint, offset bigint")


def packed(docs: DataFrame, p: Packing) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Sequences are numbered from 0 without gaps. A null or empty text is one end token.
    Repeated rows are packed each, an empty table gives no rows, and columns other than
    doc_id and text are not read.
    """
    return pack(stored(pieces(docs, p, with_ids=False)), p).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, p: Packing) -> DataFrame:
    """sequence_id and ids (binary, little-endian 32-bit): the packed sequences themselves."""
    placed = pack(stored(pieces(docs, p)), p)
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # one sequence's pieces
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
