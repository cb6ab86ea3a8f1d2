"""BPE encoding and decoding with a deterministic automaton over tokens.

The automaton starts with one state in which every byte symbol loops. Merge rules are
built in one by one, each by its gadget: for a merge of u and v into x, the state behind
u is replaced, for u only, by a copy without the arc v, and x becomes an arc wherever u
is one, leading where v led. What the finished automaton accepts are exactly the token
sequences that the merges produce, one for each word, so that a walk over a word's
characters finds its tokens by looking transitions up.

Copies are kept as differences: a state behind token t is the list of arcs that gadgets
took from it, with the time of each, and the state it was copied from at t's own merge.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_map, texts

# Fixed value: how the public word-end vocabulary splits normalised text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"

_NEVER = 1 << 60
_START = -1
#: Bounds of what a worker remembers: transitions looked up, and words encoded.
TABLE_ENTRIES, WORD_ENTRIES = 1 << 20, 400_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


@dataclass
class MergeAutomaton:
    """Compiled merges. ``labels[t]`` is what token t spells (with the word end, if it has one)."""

    vocab: dict[str, int]
    merges: Sequence[tuple[str, str]]
    word_end: str = ""
    labels: dict[int, str] = field(default_factory=dict)

    def __post_init__(self):
        self.labels = {i: s for s, i in self.vocab.items()}
        self.taken: dict[int, dict[int, int]] = {}  # behind token u: arc v -> time of its removal
        self.heads: dict[int, list[tuple[int, int]]] = {}  # token -> (it or a token it begins with, until when it was an arc of its own)
        self.tails: dict[int, list[tuple[int, int]]] = {}  # token -> (it or a token it ends with, until when states behind it were its own)
        self.arcs: set[int] = set()
        self.table: dict[int, bool] = {}
        made = {u + v for u, v in self.merges}
        for s, t in self.vocab.items():
            if s not in made:
                self.heads[t] = self.tails[t] = [(t, _NEVER)]
                self.arcs.add(t)
        for time, (left, right) in enumerate(self.merges):
            self._gadget(self.vocab[left], self.vocab[right], self.vocab[left + right], time)
        self.longest = max((len(self.labels[t]) for t in self.arcs), default=1)

    def _gadget(self, u: int, v: int, x: int, time: int) -> None:
        self.heads[x] = [(x, _NEVER)] + [(t, min(time, until)) for t, until in self.heads[u]]
        self.tails[x] = [(x, _NEVER)] + [(t, min(time, until)) for t, until in self.tails[v]]
        if u in self.arcs and v in self.arcs and self._joined(u, v):  # else no word ever has u before v
            self.arcs.add(x)
            self.taken.setdefault(u, {})[v] = time

    def _joined(self, last: int, token: int) -> bool:
        """Whether the state behind ``last`` has the arc ``token``."""
        for t, until in self.tails[last]:
            if gone := self.taken.get(t):
                for h, grown in self.heads[token]:
                    time = gone.get(h)
                    # an arc grown from one that is gone by then is gone too
                    if time is not None and time < until and time <= grown:
                        return False
        return True

    def has_arc(self, last: int, token: int) -> bool:
        """The transition table, filled as it is used."""
        if last == _START:
            return True
        key = last << 32 | token
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= TABLE_ENTRIES:
                self.table.clear()
            found = self.table[key] = self._joined(last, token)
        return found

    def encode(self, word: str) -> list[int]:
        """Ids of one pre-split word, given in byte symbols.

        From each place the longest token with a transition is taken first. No two walks
        lead to one place, so a place from which the end is not reached is left for good.
        """
        n, vocab, arcs, longest, end = len(word), self.vocab, self.arcs, self.longest, self.word_end
        out, starts, lost = [], [], set()
        at, last, to = 0, _START, min(n, longest)
        while at < n:
            while to > at:
                t = vocab.get(word[at:to] + end if to == n else word[at:to])
                if t is not None and t in arcs and to not in lost and self.has_arc(last, t):
                    break
                to -= 1
            if to > at:
                out.append(t)
                starts.append(at)
                at, last, to = to, t, min(n, to + longest)
            elif out:
                lost.add(at)
                out.pop()
                at, to = starts.pop(), at - 1
                last = out[-1] if out else _START
            else:
                raise ValueError("a symbol of the word is not in the vocabulary")
        return out


class WordBpe:
    """Normalising, splitting, encoding and decoding with a word-end BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], pairs, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = {**self.automaton.labels, **{i: s for s, i in self.special.items()}}
        self.split = regex.compile(WORD_PATTERN)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.symbols = byte_symbols()
        self.known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        if len(self.known) >= WORD_ENTRIES:
            self.known.clear()
        ids = self.automaton.encode("".join([self.symbols[b] for b in word.encode("utf-8")]))
        found = array("I", ids).tobytes()
        if len(word) <= 64:
            self.known[word] = found
        return found

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            # a capital sigma is lower-cased alike at any place of a word
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        known, word = self.known.get, self._word
        return b"".join([known(w) or word(w) for w in self.split.findall(text.lower())])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Special tokens in the text are found first."""
        if self.marks is None or not any(s in text for s in self.special):
            return self._plain(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [self._plain(text[at:m.start()]), array("I", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The arc labels of the ids, with a space between them."""
        labels = self.labels
        return " ".join([labels[i] for i in array("I", ids)])


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian 32-bit), decoded text of every document.

    ``path`` is the vocabulary file, at the same place on every executor. A null text is
    empty and has no ids; repeated rows are encoded each; only doc_id and text are read.
    """
    def make():
        bpe = WordBpe(path)

        def work(batch: pa.RecordBatch) -> dict:
            ids = [bpe.encode(t) for t in texts(batch)]
            return {"doc_id": batch.column("doc_id"), "ids": ids, "decoded": [bpe.decode(i) for i in ids]}

        return work

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, ids binary, decoded string", make)


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of :func:`encoded`, digested where they are made."""
    def make():
        bpe = WordBpe(path)

        def work(batch: pa.RecordBatch) -> dict:
            out = {"doc_id": batch.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for t in texts(batch):
                ids = bpe.encode(t)
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            return out

        return work

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"),
                     "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
