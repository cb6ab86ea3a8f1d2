"""Language-model score of a text: the marginal probability over all its segmentations.

The vocabulary is an existing one of subword pieces. Piece scores are unigram
log-probabilities estimated from the training words as the vocabulary's own tokenizer
segments them. A word's probability sums over every way to write it in pieces, by a
forward recursion over its characters in log space; a text's is the product over its
words and one end.

Counts are kept by word: each task counts its words, the counts are summed by one
exchange, and a word's lattice is computed once. Documents look the most frequent words
up in a table of bounded size; their other words are joined with the counts.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_map, arrow_totals, texts
from ledgerline.sources.shared import stored

GAP = "▁"  # the vocabulary's mark of a word's start
_NONE = float("-inf")


@dataclass(frozen=True)
class Lattice:
    """``path`` is the vocabulary file, at the same place on every executor.

    ``frequent`` words of at most ``frequent_chars`` characters are looked up in each
    task (so the table has a bounded size); all others are joined. ``smoothing`` is added
    to each piece's count. A character that no piece has costs ``unknown_bits`` bits.
    A task passes counts on when it holds ``held_words`` distinct words.
    """

    path: str
    frequent: int = 100_000
    frequent_chars: int = 32
    smoothing: float = 0.1
    unknown_bits: float = 21.0
    held_words: int = 400_000


class Pieces:
    """Log-probabilities of pieces and of the end, and the forward recursion."""

    def __init__(self, scores: dict[str, float], end: float, unknown: float):
        self.scores, self.end, self.unknown = scores, end, unknown
        self.longest = max(map(len, scores), default=1)

    def log_probability(self, word: str) -> float:
        """Natural log of the word's probability, summed over its segmentations."""
        word = GAP + word
        scores, longest, exp = self.scores, self.longest, math.exp
        forward = [0.0]
        for end in range(1, len(word) + 1):
            terms = []
            for start in range(max(0, end - longest), end):
                score = scores.get(word[start:end])
                if score is not None:
                    terms.append(forward[start] + score)
            if not terms or word[end - 1:end] not in scores:
                terms.append(forward[end - 1] + self.unknown)
            top = max(terms)
            forward.append(top if len(terms) == 1 else top + math.log(sum([exp(t - top) for t in terms])))
        return forward[-1]


def lower_words(text: str) -> list[bytes]:
    """Words between ASCII white space, with A to Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def count_words(docs: DataFrame, training: Column, held_words: int) -> DataFrame:
    """word, c: how often each word of all documents occurs in the training documents (0 where only elsewhere)."""
    rows = docs.select("text", training.alias("training"))

    def make():
        inside, outside = Counter(), set()

        def add(batch):
            for text, learn in zip(texts(batch), batch.column("training").to_pylist()):
                (inside if learn else outside).update(lower_words(text))

        def take(last):
            if not last and len(inside) + len(outside) < held_words:
                return None
            out = {"word": [w.decode("utf-8", "replace") for w in inside], "c": list(inside.values())}
            rest = [w.decode("utf-8", "replace") for w in outside if w not in inside]
            out = {"word": out["word"] + rest, "c": out["c"] + [0] * len(rest)}
            inside.clear()
            outside.clear()
            return out

        return add, take

    return arrow_totals(rows, "word string, c long", make).groupBy("word").agg(F.sum("c").alias("c"))


def learn_pieces(counts: DataFrame, ends: int, p: Lattice) -> Pieces:
    """Piece log-probabilities from counted words; ``ends`` is the number of training documents."""
    path = p.path

    def make():
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        total = np.zeros(model.vocab_size(), np.int64)

        def add(batch):
            weights = batch.column("c").to_numpy()
            ids = model.encode(batch.column("word").to_pylist(), num_threads=1)
            if flat := [i for one in ids for i in one]:
                np.add.at(total, flat, np.repeat(weights, [len(one) for one in ids]))

        def take(last):
            return {"piece": np.arange(len(total)), "n": total} if last else None

        return add, take

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    total = np.zeros(size)
    for r in arrow_totals(counts.filter("c > 0"), "piece long, n long", make).groupBy("piece").agg(F.sum("n").alias("n")).collect():
        total[r.piece] = r.n  # a row per piece of the vocabulary
    usable = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    mass = math.log(total[usable].sum() + ends + p.smoothing * (len(usable) + 1))
    scores = {model.id_to_piece(i): math.log(total[i] + p.smoothing) - mass for i in usable}
    return Pieces(scores, math.log(ends + p.smoothing) - mass, -p.unknown_bits * math.log(2) + math.log(p.smoothing) - mass)


def with_lattice(counts: DataFrame, pieces: Pieces) -> DataFrame:
    """word, c, base (log10 of c + 1) and lattice (natural log of the word's probability)."""
    shared = counts.sparkSession.sparkContext.broadcast(pieces)  # the vocabulary's size

    def make():
        model = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            return {"word": batch.column("word"), "c": batch.column("c"), "base": np.log10(batch.column("c").to_numpy() + 1.0),
                    "lattice": [model.log_probability(w) for w in batch.column("word").to_pylist()]}

        return work

    return arrow_map(counts.select("word", "c"), "word string, c long, base double, lattice double", make)


_LOOKED_UP = ("row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, lattice double, "
              "rest array<struct<word:string,n:long>>")


def score_documents(docs: DataFrame, training: Column, p: Lattice) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Words are maximal runs without ASCII white space, A to Z lower-cased; one end follows
    each text. ``base_score`` is the add-one unigram score of words; ``score`` is the
    lattice's log10 probability. A null text is empty and has its end only. Repeated rows
    and ids are scored each, without training documents all counts are 0, and columns
    other than doc_id, text and those in ``training`` are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text", training.alias("training"))
    counts = stored(count_words(rows, F.col("training"), p.held_words))
    sums = counts.filter("c > 0").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = rows.filter("training").count()
    n, v = (sums.n or 0) + ends, sums.v + (1 if ends else 0)
    pieces = learn_pieces(counts, ends, p)
    short = counts.filter(F.length("word") <= p.frequent_chars)
    top = with_lattice(short.orderBy(F.desc("c"), "word").limit(p.frequent), pieces).toArrow().to_pandas()  # bounded by both limits
    table = {w.encode(): i for i, w in enumerate(top["word"])}
    shared = spark.sparkContext.broadcast((table, top["c"].to_numpy() > 0, top["base"].to_numpy(), top["lattice"].to_numpy()))
    least_base = math.log10(n + v + 1)
    end = (math.log10(ends + 1) - least_base, pieces.end)

    def make():
        place, known, base, lattice = shared.value
        first = TaskContext.get().partitionId() << 36
        seen = 0

        def work(batch: pa.RecordBatch) -> dict:
            nonlocal seen
            out = {k: [] for k in ("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "lattice", "rest")}
            for doc_id, text, learn in zip(batch.column("doc_id").to_pylist(), texts(batch), batch.column("training").to_pylist()):
                words = lower_words(text)
                at = [place.get(w, -1) for w in words]
                found = np.array(at, np.int64)
                hit = found[found >= 0]
                rest = Counter([w for w, i in zip(words, at) if i < 0]) if len(hit) < len(words) else {}
                out["row"].append(first + seen)
                out["doc_id"].append(doc_id)
                out["held_out"].append(not learn)
                out["n_tokens"].append(len(words) + 1)
                out["n_known"].append(int(known[hit].sum()) + (1 if ends else 0))
                out["base"].append(float(base[hit].sum()) - len(words) * least_base + end[0])
                out["lattice"].append(float(lattice[hit].sum()) + end[1])
                out["rest"].append([{"word": w.decode("utf-8", "replace"), "n": c} for w, c in rest.items()])
                seen += 1
            return out

        return work

    looked = stored(arrow_map(rows, _LOOKED_UP, make))
    others = looked.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.n")
    joined = others.join(with_lattice(counts, pieces), "word")
    part = joined.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
                                     F.sum(F.col("n") * F.col("base")).alias("more_base"), F.sum(F.col("n") * F.col("lattice")).alias("more_lattice"))
    zero = {k: F.coalesce(k, F.lit(0)) for k in ("more_known", "more_base", "more_lattice")}
    whole = looked.drop("rest").join(part, "row", "left").withColumns(zero)
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("more_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                        (F.col("base") + F.col("more_base")).alias("base_score"),
                        ((F.col("lattice") + F.col("more_lattice")) / math.log(10)).alias("score"))
