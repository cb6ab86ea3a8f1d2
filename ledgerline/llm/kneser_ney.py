"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

All trusted text is counted. ``classify`` deals the trigrams of trusted text and of documents
into parts by their middle word and joins them there (``ngram_shards.py``), so that no table of
all trigrams is kept. ``train`` makes such tables, for a model that is used again: counts and
discounts come from grouped sums and joins on the n-gram keys, and ``perplexities`` joins the
distinct trigrams of each document with them. Both give the same perplexities.
A document is kept if its perplexity is within a quantile of all documents of its language.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import ngram_shards
from ledgerline.llm.common import arrow_map, shuffle_partitions, sized, texts
from ledgerline.llm.ngram_shards import END, START, UNKNOWN, hashed_words
from ledgerline.sources.shared import stored

_FIRST_WORD = 3
_MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class KneserNey:
    """Parameters.

    Words of more than ``word_bytes`` bytes count as unknown. ``quantile`` is the share of
    each language's documents whose perplexity is accepted. Tables of words of up to
    ``broadcast_rows`` rows are sent to all tasks, larger ones are joined.

    Without tables of all trigrams, parts of up to ``part_words`` trigrams are done in ``passes``
    passes over slices of ``slice_bytes`` bytes of text; none of these changes a result.
    """

    word_bytes: int = 64
    quantile: float = 0.99
    broadcast_rows: int = 1_000_000
    passes: int = 6
    part_words: int = 2_000_000
    slice_bytes: int = 8 << 20


@dataclass
class Tables:
    """Stored tables of natural logs; words are known by a 64-bit hash.

    ``p3`` has the probabilities of the trigrams seen, ``w2`` the back-off weights of their
    contexts, ``p2`` and ``w1`` those of bigrams, ``p1`` those of words and ``rest`` that of
    a word not in it. ``unknown`` tells if unknown words occur in the text.
    """

    sample: DataFrame
    p: KneserNey
    p3: DataFrame
    w2: DataFrame
    p2: DataFrame
    w1: DataFrame
    p1: DataFrame
    rest: float
    unknown: bool

    @cached_property
    def words(self) -> dict[bytes, int]:
        """Numbers of the words, for looking at small models; nothing here needs them."""
        found = {w for r in self.sample.select("text").toLocalIterator() for w in lower_words(r.text) if len(w) <= self.p.word_bytes}
        return {w: i for i, w in enumerate(sorted(found), _FIRST_WORD)}


def lower_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _grams(docs: DataFrame, p: KneserNey) -> DataFrame:
    """The distinct trigrams (u, v, w) of each row with their number n; one of a row's has its doc_id and lang."""
    def make():
        context = TaskContext.get()
        first, seen = context.partitionId() << 36, 0

        def work(batch: pa.RecordBatch) -> dict:
            nonlocal seen
            data = [t.encode("utf-8", "surrogatepass") for t in texts(batch)]
            begins = np.concatenate(([0], np.cumsum([len(d) + 1 for d in data])))
            start, h = hashed_words(b" ".join(data), p.word_bytes)
            doc = np.searchsorted(begins, start, side="right") - 1
            n = np.bincount(doc, minlength=len(data))
            ends = np.cumsum(n + 3)
            ids = np.full(int(ends[-1]), START, np.int64)
            ids[np.arange(len(h)) + 3 * doc + 2] = h
            ids[ends - 1] = END
            of = np.repeat(np.arange(len(data)), n + 3)
            keep = np.flatnonzero(of[2:] == of[:-2])  # no trigram goes over two documents
            u, v, w, of = ids[keep], ids[keep + 1], ids[keep + 2], of[keep]
            with np.errstate(over="ignore"):
                key = np.zeros(len(u), np.uint64)
                for x in (of, u, v, w):
                    key = (key ^ (key >> np.uint64(32))) * _MIX + x.view(np.uint64)
                key = (key ^ (key >> np.uint64(31))) * _MIX
            _, at, times = np.unique(key, return_index=True, return_counts=True)
            order = np.argsort(at)
            at, times = at[order], times[order]
            leads = np.concatenate(([True], of[at][1:] != of[at][:-1]))
            whose = pa.array(of[at], mask=~leads)
            rows = first + seen + of[at]
            seen += len(data)
            return {"row": rows, "u": u[at], "v": v[at], "w": w[at], "n": times.astype(np.int32),
                    "doc_id": batch.column("doc_id").take(whose), "lang": batch.column("lang").take(whose)}

        return work

    return arrow_map(docs, "row long, u long, v long, w long, n int, doc_id long, lang string", make)


def _sample(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The documents that the model is trained on."""
    ids = trusted.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()
    mine = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mine.join(ids, "doc_id", "left_semi")


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three modified discounts from the counts of counts (column c)."""
    return _cuts({r.c: r.n for r in counts.filter("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()})


def _cuts(n: dict[int, int]) -> tuple[float, float, float]:
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5)
    return tuple(min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1))


def _off(d: tuple[float, float, float]) -> Column:
    return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])


def _level(counts: DataFrame, context: list[str], below: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(logs of the interpolated probabilities, logs of the back-off weights by context), stored; ``below`` has the level below."""
    off = _off(_discounts(counts))
    totals = stored(counts.groupBy(*context).agg(F.sum("c").alias("total"), F.sum(off).alias("off")))
    joined = counts.join(totals.withColumn("weight", F.col("off") / F.col("total")).drop("off"), context).join(below, key)
    p = (F.col("c") - off) / F.col("total") + F.col("weight") * F.exp("lower")
    return stored(joined.select(*context, "w", F.log(p).alias("lp"))), totals.select(*context, F.log(F.col("off") / F.col("total")).alias("lw"))


def _words(uni: DataFrame) -> tuple[DataFrame, float, bool]:
    """(``uni`` (w, c) with p, the probability of a word not in it, whether unknown words occur)."""
    off = _off(_discounts(uni))
    known = F.count_if(~F.col("w").isin(END, UNKNOWN))
    sums = uni.agg(F.sum("c").alias("total"), F.sum(off).alias("off"), known.alias("words"), F.count_if(F.col("w") == UNKNOWN).alias("unknown")).first()
    possible = sums.words + _FIRST_WORD - 1  # all but the start; unknown stands for one word more
    rest = sums.off / sums.total / possible if sums.total else 1.0 / possible
    return uni.withColumn("p", (F.col("c") - off) / F.lit(float(sums.total or 1)) + F.lit(rest)), rest, bool(sums.unknown)


def train(docs: DataFrame, trusted: DataFrame, p: KneserNey = KneserNey()) -> Tables:
    """Model of the texts of the documents whose ids are in ``trusted``; without any, all words are equally likely."""
    sample = _sample(docs, trusted)
    grams = _grams(sample.withColumn("lang", F.lit(None).cast("string")), p)
    tri = stored(grams.groupBy("u", "v", "w").agg(F.sum("n").alias("c")))
    bi = stored(tri.groupBy("v", "w").agg(F.count(F.lit(1)).alias("c")))  # continuation counts
    uni = stored(bi.groupBy("w").agg(F.count(F.lit(1)).alias("c")))
    p1, rest, unknown = _words(uni)
    p1 = stored(p1.select("w", F.log("p").alias("lp")))
    p2, w1 = _level(bi, ["v"], sized(p1, p.broadcast_rows).withColumnRenamed("lp", "lower"), ["w"])
    p3, w2 = _level(tri, ["u", "v"], p2.withColumnRenamed("lp", "lower"), ["v", "w"])
    return Tables(sample, p, p3, w2, p2, w1, p1, math.log(rest), unknown)


def _logs(grams: DataFrame, t: Tables) -> DataFrame:
    """``grams`` with ``log``, the natural log of p(w | u, v)."""
    named = lambda df, **to: df.withColumnsRenamed(to)
    small = lambda df: sized(df, t.p.broadcast_rows)
    p1 = small(t.p1)
    if t.unknown:  # otherwise a word that is not in the tables has no entries, as unknown has none
        for x in ("u", "v", "w"):
            own = p1.select(F.col("w").alias(x), F.lit(True).alias("__known"))
            grams = grams.join(own, x, "left").withColumn(x, F.when((F.col("__known")) | F.col(x).isin(START, END), F.col(x)).otherwise(F.lit(UNKNOWN).cast("long"))).drop("__known")
    out = grams.join(named(t.p3, lp="lp3"), ["u", "v", "w"], "left")
    hit = F.col("lp3").isNotNull()  # what is found goes on under keys of its own row, which fill no partition
    out = out.select("*", *(F.when(hit, F.col("row")).otherwise(F.col(x)).alias(f"__{x}") for x in "uvw")).drop("u", "v", "w")
    out = out.join(named(t.w2, u="__u", v="__v", lw="lw2"), ["__u", "__v"], "left").drop("__u")
    out = out.join(named(t.p2, v="__v", w="__w", lp="lp2"), ["__v", "__w"], "left")
    out = out.join(named(small(t.w1), v="__v", lw="lw1"), "__v", "left").join(named(p1, w="__w", lp="lp1"), "__w", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    back = zero("lw2") + F.coalesce("lp2", zero("lw1") + F.coalesce("lp1", F.lit(t.rest)))
    return out.withColumn("log", F.coalesce("lp3", back))


def log_probabilities(t: Tables, ids: np.ndarray) -> np.ndarray:
    """Natural logs for each id (of ``t.words``) after the first two, which are context only."""
    spark, words = t.p3.sparkSession, list(t.words)
    hashes = np.concatenate(([START, END, UNKNOWN], hashed_words(b" ".join(words), t.p.word_bytes)[1])).astype(np.int64)
    h = hashes[ids].tolist()
    grams = spark.createDataFrame([(i, *x) for i, x in enumerate(zip(h, h[1:], h[2:]))], "row long, u long, v long, w long")
    found = {r.row: r.log for r in _logs(grams, t).select("row", "log").collect()}
    return np.array([found[i] for i in range(len(found))])


def perplexities(docs: DataFrame, tables: Tables) -> DataFrame:
    """doc_id, lang, n_tokens (words and one end), perplexity of every document."""
    grams = _grams(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"), tables.p)
    sums = _logs(grams, tables).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("lang").alias("lang"), F.sum("n").alias("n_tokens"),
                                                   F.sum(F.col("n") * F.col("log")).alias("total"))
    return sums.select("doc_id", "lang", "n_tokens", F.exp(-F.col("total") / F.col("n_tokens")).alias("perplexity"))


def _heavy(rows: DataFrame, p: KneserNey) -> tuple[np.ndarray, np.ndarray]:
    """(sorted words that have more than ``part_words`` trigrams around them, the number of pieces of each)."""
    found = rows.filter("v IS NOT NULL").groupBy("v").agg(F.sum("n").alias("n")).filter(F.col("n") > p.part_words).orderBy("v").collect()
    return np.array([r.v for r in found], np.int64), np.array([-(-r.n // p.part_words) for r in found], np.int64)


def _common(words: DataFrame, p: KneserNey) -> DataFrame:
    """The words (w, p) of the largest counts, up to ``broadcast_rows`` of them, and unknown."""
    least, seen = 0, 0
    for r in words.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).toLocalIterator():
        seen += r.n
        if seen > p.broadcast_rows:
            least = r.c + 1
            break
    return words.filter((F.col("c") >= least) | (F.col("w") == UNKNOWN)).select("w", "p")


def _place(row: str) -> tuple[Column, Column]:
    """(number of the group of 64 rows that a row is in, as ``at``; the bit that stands for the row there)."""
    return F.shiftright(row, 6).alias("at"), F.expr(f"shiftleft(1L, cast({row} & 63 AS int))")


def _marked(docs: DataFrame, bits: DataFrame) -> DataFrame:
    """text and trusted of each row, in the order of ``docs``; ``bits`` (at, bits) has a bit for each trusted row.

    The rows keep their places, as ``bits``, with one row for up to 64 of them, is sent to all tasks.
    """
    numbered = docs.select("text", F.monotonically_increasing_id().alias("__id"))
    row = F.shiftleft(F.shiftright("__id", 33), ngram_shards.PLACE_BITS) + F.col("__id").bitwiseAND((1 << 33) - 1)
    group, bit = _place("__row")
    found = numbered.select("text", row.alias("__row")).withColumn("at", group).join(F.broadcast(bits.select("at", "bits")), "at", "left")
    return found.select("text", (F.col("text").isNotNull() & (F.coalesce("bits", F.lit(0)).bitwiseAND(bit) != 0)).alias("trusted"))


def perplexities_by_parts(docs: DataFrame, trusted: DataFrame, p: KneserNey = KneserNey()) -> DataFrame:
    """What ``perplexities(docs, train(docs, trusted, p))`` gives, without tables of all trigrams.

    ``docs`` is read several times and has to give the same rows in the same order, as files do; that
    all trigrams of a row came to it is checked at the end.
    """
    spark = docs.sparkSession
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    ids = stored(trusted.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), free=True)
    rows = stored(ngram_shards.documents(mine, p.slice_bytes, p.word_bytes), free=True)
    total = rows.filter("row IS NOT NULL").agg(F.sum("n")).first()[0] or 0
    parts = max(min(2 * shuffle_partitions(spark), 512), -(-total // (p.passes * p.part_words)))
    deal = ngram_shards.Deal(p.passes, parts, *_heavy(rows, p), p.slice_bytes, p.word_bytes, max(1, p.part_words // 4))

    own = rows.filter("row IS NOT NULL").join(sized(ids, p.broadcast_rows), "doc_id", "left_semi")
    bits = stored(own.groupBy(*_place("row")[:1]).agg(F.bit_or(_place("row")[1]).alias("bits"), F.sum("n").alias("n")), free=True)
    marked = _marked(docs, bits)
    share = (bits.agg(F.sum("n")).first()[0] or 0) / max(total, 1)
    table = ngram_shards.counts(marked, deal, max(1, math.ceil(p.passes * share / 2)))  # as nothing is sent back, half the passes do
    sizes = {k: {r.a: r.n for r in table.filter(F.col("kind") == k).groupBy("a").agg(F.sum("n").alias("n")).collect()}
             for k in (ngram_shards.TRI_SIZES, ngram_shards.BI_SIZES)}
    uni = stored(table.filter(F.col("kind") == ngram_shards.LAST).groupBy(F.col("a").alias("w")).agg(F.sum("n").alias("c")), free=True)
    words, rest, unknown = _words(uni)
    common = _common(words, p).toArrow().sort_by("w")
    model = spark.sparkContext.broadcast(ngram_shards.Model(*(_cuts(n) for n in sizes.values()), common["w"].to_numpy(), common["p"].to_numpy(), rest, unknown))
    rare = ngram_shards.uncommon(docs.select("text"), deal, model).distinct().join(words.select("w", "p"), "w")
    scores = ngram_shards.scored(marked, table, stored(rare.select("place", "w", "p"), free=True), deal, model)
    out = rows.filter("row IS NOT NULL").withColumnRenamed("n", "n_tokens").join(scores, "row", "left")
    whole = F.when(F.col("n") == F.col("n_tokens"), F.exp(-F.col("total") / F.col("n"))).otherwise(F.raise_error(F.lit("docs gave other rows when read again")).cast("double"))
    return out.select("doc_id", "lang", "n_tokens", whole.alias("perplexity"))


def classify(docs: DataFrame, trusted: DataFrame, p: KneserNey = KneserNey()) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity, threshold, kept of every document.

    ``trusted`` has the ids of trusted documents. The threshold is the quantile of all
    documents of the same language (null is a language of its own). A null text is empty
    and has an end only; repeated rows are judged each; without trusted text every word
    is equally likely and all documents are kept.
    """
    scored = stored(perplexities_by_parts(docs, trusted, p), free=True)
    level = scored.groupBy("lang").agg(F.percentile_approx("perplexity", p.quantile, 10_000).alias("threshold"))
    joined = scored.join(level.withColumnRenamed("lang", "__l"), F.col("lang").eqNullSafe(F.col("__l"))).drop("__l")
    return joined.withColumn("kept", F.col("perplexity") <= F.col("threshold"))


def trusted_ids() -> Column:
    """Condition for labels of trusted documents: of good quality and not toxic."""
    return (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
