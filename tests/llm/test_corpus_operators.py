"""Language, lattice, outliers, near-duplicates, n-gram model and pipeline against brute force."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import kneser_ney, language_centroids, ngram_shards, order_minhash, robust_outliers, subword_lattice
from ledgerline.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile("[^\x20\x09-\x0d]+")


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- language ---------------------------------------------------------------------

def test_language_is_learned_and_told(spark, sf_dir):
    docs = documents(spark, sf_dir)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "123 !? 456"), (-4, "x"), (-1, None)], "doc_id long, text string")
    model = language_centroids.fit(docs, F.col("doc_id") % 5 != 0)
    out = language_centroids.identify(docs.select("doc_id", "text").union(odd).withColumn("score", F.lit("clash")), model).collect()
    found = defaultdict(list)
    for r in out:
        found[r.doc_id].append(r)
        assert 0 <= r.score <= 1
    for i in (-1, -2, -3):
        assert all(r.lang_pred == "und" and r.rejected for r in found[i])
    assert len(found[-1]) == 2 and found[-4][0].lang_pred != "und"
    held = [(r.lang, found[r.doc_id][0]) for r in docs.filter("doc_id % 5 = 0 AND length(text) > 20").collect()]
    assert sum(lang == r.lang_pred for lang, r in held) >= 0.97 * len(held)
    assert sum(r.rejected for _, r in held) <= 0.03 * len(held)
    far = spark.createDataFrame([(1, "zxqj kvwq " * 200)], "doc_id long, text string")
    assert language_centroids.identify(far, model).first().rejected
    assert language_centroids.fit(docs.limit(0), F.lit(True)) is None
    assert language_centroids.identify(docs.limit(3), None).filter("lang_pred = 'und' AND rejected").count() == 3


# --- lattice ----------------------------------------------------------------------

def test_forward_recursion_sums_all_segmentations():
    rng = random.Random(1)
    letters = "ab" + subword_lattice.GAP
    scores = {"".join(s): math.log(rng.random() / 10) for n in (1, 2, 3) for s in itertools.product(letters, repeat=n) if n == 1 or rng.random() < 0.6}
    pieces = subword_lattice.Pieces(scores, -1.0, -50.0)

    def total(s):
        return 1.0 if not s else sum(math.exp(scores[s[:i]]) * total(s[i:]) for i in range(1, len(s) + 1) if s[:i] in scores)

    for _ in range(50):
        word = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9)))
        assert math.isclose(pieces.log_probability(word), math.log(total(subword_lattice.GAP + word)), rel_tol=1e-9)
    assert pieces.log_probability("aXb") < -50
    assert math.isfinite(pieces.log_probability("ab" * 5000))


def test_scores_match_brute_force(spark):
    texts = ["The cat the Cat", "a\tb\x0bc\u00a0d \u2003e", None, "", "zzz qqq the", "the " * 50, "É é É", "x" * 3000]
    docs = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)] + [(0, texts[0], "m"), (None, "the", "m")], "doc_id long, text string, base string")
    for frequent in (1000, 2):
        p = subword_lattice.Lattice(public_tokenizers.path("piece_bpe_32k.model"), frequent=frequent, held_words=3)
        out = subword_lattice.score_documents(docs, F.coalesce(F.col("doc_id"), F.lit(0)) < 4, p).collect()
        rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "the")]
        lower = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in SPACE.findall(t or "")]
        counts = Counter(w for i, t in rows if (i or 0) < 4 for w in [*lower(t), "<end>"])
        n, v = sum(counts.values()), len(counts)
        want = sorted((-1 if i is None else i, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*lower(t), "<end>"]), 6),
                       sum(counts[w] > 0 for w in [*lower(t), "<end>"]), len(lower(t)) + 1) for i, t in rows)
        assert sorted((-1 if r.doc_id is None else r.doc_id, round(r.base_score, 6), r.n_known, r.n_tokens) for r in out) == want
        assert all(r.train_tokens == n and r.score < 0 and math.isfinite(r.score) for r in out)
        scores = {(r.doc_id, round(r.score, 6)) for r in out}
        assert len(scores) == len(rows) - 1  # equal texts, equal scores
    assert subword_lattice.score_documents(docs.limit(0), F.lit(True), p).count() == 0
    assert subword_lattice.score_documents(docs, F.lit(False), p).filter("n_known = 0 AND train_tokens = 0").count() == len(rows)


# --- outliers ---------------------------------------------------------------------

def brute_counts(text):
    text = text or ""
    words = SPACE.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i:i + 3])].append(i)
    covered = {i + d for at in windows.values() if len(at) > 1 for i in at for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_base_counts(spark, sf_dir):
    texts = [None, "", "a a a a", "x y z x y z q", "a b\na b\n \n\na b", "# * | <> &%$", "w " * 500, "é\u00a0è\u2003 z", "\t\x0b\x0c\r\n", "a b c d a b c"]
    texts += [r.text for r in documents(spark, sf_dir).collect()]
    docs = spark.createDataFrame([(i, t, None, "s", "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, kept string")
    out = robust_outliers.judge(docs).collect()
    assert len(out) == len(texts)
    for r in out:
        assert tuple(r[c] for c in robust_outliers.COUNTS) == brute_counts(texts[r.doc_id])
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and (not failed or not r.kept)
    assert robust_outliers.judge(docs.limit(0)).count() == 0


def numpy_distance(x, p):
    """The same estimate with numpy: medians, then concentration steps."""
    spread = np.array(p.least_spread)
    q = np.array([np.sort(x, axis=0)[[max(0, math.ceil(a * len(x)) - 1) for a in (0.25, 0.5, 0.75)], i] for i in range(5)])
    d2 = (((x - q[:, 1]) ** 2) / (((q[:, 2] - q[:, 0]) / 1.349) ** 2 + spread ** 2)).sum(axis=1)
    bins = lambda d: np.floor(32 * np.log2(1 + 16 * d))
    edge = lambda d, share: np.sort(bins(d))[math.ceil(share * len(d)) - 1]
    for _ in range(p.steps):
        part = x[bins(d2) <= edge(d2, p.share)]
        cov = np.cov(part.T, bias=True) + np.diag(spread ** 2)
        diff = x - part.mean(axis=0)
        d2 = np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff)
    return d2 / max((2 ** ((edge(d2, 0.5) + 0.5) / 32) - 1) / 16 / 4.351, 0.25)


def test_distances_match_numpy_and_reject_the_odd(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60, 400))) for _ in range(300)]
    texts += [" ".join("#%$&" + rng.choice(words) + "***" for _ in range(200)) for _ in range(6)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    p = robust_outliers.Outliers()
    out = sorted(robust_outliers.judge(docs, p).collect(), key=lambda r: r.doc_id)
    used = [r for r in out if not r.base_failed]
    n, chars, sym, dup, rep = (np.array([max(r[c], 1 if c in ("n_words", "word_chars") else 0) for r in used], float) for c in robust_outliers.COUNTS)
    x = np.stack([np.log(n), np.log(chars / n), np.log1p(1000 * sym / chars), np.log1p(dup) / np.log1p(n) * 2, np.sqrt(rep / n)], axis=1)
    want = numpy_distance(np.round(x * robust_outliers.SCALE) / robust_outliers.SCALE, p)
    assert np.allclose(want, [r.distance for r in used], rtol=1e-4, atol=1e-4)
    assert all(r.kept for r in out[:300]) and not any(r.kept for r in out[300:])
    alike = docs.limit(1).select(F.explode(F.sequence(F.lit(0), F.lit(20))).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"), "source")
    assert robust_outliers.judge(alike).filter("kept").count() == 21


# --- near-duplicates --------------------------------------------------------------

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_banded_distance_is_exact_within_its_limit():
    rng = random.Random(7)
    for _ in range(400):
        a = [rng.randrange(4) for _ in range(rng.randrange(0, 14))]
        b = [x for x in a if rng.random() < 0.8] + [rng.randrange(4) for _ in range(rng.randrange(0, 3))]
        want = edits(a, b)
        for limit in (0, 1, 2, 3, 5, 20):
            got = order_minhash.banded_distance(np.array(a, np.uint64), np.array(b, np.uint64), limit)
            assert got == (want if want <= limit else None)


def near_copy_corpus():
    rng = random.Random(8)
    vocabulary = ["w%d" % i for i in range(4000)]
    texts = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(40, 200))]
        texts.append(base)
        for _ in range(rng.randrange(0, 4)):
            copy = list(base)
            for i in rng.sample(range(len(copy)), max(1, len(copy) * rng.randrange(1, 8) // 100)):
                copy[i] = rng.choice(vocabulary)
            texts.append(copy)
    passage = [rng.choice(vocabulary) for _ in range(60)]  # shared by texts that are not copies
    texts += [[rng.choice(vocabulary) for _ in range(rng.randrange(60, 200))] + passage for _ in range(30)]
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


def test_classes_match_brute_force(spark):
    texts = near_copy_corpus()
    texts += texts[:5] + [None, "", "", "hi", "hi", "Hi", "one two three four"]
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], DOCS).withColumn("class_id", F.lit("clash"))
    split = [(t or "").lower().split() for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = split[i], split[j]
            longer = max(len(a), len(b))
            if (texts[i] or "") == (texts[j] or "") or longer and min(len(a), len(b)) >= 0.8 * longer and \
                    len(set(a) & set(b)) >= 0.5 * len(set(a)) and edits(a, b) <= int(0.2 * longer + 1e-9):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    out = {r.doc_id: r for r in order_minhash.near_duplicates(docs).collect()}
    assert {i: r.class_id for i, r in out.items()} == {i: root(i) for i in range(len(texts))}
    sizes = Counter(map(root, range(len(texts))))
    assert all(r.class_docs == sizes[r.class_id] and r.kept == (i == r.class_id) for i, r in out.items())
    assert sorted(r.doc_id for r in order_minhash.deduplicated(docs).collect()) == sorted(sizes)


def test_repeated_rows_and_null_ids(spark):
    text = "a b c d e f g h i j k l m n o p"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None), (None, ""), (2, "other words here")], "doc_id long, text string")
    kept = order_minhash.deduplicated(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 2), (True, 0)]
    classes = order_minhash.near_duplicates(docs)
    assert classes.count() == 6 and classes.filter("class_id = 1 AND class_docs = 3").count() == 3
    assert order_minhash.near_duplicates(docs.limit(0)).count() == 0 and order_minhash.deduplicated(docs.limit(0)).count() == 0


def test_links_of_each_band_of_similarity_are_found(spark):
    rng = random.Random(11)
    vocabulary = ["w%d" % i for i in range(4000)]
    texts, bands = [], []
    for low in (0.80, 0.85, 0.90, 0.95):
        for _ in range(100):
            base = [rng.choice(vocabulary) for _ in range(rng.choice((9, 10, 14, 25, 39, 41, 60, 150, 300)) if low < 0.95 else 120)]
            n = int((1 - rng.uniform(low, low + 0.05)) * len(base) + 1e-9)
            copy = list(base)
            for i in sorted(rng.sample(range(len(base)), n), reverse=True):
                copy[i:i + 1] = rng.choice(([], [rng.choice(vocabulary)], [rng.choice(vocabulary)]))
            if copy != base and (similar := 1 - edits(base, copy) / len(base)) >= 0.8:
                texts += [base, copy]
                bands.append(min(int(similar * 20 + 1e-9), 19))
    texts += ["a b c d e f g h i".split(), "a b c d x f g h i".split(), "k l m n o".split(), "k l y n o".split(), "q r s t u".split(), "q r t u".split()]
    bands += [17, 16, 16]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
    hits, every = Counter(), Counter(bands)
    for i, band in enumerate(bands):
        hits[band] += found[2 * i + 1] == 2 * i
    print({b / 20: (hits[b], every[b]) for b in sorted(every)})
    assert all(hits[b] >= 0.97 * every[b] for b in every) and all(found[2 * i + 1] == 2 * i for i in range(len(bands) - 3, len(bands)))


def test_links_in_buckets_of_unlike_texts_are_found(spark):
    """Texts that share a passage of three quarters of their words, with planted pairs just above the similarity."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    passage = [word() for _ in range(90)]
    texts = [passage[:45] + [word() for _ in range(30)] + passage[45:] for _ in range(400)]
    for x in texts[:127]:
        copy = list(x)
        for i in rng.sample(range(120), rng.randrange(18, 25)):
            copy[i] = word()
        texts.append(copy)
    near = [passage[:80] + [word() for _ in range(n)] for n in (5, 12, 19, 21, 22, 60)]  # little but the passage
    texts = [" ".join(t) for t in texts + near]
    low = list(range(len(texts)))

    def top(x):
        while low[x] != x:
            x = low[x]
        return x

    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if order_minhash.word_similarity(texts[i], texts[j], 0.8) >= 0.8]
    for i, j in links:
        low[max(top(i), top(j))] = min(top(i), top(j))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(df).collect()}
    assert sum(127 > i < j < 527 for i, j in links) >= 120 and [(i, j) for i, j in links if got[i] != got[j]] == []
    assert got == {i: top(i) for i in range(len(texts))}


@pytest.mark.parametrize("block", [None, 16])
def test_links_of_texts_without_rare_words_are_found(spark, block):
    """Every k-mer is in many classes, and so is every bucket; links are between texts that are not the shortest."""
    rng = random.Random(13)
    parts = [[[f"w{i}v{v}n{n}" for n in range(4)] for v in range(2)] for i in range(50)]
    chosen = [[rng.randrange(2) for _ in parts] for _ in range(300)]
    for c in chosen[:80]:
        copy = list(c)
        for i in rng.sample(range(50), rng.choice((9, 10))):
            copy[i] = 1 - copy[i]
        chosen.append(copy)
    texts = [" ".join(w for i, v in enumerate(c) for w in parts[i][v]) for c in chosen]
    low = list(range(len(texts)))

    def top(x):
        while low[x] != x:
            x = low[x]
        return x

    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if order_minhash.word_similarity(texts[i], texts[j], 0.8) >= 0.8]
    for i, j in links:
        low[max(top(i), top(j))] = min(top(i), top(j))
    p = order_minhash.OrderMinHash(**({"block": block} if block else {}))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(df, p).collect()}
    assert len(links) >= 60 and got == {i: top(i) for i in range(len(texts))}


def test_signatures_lose_no_link():
    rng = random.Random(14)
    for _ in range(300):
        a = [rng.choice("abcdefghij") for _ in range(rng.randrange(1, 60))]
        b = list(a)
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(b) + 1)
            b[at:at + 1] = rng.choice(([], [rng.choice("abcdxyz")], [rng.choice("abcdxyz")] * 2))
        counts = [np.frombuffer(order_minhash.signature(order_minhash.word_hashes(" ".join(t))), np.uint8).astype(int) for t in (a, b)]
        far = sum(np.abs((counts[0] >> s & 15) - (counts[1] >> s & 15)).sum() for s in (0, 4))
        assert far <= 2 * edits(a, b) - abs(len(a) - len(b))


def test_unlike_texts_that_share_a_passage_are_compared_once(spark, monkeypatch):
    """Texts that meet in many buckets are one pair, and counts of words tell most of the unlike ones apart."""
    rng = random.Random(15)
    passage = [f"p{i}" for i in range(560)]
    texts = [passage + [f"w{rng.randrange(3000)}" for _ in range(220)] for _ in range(40)]
    texts.append(texts[7][:700] + ["x"] * 80)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    made, compared = [], order_minhash._compared
    monkeypatch.setattr(order_minhash, "_compared", lambda blocks, p: made.append(order_minhash.stored(compared(blocks, p))) or made[-1])
    classes = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs, order_minhash.OrderMinHash(early=0, few=1000)).collect()}
    pairs = [(r.a, r.b) for r in made[0].collect()]
    assert len(pairs) == len(set(pairs)) < 40 and classes == {i: 7 if i == 40 else i for i in range(41)}


# --- n-gram model -----------------------------------------------------------------

def brute_kneser_ney(sentences):
    """p(w | u, v) from plain dictionaries."""
    tri = Counter(t for s in sentences for t in zip(s, s[1:], s[2:]))
    bi = Counter((v, w) for _, v, w in tri)
    uni = Counter(w for _, w in bi)
    size = len({w for s in sentences for w in s if w > 2}) + 3

    def cuts(counts):
        n = Counter(counts.values())
        if not n[1] or not n[2]:
            return 0.5, 0.5, 0.5
        y = n[1] / (n[1] + 2 * n[2])
        d = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2] if n[3] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] and n[4] else 1.5)
        return tuple(min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1))

    def level(counts, lower):
        d = cuts(counts)
        off = lambda c: d[min(c, 3) - 1] if c else 0.0
        total, gamma = Counter(), Counter()
        for key, c in counts.items():
            total[key[:-1]] += c
            gamma[key[:-1]] += off(c)

        def p(key):
            c, ctx = counts.get(key, 0), key[:-1]
            if not total[ctx]:
                return lower(key[1:])
            return (c - off(c)) / total[ctx] + gamma[ctx] / total[ctx] * lower(key[1:])

        return p

    p1 = level({(w,): c for w, c in uni.items()}, lambda key: 1 / (size - 1))
    return level(dict(tri), level(dict(bi), p1)), size


def test_kneser_ney_matches_brute_force(spark):
    rng = random.Random(9)
    sentences = [" ".join(rng.choice("a b c d e f g".split()) for _ in range(rng.randrange(0, 12))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None) for i, t in enumerate(sentences + ["a zz b", None, "A B"])], "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(60)] + [(None,), (3,)], "doc_id long")
    tables = kneser_ney.train(docs, trusted)
    ids = [[0, 0, *[tables.words.get(w.encode(), 2) for w in s.split()], 1] for s in sentences[:60]]
    p, size = brute_kneser_ney(ids)
    got = {r.doc_id: r.perplexity for r in kneser_ney.perplexities(docs, tables).collect()}
    for r in docs.collect():
        own = [0, 0, *[tables.words.get(w.encode(), 2) for w in (r.text or "").lower().split()], 1]
        logs = [math.log(p(t)) for t in zip(own, own[1:], own[2:])]
        assert math.isclose(got[r.doc_id], math.exp(-sum(logs) / len(logs)), rel_tol=1e-5)
    for u, v in [(0, 0), (3, 4), (5, 9), (2, 2)]:
        every = kneser_ney.log_probabilities(tables, np.array([x for w in range(1, size) for x in (u, v, w)]))[::3]
        assert math.isclose(np.exp(every).sum(), 1.0, rel_tol=1e-5)


def test_classifier_keeps_a_quantile_of_each_language(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", F.lit("clash").alias("perplexity"))
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(kneser_ney.trusted_ids())
    out = kneser_ney.classify(docs, trusted, kneser_ney.KneserNey(quantile=0.8)).collect()
    assert len(out) == docs.count()
    for lang in {r.lang for r in out}:
        own = [r.kept for r in out if r.lang == lang]
        assert sum(own) >= 0.8 * len(own) - 1
    assert kneser_ney.classify(docs, trusted.limit(0)).filter("kept").count() == len(out)
    assert kneser_ney.classify(docs.limit(0), trusted).count() == 0


def test_all_trusted_text_is_counted(spark):
    rng = random.Random(10)
    texts = ["start " + " ".join("w%d" % rng.randrange(1000) for _ in range(300_000))] * 4  # one overlong text, and copies
    texts += ["only%d here" % i for i in range(6100)] + ["x" * 70 + " b", "here zz", "y" * 80]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(8)
    tables = kneser_ney.train(docs, docs.select("doc_id").filter(f"doc_id < {len(texts) - 2}"))
    assert len(tables.words) == 1000 + 1 + 6100 + 2
    out = {r.doc_id: r for r in kneser_ney.perplexities(docs.filter("doc_id > 3"), tables).collect()}
    assert len(out) == len(texts) - 4 and out[len(texts) - 1].n_tokens == 2
    split = [[w if len(w) <= 64 else None for w in t.split()] for t in texts]
    number = {w: tables.words[w.encode()] for w in {w for s in split[:-2] for w in s} - {None}}
    ids = [[0, 0, *[number.get(w, 2) for w in s], 1] for s in split]
    p, _ = brute_kneser_ney(ids[:-2])
    for i in (4, 3000, 6103, len(texts) - 3, len(texts) - 2, len(texts) - 1):
        logs = [math.log(p(t)) for t in zip(ids[i], ids[i][1:], ids[i][2:])]
        assert math.isclose(out[i].perplexity, math.exp(-sum(logs) / len(logs)), rel_tol=1e-6)


def test_model_stays_in_tables(spark, sf_dir):
    docs = documents(spark, sf_dir)
    tables = kneser_ney.train(docs, docs.select("doc_id"))
    for name in ("p3", "w2", "p2", "w1", "p1"):
        assert getattr(tables, name).columns[-1] in ("lp", "lw")
    plan = kneser_ney.perplexities(docs, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") >= 5


# --- pipeline ---------------------------------------------------------------------

def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = documents(spark, sf_dir)
    first = docs.limit(1).select(F.lit(10 ** 6).cast("long").alias("doc_id"), F.lit("12 34 !!").alias("text"), "lang", "source", "n_chars")
    docs = docs.union(first).union(docs.limit(3))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        kept = out.collect()
        assert 0 < len(kept) < docs.count(), name
        docs = spark.createDataFrame(kept, docs.schema)
    assert docs.groupBy("doc_id").count().filter("count > 1").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert docs.limit(0).count() == corpus_pipeline.STAGES[2][1](spark, docs.limit(0), sf_dir).count()


def test_remaining_queries_run(spark, sf_dir):
    n = documents(spark, sf_dir).count()
    for name in ("op5_language_centroids", "op6_subword_lattice", "op7_robust_outliers", "op8_order_minhash", "op9_kneser_ney"):
        assert QUERIES[name](spark, sf_dir).count() == n


def test_parts_give_the_perplexities_of_the_tables(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    odd = [(-1, None, None), (-2, "en", ""), (-3, "en", " \t"), (-4, None, "  The the\x0bTHE a b \x85 c\x1cd  "), (-5, "en", "q" * 90), (-5, "en", "q" * 90), (None, "en", "the end")]
    docs = docs.union(spark.createDataFrame(odd, "doc_id long, lang string, text string"))
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(kneser_ney.trusted_ids()).select("doc_id")
    for p in (kneser_ney.KneserNey(), kneser_ney.KneserNey(word_bytes=8, broadcast_rows=300, passes=2, part_words=2000, slice_bytes=20_000)):
        want = kneser_ney.perplexities(docs, kneser_ney.train(docs, trusted, p)).collect()
        got = kneser_ney.perplexities_by_parts(docs, trusted, p).collect()
        key = lambda r: (r.doc_id is None, r.doc_id, r.perplexity)
        assert len(got) == len(want)
        for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
            assert (a.doc_id, a.lang, a.n_tokens) == (b.doc_id, b.lang, b.n_tokens) and math.isclose(a.perplexity, b.perplexity, rel_tol=1e-9)


def test_no_shuffle_carries_all_trigrams(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("trusted", F.lit(True))
    deal = ngram_shards.Deal(3, 4, np.array([], np.int64), np.array([], np.int64), 1 << 20, 64)
    tokens = ngram_shards.documents(docs, 1 << 20, 64).filter("row IS NOT NULL").agg(F.sum("n")).first()[0]
    passes = [ngram_shards._packed(docs, deal, i).agg(F.sum("size"), F.sum(F.octet_length("grams") + F.octet_length("words") + F.octet_length("of"))).first() for i in range(3)]
    assert sum(n for n, _ in passes) == tokens and max(n for n, _ in passes) < 0.5 * tokens
    assert sum(size for _, size in passes) < 24 * tokens


def test_hashes_of_a_slice_are_those_of_the_words():
    words = ["a", "b" * 64, "c" * 65, "\u00e9\u00c9", "d" * 300, *map(str, range(70_000))]
    want = ngram_shards.hashed_words(" ".join(words).encode(), 64)[1]
    assert (ngram_shards._hashes(pa.array(words), 64) == want).all() and not len(ngram_shards._hashes(pa.array([], pa.string()), 64))
    assert want[2] == want[4] == ngram_shards.UNKNOWN


def test_more_trusted_ids_than_are_sent_to_all_tasks(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i % 190, ("en", "de")[i % 2], " ".join(f"w{x}" for x in rng.integers(0, 40, i % 23)) if i % 17 else None) for i in range(200)]
    for part in range(4):  # files of different sizes, which Spark does not read in the order of their names
        spark.createDataFrame(rows[part ** 2 * 10:(part + 1) ** 2 * 10 if part < 3 else None], "doc_id long, lang string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    trusted = docs.select("doc_id").filter("doc_id % 3 <> 0").union(docs.select(F.lit(None).cast("long")))
    few = kneser_ney.KneserNey(broadcast_rows=10)
    key = lambda r: (r.doc_id, r.n_tokens, r.perplexity)
    want = sorted(kneser_ney.perplexities(docs, kneser_ney.train(docs, trusted)).collect(), key=key)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(kneser_ney.perplexities_by_parts(docs, trusted, few).collect(), key=key)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == len(want) == 200
    for a, b in zip(got, want):
        assert (a.doc_id, a.lang, a.n_tokens) == (b.doc_id, b.lang, b.n_tokens) and math.isclose(a.perplexity, b.perplexity, rel_tol=1e-9)


def test_pieces_of_split_words_are_dealt_in_turn():
    deal = ngram_shards.Deal(3, 5, np.arange(10, 20), np.full(10, 3), 1 << 20, 64)
    parts = deal.parts_of(np.repeat(np.arange(10, 20), 3), np.tile(np.arange(3), 10))
    assert np.bincount(parts, minlength=15).tolist() == [2] * 15


def test_counts_of_trigrams_chunk_by_chunk():
    rng = np.random.default_rng(3)
    u, v, w = rng.integers(5, 12, (3, 5000))
    cut = [(u[i:i + 70], v[i:i + 70], w[i:i + 70], np.ones(len(u[i:i + 70]))) for i in range(0, 5000, 70)]
    whole, pieces = (ngram_shards._tallied(x, 300) for x in ([(u, v, w, np.ones(5000))], cut))
    assert all((a == b).all() for a, b in zip(whole, pieces)) and whole[4].sum() == 5000
    want = Counter(zip(u.tolist(), v.tolist(), w.tolist()))
    assert want == dict(zip(zip(*(x.tolist() for x in whole[1:4])), whole[4]))


def test_alike_is_what_the_alignment_says():
    rng = random.Random(1)
    found = Counter()
    for _ in range(3000):
        size, words, least = rng.randint(0, 60), rng.choice([2, 5, 30, 1000]), rng.choice([0.6, 0.8, 0.9])
        one = [str(rng.randrange(words)) for _ in range(size)]
        other = list(one)
        for _ in range(rng.randint(0, max(1, size // 3))):
            at, way = rng.randint(0, len(other)), rng.random()
            other[at:at + (way < 0.6)] = [] if way < 0.3 else [str(rng.randrange(words))]
        if rng.random() < 0.1:
            other = other[size // 2:] + other[:size // 2]
        a, b = " ".join(one), " ".join(other)
        want = order_minhash.word_similarity(a, b, least) >= least
        assert order_minhash.alike(a, b, least) == want
        found[want] += 1
    assert min(found.values()) > 300


def test_near_copies_are_mostly_settled_without_alignment(monkeypatch):
    rng, aligned = random.Random(2), []
    real = order_minhash.banded_distance
    monkeypatch.setattr(order_minhash, "banded_distance", lambda *x: aligned.append(x) or real(*x))
    for _ in range(100):
        one = [f"w{rng.randrange(300)}" for _ in range(400)]
        other = [w for w in one if rng.random() > 0.03]
        other[20:21] = ["new", "words"]
        assert order_minhash.alike(" ".join(one), " ".join(other), 0.8)
    assert len(aligned) < 20


def test_remembered_texts_stay_few():
    order_minhash._recent.clear()
    order_minhash._held = 0
    for i in range(600):
        order_minhash._words_and_pairs(" ".join(f"{i}x{j}" for j in range(10_000 if i > 400 else 5)))
        assert order_minhash._held == sum(len(v[0]) for v in order_minhash._recent.values())
    assert len(order_minhash._recent) <= 256 and order_minhash._held <= order_minhash._RECENT_WORDS
