"""Bit-sliced SimHash, spelling variants and importance resampling against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from ledgerline.llm import simhash_planes, spelling_variants, target_resampling
from ledgerline.llm.queries import QUERIES

ODD = [None, "", " \t\n ", "one", "One  two", "one two", "É é À x", "a b c d e", "word " * 3000, "xy" * 50_000]


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n long, node long, word string, rank long, bucket string")


def odd_rows():
    texts = ODD + [ODD[5], ODD[8]]
    ids = [*range(len(texts) - 1), None]
    return [(i, t, None, 1, 2, "clash", 3, "clash") for i, t in zip(ids, texts)] + [(0, None, "x", 1, 2, None, None, None)] * 2


def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def key(x):
    return (x is None, x)


# --- bit-sliced simhash --------------------------------------------------------------

def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", lower(text))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=3):
    prints = {fp for _, fp in rows}
    low = {fp: fp for fp in prints}

    def top(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in itertools.combinations(sorted(prints), 2):
        if (a ^ b).bit_count() <= radius:
            low[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for i, fp in rows:
        if i is not None:
            least[top(fp)] = min(i, least.get(top(fp), i))
    return sorted(((i, f"{fp:016x}", least.get(top(fp))) for i, fp in rows), key=lambda r: (key(r[0]), r[1]))


def got_components(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=lambda r: (key(r[0]), r[1]))


@pytest.mark.parametrize("p", [simhash_planes.SimHash(), simhash_planes.SimHash(bucket_rows=4, broadcast_rows=1)])
def test_simhash_of_documents_matches_brute_force(spark, sf_dir, p):
    rows = documents(spark, sf_dir)
    want = plain_components([(i, plain_fingerprint(t)) for i, t in rows])
    got = simhash_planes.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), p)
    assert got_components(got) == want
    assert any(c != i for i, _, c in want)
    if p == simhash_planes.SimHash():
        assert got_components(QUERIES["op11_simhash_planes"](spark, sf_dir)) == want


def test_simhash_of_odd_rows(spark):
    rows = odd_rows()
    got = simhash_planes.near_duplicates(table(spark, rows))
    assert got_components(got) == plain_components([(r[0], plain_fingerprint(r[1])) for r in rows])
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert simhash_planes.near_duplicates(table(spark, [])).count() == 0
    assert simhash_planes.near_duplicates(table(spark, [(None, "a b c", *[None] * 6)])).first().component_id is None


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_links_connect_what_is_near(radius):
    rng = random.Random(radius)
    nodes, group = [], []
    for g, size in enumerate([1, 2, 3, 70, 1, 200, 64, 65]):
        base = [rng.getrandbits(64) for _ in range(20)]  # no node is in two groups
        near = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(radius + 3))) for b in rng.choices(base, k=3 * size)}
        chosen = sorted(rng.sample(sorted(near), min(size, len(near))), key=lambda x: np.array(x, np.uint64).view(np.int64))
        nodes += chosen
        group += [g] * len(chosen)
    a, b = simhash_planes.linked(np.array(nodes, np.uint64).view(np.int64), np.array(group), radius)
    low = {x: x for x in zip(group, nodes)}

    def top(x):
        while low[x] != x:
            x = low[x]
        return x

    for (g, x), (h, y) in itertools.combinations(list(low), 2):
        if g == h and (x ^ y).bit_count() <= radius:
            low[top((h, y))] = top((g, x))
    want = defaultdict(set)
    for x in low:
        want[top(x)].add(x[1])
    got = {frozenset(x) for x in want.values() if len(x) > 1}
    stars = defaultdict(set)
    for x, y in zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist()):
        stars[x] |= {x, y}
    assert {frozenset(s) for s in stars.values()} == got


def test_close_fingerprints_share_a_bucket_however_fine(spark):
    """A dense ball of fingerprints: every bucket is cut several times and no link is lost."""
    rng = random.Random(5)
    rows = []
    for base in (0, rng.getrandbits(64)):
        rows += [base ^ sum(1 << x for x in rng.sample(range(64), k)) for k in (0, 1, 2, 2, 3, 5, 7, 9) for _ in range(60)]
    rows = sorted(set(rows))
    signed = [x - (1 << 64) if x >> 63 else x for x in rows]
    nodes = spark.createDataFrame([(x,) for x in signed], "node long")
    for limit in (8, 1000):
        p = simhash_planes.SimHash(bucket_rows=limit)
        found = simhash_planes.components(simhash_planes.links(nodes, p)).collect()
        comp = {r.node: r.comp for r in found}
        classes = Counter(comp.get(s, s) for s in signed)
        want = Counter(c for _, _, c in plain_components([(i, x) for i, x in enumerate(rows)]))
        assert sorted(classes.values()) == sorted(want.values())
        if limit == 8:
            assert simhash_planes._buckets(nodes, p).groupBy("mask", "part").count().agg({"count": "max"}).first()[0] <= 3 * 8  # cuts of different depth may meet


# --- spelling variants -----------------------------------------------------------------

def plain_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows, ratio=10):
    n = plain_words(rows)
    near = defaultdict(list)
    holes = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i] + w[i + 1:]].add(w)
    for w in n:
        others = set().union(*(holes[w[:i] + w[i + 1:]] for i in range(len(w))), holes[w], {w[:i] + w[i + 1:] for i in range(len(w))} & set(n))
        near[w] = [o for o in others if o != w and one_edit(w, o)]
    out = {}
    for w, c in n.items():
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        out[w] = best if best is not None and n[best] >= ratio * c else None
    rows = []
    for w, form in out.items():
        root = w
        while out[root] is not None:
            root = out[root]
        rows.append((w, n[w], len(near[w]), form, n[form] if form else None, root))
    return sorted(rows)


def got_variants(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


@pytest.mark.parametrize("p", [spelling_variants.Variants(), spelling_variants.Variants(bucket_rows=3, tile=2, broadcast_rows=1)])
def test_variants_of_documents_match_brute_force(spark, sf_dir, p):
    want = plain_variants(documents(spark, sf_dir))
    assert got_variants(spelling_variants.variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), p)) == want
    assert any(r[3] is not None for r in want)
    if p == spelling_variants.Variants():
        assert got_variants(QUERIES["op12_spelling_variants"](spark, sf_dir)) == want


def test_variants_of_odd_rows(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abÀÿ×") for _ in range(rng.randrange(6, 11))) for _ in range(150)]
    chain = ["letters", "letterss", "lettersss"]
    long = "q" * 3000
    text = " ".join(rng.choice(words) for _ in range(6000)) + " " + " ".join(w for w, n in zip(chain, (500, 40, 3)) for _ in range(n))
    rows = odd_rows() + [(77, text, *[None] * 6), (78, f"{long}a {long}b {long} LETTERS Łetters let'ters " * 12, *[None] * 6), (None, text[:5000], *[None] * 6)]
    rows += rows[-1:]
    want = plain_variants([r[:2] for r in rows])
    for p in (spelling_variants.Variants(), spelling_variants.Variants(bucket_rows=5, tile=8)):
        got = spelling_variants.variants(table(spark, rows), p)
        assert got_variants(got) == want
    assert {r[5] for r in want if r[0] in chain} == {"letters"}
    assert spelling_variants.variants(table(spark, [])).count() == 0
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    pairs = {(r.variant, r.root) for r in spelling_variants.normalised(table(spark, rows)).collect()}
    assert pairs == {(w, root) for w, _, _, form, _, root in want if form}


def test_runs_of_a_long_text_are_whole(monkeypatch):
    monkeypatch.setattr(spelling_variants, "_BLOCK", 7)
    text = "Some lettErs, and ÀÉÿ more-letters abcdefghijklmnop!"
    found = [w for block in spelling_variants.runs(text) for w in block]
    assert found == [lower(w) for w in re.findall("[A-Za-zÀ-ÿ]+", text)]


# --- importance resampling ---------------------------------------------------------------

def plain_features(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    return len(words), [zlib.crc32(" ".join(words[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain_resampling(rows, target):
    raw, wanted = Counter(), Counter()
    found = [plain_features(t) for _, t in rows]
    for _, f in found:
        raw.update(f)
    for t in target:
        wanted.update(plain_features(t)[1])
    S, T = sum(raw.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (S + 10000) / ((raw[b] + 1) * (T + 10000)))) for b in raw}
    out = []
    for (i, _), (n, f) in zip(rows, found):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], key(r[0])))
    drawn = len(able) * 5 // 100
    return out, [(r[0], r[3], k + 1) for k, r in enumerate(able[:drawn])]


def check_resampling(got, rows, target):
    want, drawn = plain_resampling(rows, target)
    got = got.collect()
    order = lambda rs: sorted(rs, key=lambda r: (key(r[0]), r[1:]))
    assert order((r.doc_id, r.n_features, r.weight, r.score) for r in got) == order(r[:4] for r in want)
    assert sorted((r.rank, r.doc_id, r.score) for r in got if r["rank"] is not None) == [(k, i, s) for i, s, k in drawn]
    return len(drawn)


@pytest.mark.parametrize("p", [target_resampling.Resampling(), target_resampling.Resampling(slice_rows=1)])
def test_resampling_of_documents_matches_brute_force(spark, sf_dir, p):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    rows, target = documents(spark, sf_dir), [r.text for r in bench.collect()]
    assert check_resampling(target_resampling.resampled(docs, bench, p), rows, target) > 5
    if p == target_resampling.Resampling():
        assert check_resampling(QUERIES["op13_target_resampling"](spark, sf_dir), rows, target) > 5
        assert target_resampling.sample(docs, bench).count() == len(plain_resampling(rows, target)[1])


def test_resampling_of_odd_rows(spark):
    rng = random.Random(8)
    words = ["Ärger", "foo", "BAR", "x1", "7", "ça", "naïve", "-", "_q_"]
    rows = odd_rows() + [(i, " ".join(rng.choices(words, k=rng.randrange(15, 40))), *[None] * 6) for i in range(100, 900)]
    rows += rows[-3:]
    target = [None, "", "foo Ärger ça x1", "foo foo"]
    bench = spark.createDataFrame([(None, t, 1) for t in target], "item_id long, text string, weight long")
    for p in (target_resampling.Resampling(), target_resampling.Resampling(slice_rows=1)):
        assert check_resampling(target_resampling.resampled(table(spark, rows), bench, p), [r[:2] for r in rows], target) > 10
    assert target_resampling.resampled(table(spark, []), bench).count() == 0
    assert target_resampling.resampled(table(spark, rows), bench.limit(0)).filter("rank IS NOT NULL").count() > 0


def test_features_of_a_long_text_are_whole(monkeypatch):
    text = "a bb ccc dddd " * 30 + "end"
    whole = [sorted(c for _, crcs in target_resampling.feature_blocks(text, k) for c in crcs) for k in (1, 2, 3, 4)]
    monkeypatch.setattr(target_resampling, "_BLOCK", 3)
    assert whole == [sorted(c for _, crcs in target_resampling.feature_blocks(text, k) for c in crcs) for k in (1, 2, 3, 4)]
    assert sorted(c % 10000 for c in whole[2]) == sorted(plain_features(text)[1])
