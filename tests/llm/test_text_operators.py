"""URL reputation, winnowing, BPE automaton, packing and sharding against brute force and exact libraries."""

import hashlib
import random
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import oracle
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import best_fit, bpe_automaton, external_shuffle, url_reputation, winnowing
from ledgerline.llm.queries import QUERIES, RULES, SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD_TEXTS = [None, "", " ", "\n\n", "a", "naïve café Σίσυφος ΣΑΣ İstanbul", "it's we'll I'D 12345 ½ ٣", "<|endoftext|> x<|startoftext|>",
             "e\u0301 \u212b ﬁ 😀👩‍👩‍👧 \x1c\x85\u2028z", "word " * 3000, "x" * 5000, "aaaaaaaaaaaa", "The the THE the the the", "日本語 テスト"]


def make_docs(spark, texts, **more):
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# --- URLs -------------------------------------------------------------------------

def test_urls_and_rules(spark):
    urls = {1: ("http://WWW.Example.NET/en/1?x#y", "www.example.net", "/en/1", "example.net/en/", "allow"),
            2: ("https://a.example.com/de/x", "a.example.com", "/de/x", "example.com/de/", "block"),
            3: ("https://x.net?q=/en/", "x.net", "", None, "allow"),
            4: ("https://x.net/", "x.net", "/", "net/", "block"),
            5: (None, "", "", None, "allow"), 6: ("no scheme", "", "", None, "allow"),
            7: ("a://b://c", "b:", "//c", None, "allow"), 8: ("http://evilexample.net/en/", "evilexample.net", "/en/", "net/", "block"),
            9: ("http://org/fr/", "org", "/fr/", "org/fr/", "allow"), 10: ("://", "", "", None, "allow")}
    pages = spark.createDataFrame([(k, v[0], "clash") for k, v in urls.items()] + [(1, urls[1][0], None)], "page_id long, url string, host string")
    empty = spark.createDataFrame([], "page_id long, bad int")
    out = url_reputation.judge_urls(pages, empty, RULES).collect()
    assert len(out) == 11
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == urls[r.page_id][1:]
    assert url_reputation.judge_urls(pages.limit(0), empty, RULES).count() == 0


def test_reputation_matches_brute_force(spark):
    rng = random.Random(5)
    hosts = [f"h{i}.{d}.{s}" for d, s in (("a", "com"), ("b", "com"), ("c", "org")) for i in range(6)]
    rate = {h: rng.choice([0.05, 0.1, 0.9]) for h in hosts}
    pages, marks = [], []
    for i in range(3000):
        h = hosts[int(len(hosts) * rng.random() ** 2)]
        pages.append((i, f"http://{h}/p"))
        if rng.random() < 0.5:
            marks.append((i, int(rng.random() < rate[h])))
    p = url_reputation.Reputation()
    got = {r.host: r for r in url_reputation.judge_urls(spark.createDataFrame(pages, "page_id long, url string"),
                                                       spark.createDataFrame(marks, "page_id long, bad int"), (), p).dropDuplicates(["host"]).collect()}
    host_of = {i: u[7:-2] for i, u in pages}
    n, b = Counter(host_of[i] for i, _ in marks), Counter()
    for i, bad in marks:
        b[host_of[i]] += bad
    names = {h: (h, h.split(".", 1)[1], h.rsplit(".", 1)[1], "") for h in set(host_of.values())}

    def sums(level):
        out = defaultdict(lambda: [0, 0])
        for h, chain in names.items():
            out[chain[level]][0] += n[h]
            out[chain[level]][1] += b[h]
        return out

    parent = {"": (sum(b.values()) + 2 * p.base_rate) / (sum(n.values()) + 2)}
    for level in (2, 1, 0):
        units = sums(level)
        up = {chain[level]: chain[level + 1] for chain in names.values()}
        excess = room = 0.0
        for u, (m, bad) in units.items():
            mean = parent[up[u]]
            if m:
                excess += (bad - m * mean) ** 2 / m - mean * (1 - mean)
                room += mean * (1 - mean) * (m - 1)
        rho = min(max(excess / room if room > 0 else 0, 1 / (p.most + 1)), 1 / (p.least + 1))
        k = 1 / rho - 1
        if level:
            parent = {u: (k * parent[up[u]] + bad) / (k + m) for u, (m, bad) in units.items()}
        else:
            for u, (m, bad) in units.items():
                a, c = k * parent[up[u]] + bad, k * (1 - parent[up[u]]) + m - bad
                low = a / (a + c) - p.z * (a * c / ((a + c) ** 2 * (a + c + 1))) ** 0.5
                assert abs(got[u].posterior_low - low) < 1e-5
                assert got[u].verdict == ("block" if low > p.limit else "allow")
    assert {"block", "allow"} == {r.verdict for r in got.values()}


# --- winnowing --------------------------------------------------------------------

def test_winnowing_picks_rightmost_minimum_and_keeps_the_guarantee():
    rng = random.Random(1)
    for _ in range(60):
        values = np.array([rng.randrange(6) for _ in range(rng.randrange(0, 60))], np.uint64)
        window = rng.randrange(1, 12)
        want = set()
        for i in range(max(0, len(values) - window + 1)) if len(values) >= window else ([0] if len(values) else []):
            part = values[i:i + window].tolist()
            want.add(i + max(j for j, x in enumerate(part) if x == min(part)))
        assert winnowing.chosen(values, window).tolist() == sorted(want)
    p = winnowing.Winnow()
    shared = "".join(rng.choice("abcdefgh ") for _ in range(p.guarantee))
    for _ in range(20):
        a, b = ("".join(rng.choice("ijklmnop") for _ in range(rng.randrange(0, 300))) for _ in range(2))
        (ha, pa), (hb, pb) = winnowing.fingerprint(a + shared + b), winnowing.fingerprint(b + shared + a)
        common = set(ha.tolist()) & set(hb.tolist())
        assert any(len(a) <= at <= len(a) + p.guarantee - p.k and h in common for h, at in zip(ha.tolist(), pa))


def test_neighbours(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    texts = [("t%d " % i) * (i * 7 % 40) + "é😀" * (i % 3) for i in range(60)] + [None, "", "x"]
    docs = make_docs(spark, texts).union(make_docs(spark, texts[:1]))  # a repeated row
    got = defaultdict(list)
    for r in winnowing.compare_with_next(docs).collect():
        got[r.doc_id].append(r)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    order = sorted([*range(len(texts)), 0], reverse=True)
    assert sum(map(len, got.values())) == len(order)
    want = defaultdict(list)
    for i, doc_id in enumerate(order):
        text, nxt = texts[doc_id] or "", texts[order[(i + 1) % len(order)]] or ""
        cut = len(text) // 3
        want[doc_id].append((len(text), hashlib.sha256((text[:len(text) - cut] + nxt[:cut]).encode()).hexdigest(),
                             winnowing.likeness(winnowing.fingerprint(text)[0], winnowing.fingerprint(nxt)[0])))
    for doc_id, rows in want.items():
        assert sorted(rows) == sorted((r.n_chars, r.edited_sha256, r.near_next) for r in got[doc_id])
    one = winnowing.compare_with_next(make_docs(spark, ["abc" * 50])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert winnowing.compare_with_next(make_docs(spark, [])).count() == 0


# --- BPE --------------------------------------------------------------------------

@pytest.fixture(scope="module")
def word_bpe():
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe_automaton.WordBpe(path), Tokenizer.from_file(path)


def test_automaton_equals_the_library(word_bpe, spark, sf_dir):
    own, library = word_bpe
    rng = random.Random(2)
    texts = [t or "" for t in ODD_TEXTS] + [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += ["".join(rng.choice("abcdefghinorst") for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(33, 127), rng.randrange(161, 900), rng.randrange(0x3000, 0x3200)])) for _ in range(20)) for _ in range(300)]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = own.encode(t)
        assert array("I", ids).tolist() == e.ids, t[:80]
        assert own.decode(ids) == library.decode(e.ids, skip_special_tokens=False)


def test_automaton_accepts_one_sequence_per_word():
    rng = random.Random(4)
    for _ in range(30):
        symbols, merges = ["a", "b"], []
        for _ in range(6):
            pair = (rng.choice(symbols), rng.choice(symbols))
            if "".join(pair) not in symbols:
                merges.append(pair)
                symbols.append("".join(pair))
        m = bpe_automaton.MergeAutomaton({s: i for i, s in enumerate(symbols)}, merges)
        for _ in range(60):
            word = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 12)))
            parts = list(word)
            for a, b in merges:
                i = 0
                while i + 1 < len(parts):
                    if (parts[i], parts[i + 1]) == (a, b):
                        parts[i:i + 2] = [a + b]
                    i += 1
            assert [m.labels[t] for t in m.encode(word)] == parts, (merges, word)


def test_encoded_digests(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = make_docs(spark, ODD_TEXTS)
    full = {r.doc_id: r for r in bpe_automaton.encoded(docs, path).collect()}
    for r in bpe_automaton.encoding_digests(docs, path).collect():
        assert r.ids_sha256 == hashlib.sha256(bytes(full[r.doc_id].ids)).hexdigest() and r.n_tokens == len(full[r.doc_id].ids) // 4
        assert r.decoded_sha256 == hashlib.sha256(full[r.doc_id].decoded.encode()).hexdigest()
    assert full[0].decoded == "" and len(full) == len(ODD_TEXTS)
    assert bpe_automaton.encoded(make_docs(spark, []), path).count() == 0


# --- packing ----------------------------------------------------------------------

def test_best_fit_equals_a_search_of_all_bins():
    rng = random.Random(3)
    for _ in range(20):
        lengths = sorted((rng.randrange(1, 65) for _ in range(200)), reverse=True)
        rooms = []
        for n in lengths:
            fits = [i for i, r in enumerate(rooms) if r >= n]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= n
            else:
                rooms.append(64 - n)
        sequences, offsets = best_fit.best_fit(lengths, 64)
        used = defaultdict(list)
        for n, s, o in zip(lengths, sequences, offsets):
            used[s].append((o, n))
        for parts in used.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 64
        assert sorted(64 - sum(n for _, n in parts) for parts in used.values()) == sorted(rooms)


def test_packing_is_whole(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*ODD_TEXTS, *ODD_TEXTS[:3], "hello world " * 700]
    docs = make_docs(spark, texts).withColumnRenamed("source", "sequence_id")
    p = best_fit.Packing(path)
    rows = best_fit.packed(docs, p).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    by_doc = defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes())
        by_doc[r.doc_id].append((r.piece, r.start, r.length))
    for i, own in ids.items():
        pieces = sorted(by_doc[i])
        assert [p for p, _, _ in pieces] == list(range(len(pieces))) and sum(n for _, _, n in pieces) == len(own)
        assert all(n == 1024 for _, _, n in pieces[1:]) and (len(own) > 1024 or len(pieces) == 1)
    whole = {r.sequence_id: bytes(r.ids) for r in best_fit.sequences(docs, p).collect()}
    for r in rows:
        assert whole[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)] == np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()
    assert sum(map(len, whole.values())) == 4 * sum(map(len, ids.values())) and max(map(len, whole.values())) <= 4096
    assert best_fit.packed(make_docs(spark, []), p).count() == 0


def test_long_gaps_and_full_pieces(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [" " * 2_000_000, "\n" * 1_500_000 + "x", "a" + " \t" * 600_000, *["hello world " * 700] * 40, *["one"] * 300]
    docs = make_docs(spark, texts).repartition(7)
    rows = best_fit.packed(docs, best_fit.Packing(path)).collect()
    found = defaultdict(list)
    for r in rows:
        found[r.doc_id].append(r)
    for i, text in enumerate(texts):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert sum(r.length for r in found[i]) == len(ids)
        for r in found[i]:
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    assert sorted(used) == list(range(len(used)))
    for parts in used.values():
        ends = [0]
        for o, n in sorted(parts):
            assert o == ends[-1]
            ends.append(o + n)
        assert ends[-1] <= 1024
    lengths = sorted((r.length for r in rows), reverse=True)
    assert len(used) == len(set(best_fit.best_fit(lengths, 1024)[0])) and len(used) <= sum(lengths) / 1024 * 1.05 + 1


def test_plan_of_counts_is_best_fit_of_pieces():
    rng = random.Random(9)
    for capacity in (7, 64, 100):
        for _ in range(40):
            counts = {n: rng.choice([1, 2, 5, 60]) for n in rng.sample(range(1, capacity + 1), min(capacity, 12))}
            rooms = []
            for n in sorted(counts, reverse=True):
                for _ in range(counts[n]):
                    fits = [i for i, r in enumerate(rooms) if r >= n]
                    if fits:
                        rooms[min(fits, key=lambda i: rooms[i])] -= n
                    else:
                        rooms.append(capacity - n)
            held = Counter()
            for n, own in best_fit.plan(counts, capacity).items():
                for s in best_fit.places(own, np.arange(counts[n]), n)[0].tolist():
                    held[s] += n
            assert sorted(capacity - x for x in held.values()) == sorted(rooms)


# --- sharding ---------------------------------------------------------------------

@pytest.mark.parametrize("rows", [0, 1, 5, 24, 100])
def test_shuffle_is_whole_and_even(spark, rows):
    docs = make_docs(spark, [("t" * (i % 7)) or None for i in range(rows)]).withColumnRenamed("lang", "shard")
    out = external_shuffle.external_shuffle(docs.union(docs.limit(1)), 24).collect()
    total = rows + (1 if rows else 0)
    assert len(out) == total
    assert Counter(r.doc_id for r in out) == Counter([*range(rows), *([0] if rows else [])])
    by_shard = defaultdict(list)
    for r in out:
        by_shard[r.shard].append(r.slot)
    counts = [len(by_shard[s]) for s in range(24)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by_shard.values())


def test_shuffle_mixes_and_repeats(spark):
    docs = make_docs(spark, [str(i) for i in range(2000)])
    out = {r.doc_id: (r.shard, r.slot) for r in external_shuffle.external_shuffle(docs, 4, seed=1).collect()}
    again = {r.doc_id: (r.shard, r.slot) for r in external_shuffle.external_shuffle(docs.repartition(3), 4, seed=1).collect()}
    other = {r.doc_id: (r.shard, r.slot) for r in external_shuffle.external_shuffle(docs, 4, seed=2).collect()}
    assert out == again and out != other
    ranks = np.array([out[i][0] * 500 + out[i][1] for i in range(2000)])
    assert abs(np.corrcoef(ranks, np.arange(2000))[0, 1]) < 0.1
    same = spark.createDataFrame([(None, "same")] * 50, "doc_id long, text string")
    assert external_shuffle.external_shuffle(same, 3).groupBy("shard").count().count() == 3


def test_written_shards(spark, tmp_path):
    docs = make_docs(spark, [str(i) for i in range(100)])
    external_shuffle.write_shards(docs, str(tmp_path / "s"), 5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 100 and back.select("shard").distinct().count() == 5


def test_queries_return_a_row_per_document(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op2_winnowing", "op3_bpe_automaton", "op4_external_shuffle"):
        assert QUERIES[name](spark, sf_dir).count() == n


def test_url_reputation_matches_sql(spark, sf_dir):
    want = oracle.duck(sf_dir).execute(SQL["op1_url_reputation"]).to_arrow_table().to_pylist()
    got = [r.asDict() for r in QUERIES["op1_url_reputation"](spark, sf_dir).collect()]
    assert got and sorted(got, key=lambda r: r["page_id"]) == sorted(want, key=lambda r: r["page_id"])
