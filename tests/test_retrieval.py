"""Chunks, vectors, nearest neighbours, prompts and document sources."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import fixed_values as fixed
from ledgerline.operators import prompts
from ledgerline.operators.chunks import chunk_batches, recursive_chunks, split_text, token_count, window_chunks
from ledgerline.operators.vectors import fit_text_vectors, text_vectors, topk_similar
from ledgerline.plans.retrieval import Retrieval, prompts_for
from ledgerline.sources.documents import html_text, open_vectors, read_documents, store_vectors


def test_short_and_empty_texts(spark):
    df = spark.createDataFrame([(1, "short"), (2, ""), (3, None), (4, "x" * 10)], "doc_id int, text string")
    got = [tuple(r) for r in recursive_chunks(df, 10, 2).orderBy("doc_id", "chunk_no").collect()]
    # Exactly the size without a separator: cut by characters, packed up to the size again.
    assert got == [(1, 0, "short"), (4, 0, "x" * 10)]
    with pytest.raises(ValueError, match="overlap"):
        recursive_chunks(df, 10, 11)


def test_paragraphs_stay_together():
    text = "first paragraph here\n\nsecond one\n\nthird is a bit longer than the others"
    assert split_text(text, 40, 0) == ["first paragraph here\n\nsecond one", "third is a bit longer than the others"]


def test_overlap_repeats_whole_pieces():
    assert split_text("aa bb cc dd ee", 6, 3) == ["aa bb", "bb cc", "cc dd", "dd ee"]
    assert split_text("aa bb cc dd ee", 6, 0) == ["aa bb", "cc dd", "ee"]
    assert split_text("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]


@pytest.mark.parametrize("seed", range(5))
def test_chunks_lose_nothing(seed):
    rnd = random.Random(seed)
    text = "".join(rnd.choice(["a", "bb", "ccc ", " ", "\n", "\n\n", "word ", "longlonglong"]) for _ in range(400))
    for size, overlap in ((30, 0), (30, 10), (7, 3)):
        chunks = split_text(text, size, overlap)
        assert all(0 < len(c) <= size for c in chunks)
        # Every word of the text is found, in order, in the chunks.
        if not overlap:
            assert "".join("".join(chunks).split()) == "".join(text.split())
        at = 0
        for c in chunks:
            found = text.find(c, at)
            assert found >= 0
            at = found


def test_token_chunks():
    text = " ".join(f"w{i}." for i in range(100))
    chunks = split_text(text, 20, 6, token_count)
    assert all(token_count(c) <= 20 for c in chunks) and len(chunks) > 5
    assert set(re.findall(r"w\d+", " ".join(chunks))) == {f"w{i}" for i in range(100)}


def test_window_chunks(spark):
    words = [f"w{i}" for i in range(23)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "one"), (3, "  "), (4, " ".join(words[:10]))], "d int, text string")
    got = {}
    for r in window_chunks(df, 10, 4).orderBy("d", "chunk_no").collect():
        got.setdefault(r.d, []).append(r.chunk.split())
    assert got[1] == [words[0:10], words[6:16], words[12:22], words[18:23]]
    assert got[2] == [["one"]] and got[4] == [words[:10]] and 3 not in got


def _brute(corpus, queries, k):
    out = set()
    for q, qv in queries:
        scored = []
        for c, cv in corpus:
            a, b = np.array(qv, "float64"), np.array(cv, "float64")
            n = np.linalg.norm(a) * np.linalg.norm(b)
            scored.append((-round(float(a @ b / n) if n else 0.0, 9), c))
        out |= {(q, c, i + 1) for i, (s, c) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("limit", [10**9, 200])
def test_topk_is_exact(spark, limit):
    rnd = np.random.default_rng(7)
    base = rnd.normal(size=(20, 8)).round(2)
    # A third of the corpus are copies of one vector, so ties decide.
    corpus = [(i, [float(x) for x in (base[0] if i % 3 == 0 else base[i % 20])]) for i in range(90)] + [(999, [0.0] * 8)]
    queries = [(f"q{i}", [float(x) for x in base[i]]) for i in range(17)]
    c = spark.createDataFrame(corpus, "id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame(queries, "q string, embedding array<float>")
    hits = topk_similar(c, q, 4, "id", "q", max_query_bytes=limit)
    corpus32 = [(i, np.array(v, "float32").astype("float64")) for i, v in corpus]
    queries32 = [(i, np.array(v, "float32").astype("float64")) for i, v in queries]
    assert {(r.q, r.id, r["rank"]) for r in hits.collect()} == _brute(corpus32, queries32, 4)


def test_topk_without_queries(spark):
    c = spark.createDataFrame([(1, [1.0])], "id long, embedding array<float>")
    assert topk_similar(c, c.filter("id > 5").withColumnRenamed("id", "q"), 3, "id", "q").count() == 0


def test_vectors_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red ring red"), (2, "blue bolt"), (3, "")], "id int, t string")
    vectors = text_vectors(fit_text_vectors(docs, "t", 64), docs)
    stored = store_vectors(vectors, str(tmp_path / "v"))
    norms = {r.id: float(np.linalg.norm(r.embedding)) for r in open_vectors(spark, str(tmp_path / "v")).collect()}
    assert norms[1] == pytest.approx(1, abs=1e-6) and norms[3] == 0 and stored.count() == 3
    with pytest.raises(Exception):
        store_vectors(vectors, str(tmp_path / "v"))


def test_prompts_find_the_right_text(spark):
    docs = spark.createDataFrame(
        [(1, "cats sleep all day long {question}", "a.txt"), (2, "engines burn fuel", None), (3, "bread needs flour and water", "c.txt")],
        "doc_id long, text string, source string")
    asked = spark.createDataFrame([("q1", "how do engines use fuel"), ("q2", "why do cats sleep")], "question_id string, question string")
    job = Retrieval(200, 20, k=1, dims=512, template=fixed.PROMPT_PLAIN)
    got = {r.question_id: r.prompt for r in prompts_for(docs, asked, job).collect()}
    assert "Contexto:\nengines burn fuel\n" in got["q1"] and "Pregunta:\nhow do engines use fuel\n" in got["q1"]
    # Braces that come with the text are not places of the template.
    assert "{question}" in got["q2"]
    with pytest.raises(ValueError, match="no value"):
        prompts.render("{context} {other}", {"context": "c"})


def test_history(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(7)] + [(2, 0, "user", "x")],
                                  "c int, n int, role string, text string")
    got = {r.c: r.chat_history for r in prompts.histories(turns, "c", "n", 3, {"user": "Human", "assistant": "AI"}).collect()}
    assert got == {1: "Human: t4\nAI: t5\nHuman: t6", 2: "Human: x"}
    assert prompts.history_turns(turns).count() == 8


def test_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_text("línea 1\nlínea 2", encoding="utf-8")
    (tmp_path / "sub" / "b.txt").write_text("dos", encoding="utf-8")
    assert read_documents(spark, str(tmp_path)).count() == 1
    found = {r.source.rsplit("/", 1)[1]: r.text for r in read_documents(spark, str(tmp_path), recursive=True).collect()}
    assert found == {"a.TXT": "línea 1\nlínea 2", "b.txt": "dos"}
    (tmp_path / "c.xyz").write_text("?")
    with pytest.raises(Exception, match="unsupported extension"):
        read_documents(spark, str(tmp_path)).collect()
    assert read_documents(spark, str(tmp_path), glob="*.TXT").count() == 1


def test_html(spark):
    page = "<html><head><title>T</title><script>a<b</script></head><body><h1>Hi &amp;amp; you</h1><!-- no --><p>a&lt;b  <b>c</b><br>d</p></body></html>"
    assert spark.range(1).select(html_text(F.lit(page))).first()[0] == "Hi &amp; you\na<b c\nd"


def test_chunks_are_passed_on_in_small_batches():
    texts = ["one two three four five six " * 40, None, "", "seven eight"]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "text": texts, "source": ["a", "b", "c", None]})
    split = lambda t: split_text(t, 20, 5)
    found = list(chunk_batches(iter([batch, batch]), "text", "chunk_no", "chunk", split, held_chars=100))
    assert len(found) > 10 and all(sum(map(len, b.column("chunk").to_pylist())) < 120 for b in found)
    want = [(i, s, n, c) for i, t, s in zip((1, 2, 3, 4), texts, ("a", "b", "c", None)) for n, c in enumerate(split(t) if t else [])]
    assert [tuple(r[c] for c in ("doc_id", "source", "chunk_no", "chunk")) for b in found for r in b.to_pylist()] == want * 2
