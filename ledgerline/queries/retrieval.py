"""Chunks, vectors, nearest chunks and prompts."""

from __future__ import annotations

import re


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import fixed_values as fixed
from ledgerline.operators import prompts
from ledgerline.operators.chunks import recursive_chunks, window_chunks
from ledgerline.operators.pruned import fit_clusters, pruned_topk
from ledgerline.operators.vectors import fit_projection, fit_text_vectors, project, text_vectors, topk_similar
from ledgerline.plans.retrieval import JOBS, nearest_chunks, prompts_for
from ledgerline.queries.registry import Tables, query
from ledgerline.sources.shared import stored

_WORDS = r"list_filter(string_split_regex(text, '[ \t\r\n\f]+'), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
 s AS (SELECT doc_id, words, unnest(range(greatest(ceil((len(words) - 50) / 78.0), 1)::BIGINT)) AS chunk_no FROM w WHERE len(words) > 0)
SELECT doc_id, chunk_no::INT AS chunk_no, array_to_string(list_slice(words, chunk_no * 78 + 1, chunk_no * 78 + 128), ' ') AS chunk FROM s""")
def chunks_window(t):
    return window_chunks(t.documents.select("doc_id", "text"), 128, 50)


@query()
def chunks_recursive(t):
    return recursive_chunks(t.documents.select("doc_id", "source", "text"), 2048, 200)


@query()
def chunks_by_tokens(t):
    return recursive_chunks(t.documents.select("doc_id", "source", "text"), 128, 50, unit="tokens")


@query()
def tfidf_vectors(t):
    model = fit_text_vectors(t.documents, "text")
    vectors = text_vectors(model, t.documents.select("doc_id", "text"))
    return vectors.select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"),
                          F.size(F.filter("embedding", lambda x: x != 0)).alias("terms"))


@query()
def dense_text_vectors(t):
    """Norms before and after projection to 64 dense dimensions."""
    vectors = text_vectors(fit_text_vectors(t.documents, "text"), t.documents.select("doc_id", "text")).select("doc_id", "embedding")
    stored_vectors = stored(vectors)
    found = project(stored_vectors, fit_projection(stored_vectors))
    norm = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x), 3)
    return found.select("doc_id", norm("embedding").alias("norm"), norm("dense").alias("kept_norm"), F.size("dense").alias("dims"))


def label_centres(t: Tables) -> DataFrame:
    """Mean vector of each label, as the questions."""
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg("x").alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    return means.groupBy("label").agg(F.transform(ordered, lambda s: s.m).alias("embedding"))


TOPK_SQL = """WITH c AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
 m AS (SELECT label, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(x) AS m FROM c GROUP BY label, i) GROUP BY label),
 s AS (SELECT m.label, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], centre), 9) AS score FROM embeddings e, m),
 r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT label, vec_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 3"""


@query(TOPK_SQL)
def topk_similar_vectors(t):
    hits = topk_similar(t.embeddings, label_centres(t), 3, "vec_id", "label")
    return hits.select("label", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(TOPK_SQL)
def topk_pruned_vectors(t):
    """The same rows from an index of clusters, most of which are passed over."""
    hits = pruned_topk(fit_clusters(t.embeddings, "vec_id"), label_centres(t), 3, "label")
    return hits.select("label", "vec_id", F.round("score", 6).alias("score"), "rank")


def questions(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


@query()
def retrieved_chunks(t):
    hits = nearest_chunks(t.documents, questions(t), JOBS["large_chunks"])
    return prompts.source_report(hits, "question_id", "chunk")


@query()
def retrieval_prompts(t):
    return prompts_for(t.documents, questions(t), JOBS["with_history"])


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'Human' WHEN 'assistant' THEN 'AI' ELSE role END || ': ' || text, chr(10) ORDER BY turn)
 AS chat_history FROM r WHERE rn <= 5 GROUP BY conv_id""")
def history_window(t):
    return prompts.histories(t.conversations, "conv_id", "turn", 5, {"user": "Human", "assistant": "AI"})


@query("""SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Human' WHEN 'assistant' THEN 'AI' ELSE role END || ': ' || text AS line
FROM conversations""")
def history_all_turns(t):
    lines = prompts.history_turns(t.conversations, {"user": "Human", "assistant": "AI"})
    return lines.select("conv_id", "turn", "line")


def template_sql(template: str, values: dict[str, str]) -> str:
    """Template as a concatenation, with SQL expressions in its places."""
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(values[p] if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts))


@query(f"""WITH l AS (SELECT conv_id, max(turn) AS last_user FROM conversations WHERE role = 'user' GROUP BY conv_id),
 q AS (SELECT c.conv_id, text AS question FROM conversations c JOIN l ON l.conv_id = c.conv_id AND turn = last_user),
 b AS (SELECT c.* FROM conversations c
  JOIN l ON l.conv_id = c.conv_id AND turn < last_user),
 h AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM b GROUP BY conv_id)
SELECT q.conv_id, {template_sql(fixed.PROMPT_WITH_HISTORY, {"context": "''", "chat_history": "coalesce(history, '')", "question": "question"})}
 AS prompt FROM q LEFT JOIN h ON h.conv_id = q.conv_id""")
def history_prompts(t):
    last_user = t.conversations.filter(F.col("role") == "user").groupBy("conv_id").agg(
        F.max("turn").alias("last_user"), F.max_by("text", "turn").alias("question"))
    before = t.conversations.join(last_user, "conv_id").filter(F.col("turn") < F.col("last_user"))
    asked = last_user.join(prompts.histories(before, "conv_id", "turn", None), "conv_id", "left")
    prompt = prompts.render(fixed.PROMPT_WITH_HISTORY, {"context": F.lit(""), "chat_history": "chat_history", "question": "question"})
    return asked.select("conv_id", prompt.alias("prompt"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
SELECT source, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM r WHERE rank <= 3 GROUP BY source""")
def context_texts(t):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    ranked = t.documents.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 3)
    return prompts.contexts(ranked, "source", "text")
