"""Retrieval up to the prompt, for a batch of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import fixed_values as fixed
from ledgerline.operators import prompts
from ledgerline.operators.chunks import recursive_chunks
from ledgerline.operators.vectors import fit_text_vectors, text_vectors, topk_similar
from ledgerline.sources.shared import stored


@dataclass(frozen=True)
class Retrieval:
    """Parameters of one retrieval job."""

    chunk_size: int = 2048
    overlap: int = 200
    unit: str = "chars"
    k: int = 3
    dims: int = 1024
    template: str = fixed.PROMPT_PLAIN


# Sizes, overlaps, k and prompts of the document jobs.
JOBS = {
    "large_chunks": Retrieval(2048, 200, "chars", 3, template=fixed.PROMPT_PLAIN),
    "with_history": Retrieval(1024, 100, "chars", 3, template=fixed.PROMPT_WITH_HISTORY),
    "fast": Retrieval(1024, 100, "chars", 1, template=fixed.PROMPT_WITH_HISTORY),
    "token_chunks": Retrieval(128, 50, "tokens", 3, template=fixed.PROMPT_DOCUMENT),
}


def chunk_table(documents: DataFrame, job: Retrieval, doc_id: str = "doc_id") -> DataFrame:
    """Chunks with an id that sorts by document and position."""
    chunks = recursive_chunks(documents.select(doc_id, "source", "text"), job.chunk_size, job.overlap, unit=job.unit)
    return chunks.withColumn("chunk_id", F.format_string("%012d-%06d", F.col(doc_id), F.col("chunk_no")))


def nearest_chunks(documents: DataFrame, questions: DataFrame, job: Retrieval, doc_id: str = "doc_id",
                   question_id: str = "question_id") -> DataFrame:
    """Ranked chunks per question with text and source.

    The chunk table is written once: fitting the weights, scoring, and fetching the
    texts of the found chunks all read it.
    """
    chunks = stored(chunk_table(documents, job, doc_id))
    model = fit_text_vectors(chunks, "chunk", job.dims)
    corpus = text_vectors(model, chunks.select("chunk_id", "chunk")).drop("chunk")
    asked = text_vectors(model, questions.select(question_id, F.col("question").alias("chunk"))).drop("chunk")
    hits = topk_similar(corpus, asked, job.k, "chunk_id", question_id)
    return hits.join(chunks, "chunk_id")


def prompts_for(documents: DataFrame, questions: DataFrame, job: Retrieval, history: DataFrame | None = None,
                doc_id: str = "doc_id", question_id: str = "question_id") -> DataFrame:
    """One prompt per question: all its chunks in one context, with its history if there is one."""
    context = prompts.contexts(nearest_chunks(documents, questions, job, doc_id, question_id), question_id, "chunk")
    asked = questions.join(context, question_id, "left")
    if history is not None:
        asked = asked.join(history, question_id, "left")
    else:
        asked = asked.withColumn("chat_history", F.lit(""))
    values = {"context": "context", "question": "question", "chat_history": "chat_history"}
    return asked.select(question_id, prompts.render(job.template, values).alias("prompt"))
