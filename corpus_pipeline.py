"""From raw documents to packed training sequences: four stages, each written and read again.

Languages that cannot be told go first, then texts that fail the base rules or lie far
from their source's statistics, then all but one document of each group of near copies;
what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import best_fit, language_centroids, order_minhash, robust_outliers
from ledgerline.llm.common import read
from ledgerline.llm.queries import vocabulary
from ledgerline.sources.shared import stored


def _columns(docs: DataFrame):
    return [F.col(f"`{c}`") for c in docs.columns]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; all labelled languages of the stage's input are learned from."""
    model = language_centroids.fit(docs, F.lit(True))
    marked = docs.withColumn("__text", F.col("text"))
    found = language_centroids.identify(marked.select(F.struct(*_columns(docs)).alias("d"), F.col("__text").alias("text")), model)
    return found.filter(~F.col("rejected")).select("d.*")


def sound(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    found = robust_outliers.judge(docs.select(F.struct(*_columns(docs)).alias("d"), "text", "lang", "source"), keep=("d",))
    return found.filter("kept").select("d.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    return order_minhash.deduplicated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequence and place of every piece of every document."""
    return best_fit.packed(docs, best_fit.Packing(vocabulary("byte_bpe_50k.json")))


STAGES = [("language", identified), ("quality", sound), ("near_duplicates", distinct), ("packing", packed)]

#: SQL has no language model and no alignment; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the table documents."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
