"""The registered queries of the corpus operators, with SQL twins where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import (best_fit, bpe_automaton, external_shuffle, kneser_ney, language_centroids, order_minhash,
                            robust_outliers, simhash_planes, spelling_variants, subword_lattice, target_resampling, url_reputation, winnowing)
from ledgerline.llm.common import fold_of, read

RULES = [url_reputation.Rule("block", "net/"), url_reputation.Rule("allow", "example.net/en/"),
         url_reputation.Rule("block", "example.com/de/"), url_reputation.Rule("allow", "org/fr/")]
SHARDS = 24


def vocabulary(name: str) -> str:
    """Where the public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the labels of the documents with the pages' ids: bad is low quality or toxic."""
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    outcomes = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_reputation.judge_urls(read(spark, sf_dir, "pages"), outcomes, RULES)


def op2_winnowing(spark, sf_dir):
    return winnowing.compare_with_next(read(spark, sf_dir, "documents"))


def op3_bpe_automaton(spark, sf_dir):
    return bpe_automaton.encoding_digests(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_external_shuffle(spark, sf_dir):
    out = external_shuffle.external_shuffle(read(spark, sf_dir, "documents"), SHARDS)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", external_shuffle.record_size(F.col("text")).alias("size"), crc.alias("text_crc32"),
                      F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_language_centroids(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("held_out", fold_of(F.col("doc_id"), 5) == 0)
    model = language_centroids.fit(docs, ~F.col("held_out"))
    found = language_centroids.identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "distance", "rejected")


def op6_subword_lattice(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return subword_lattice.score_documents(docs, fold_of(F.col("doc_id"), 7) != 2, subword_lattice.Lattice(vocabulary("piece_bpe_32k.model")))


def op7_robust_outliers(spark, sf_dir):
    found = robust_outliers.judge(read(spark, sf_dir, "documents"))
    return found.select("doc_id", *robust_outliers.COUNTS, "base_failed", "kept", "distance")


def op8_order_minhash(spark, sf_dir):
    return order_minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_kneser_ney(spark, sf_dir):
    trusted = read(spark, sf_dir, "labels").filter(kneser_ney.trusted_ids())
    return kneser_ney.classify(read(spark, sf_dir, "documents"), trusted)


def op10_best_fit(spark, sf_dir):
    return best_fit.packed(read(spark, sf_dir, "documents"), best_fit.Packing(vocabulary("byte_bpe_50k.json")))


def op11_simhash_planes(spark, sf_dir):
    return simhash_planes.near_duplicates(read(spark, sf_dir, "documents"))


def op12_spelling_variants(spark, sf_dir):
    return spelling_variants.variants(read(spark, sf_dir, "documents"))


def op13_target_resampling(spark, sf_dir):
    drawn = target_resampling.resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


QUERIES = {f.__name__: f for f in (
    op1_url_reputation, op2_winnowing, op3_bpe_automaton, op4_external_shuffle, op5_language_centroids, op6_subword_lattice,
    op7_robust_outliers, op8_order_minhash, op9_kneser_ney, op10_best_fit, op11_simhash_planes, op12_spelling_variants,
    op13_target_resampling)}

_STRENGTH = """1 / greatest(1 / 1001.0::DOUBLE, least(1 / 3.0::DOUBLE, CASE WHEN sum(mean * (1 - mean) * (n - 1)) FILTER (n > 0) > 0
        THEN sum((bad - n * mean) * (bad - n * mean) / n - mean * (1 - mean)) FILTER (n > 0) / sum(mean * (1 - mean) * (n - 1)) FILTER (n > 0)
        ELSE 0 END)) - 1 AS k"""


def _level(child: str, units: str, parent: str) -> str:
    """Shrunk means of a level (``<parent>_mean``) and its units of the next one (``<child>_units``)."""
    return f"""
{parent}_k AS (
    SELECT {_STRENGTH}
    FROM {parent}_units),
{parent}_mean AS (SELECT u.{parent}, (k * mean + bad) / (k + n) AS mean FROM {parent}_units u, {parent}_k),
{child}_units AS (SELECT u.*, m.mean FROM {units} u JOIN {parent}_mean m USING ({parent}))"""


SQL: dict[str, str] = {"op1_url_reputation": f"""
WITH rests AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_reputation.UPPER}', '{url_reputation.LOWER}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rests),
known AS (
    SELECT doc_id AS page_id, max((quality = 0 OR toxic = 1)::INT)::DOUBLE AS bad FROM labels
    WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id),
counted AS (
    SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0) AS bad, regexp_extract(host, '[^.]*$') AS suffix
    FROM parts LEFT JOIN known USING (page_id) GROUP BY host),
hosts AS (
    SELECT *, CASE WHEN length(host) > length(suffix)
        THEN regexp_extract(substr(host, 1, length(host) - length(suffix) - 1), '[^.]*$') || '.' || suffix ELSE host END AS domain
    FROM counted),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffix_units AS (
    SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (coalesce(sum(bad), 0) + 0.2::DOUBLE) / (coalesce(sum(n), 0) + 2) FROM hosts) AS mean
    FROM hosts GROUP BY suffix),{_level("domain", "domains", "suffix")},{_level("host", "hosts", "domain")},
host_k AS (
    SELECT {_STRENGTH}
    FROM host_units),
betas AS (SELECT host, n, k * mean + bad AS a, k * (1 - mean) + n - bad AS b FROM host_units, host_k),
scores AS (
    SELECT host, n::BIGINT AS labelled, round(a / (a + b), 6) AS posterior_mean,
        round(a / (a + b) - 1.645::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6) AS posterior_low
    FROM betas),
ruled AS (
    SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM parts)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('net/', 'example.com/de/') OR (rule IS NULL AND posterior_low > 0.3) THEN 'block' ELSE 'allow' END AS verdict,
    labelled, posterior_mean, posterior_low
FROM ruled JOIN scores USING (host)"""}
