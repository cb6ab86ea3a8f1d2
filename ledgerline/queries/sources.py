"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import fixed_values as fixed
from ledgerline.operators.prompts import source_report
from ledgerline.queries.cleaning import PROVIDERS, _LIST_CLASS, parts_sql, parts_with
from ledgerline.queries.registry import query
from ledgerline.sources.documents import HTML_BREAKS, HTML_ENTITIES, HTML_HIDDEN, HTML_TAG, html_text, store_vectors
from ledgerline.sources.shared import new_path, spread
from ledgerline.sources.tables import provider_table, read_table, write_table


@query(f"""SELECT v, coalesce({_LIST_CLASS}, 'nan') AS provider_class FROM (SELECT DISTINCT v FROM ({parts_sql(PROVIDERS, 'v')}))""")
def provider_classes(t):
    return provider_table(parts_with(t, PROVIDERS, "v"), "v")


@query("SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def csv_round_trip(t):
    part = t.part.select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    path = write_table(part, new_path(part.sparkSession) + ".csv", "csv")
    return read_table(part.sparkSession, path, "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double")


@query("SELECT vec_id, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1)::INT AS place, label FROM embeddings")
def vector_round_trip(t):
    kept = store_vectors(t.embeddings, new_path(t.embeddings.sparkSession))
    cells = kept.select("vec_id", F.posexplode("embedding").alias("place", "value"), "label")
    return cells.select("vec_id", F.col("value").cast("double").alias("value"), (F.col("place") + 1).alias("place"), "label")


def html_sql(c: str) -> str:
    for hidden in HTML_HIDDEN:
        c = f"regexp_replace({c}, '{hidden}', ' ', 'g')"
    c = f"regexp_replace({c}, '{HTML_BREAKS}', chr(10), 'g')"
    c = f"regexp_replace({c}, '{HTML_TAG}', '', 'g')"
    for entity, char in HTML_ENTITIES:
        c = f"replace({c}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')".replace("'&#39;'", "'&#39;'")
    c = rf"regexp_replace({c}, '[ \t\r]+', ' ', 'g')"
    c = rf"regexp_replace({c}, ' ?\n[ \n]*', chr(10), 'g')"
    return f"trim({c}, ' ' || chr(10))"


@query(f"SELECT page_id, url, {html_sql('html')} AS text FROM pages")
def html_page_text(t):
    return spread(t.pages).select("page_id", "url", html_text("html").alias("text"))


@query(f"SELECT doc_id, coalesce(CASE WHEN lang <> 'en' THEN source END, '{fixed.SOURCE_UNKNOWN}') AS source, substr(text, 1, 512) AS snippet FROM documents")
def document_snippets(t):
    ranked = t.documents.select("doc_id", F.lit(1).alias("rank"), F.when(F.col("lang") != "en", F.col("source")).alias("source"), "text")
    return source_report(ranked, "doc_id", "text").drop("rank")
