"""Document sources and the vector table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.columns import ColumnLike, col
from ledgerline.sources.tables import list_directory

TEXT_EXTENSIONS = (".txt",)


def read_documents(spark: SparkSession, path: str | Sequence[str], glob: str | None = None, recursive: bool = False,
                   extensions: Sequence[str] = TEXT_EXTENSIONS) -> DataFrame:
    """One row per file of the folders: its path as ``source`` and its whole text.

    Files with another extension are an error, raised when they are read; a glob
    leaves them out beforehand.
    """
    reader = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    paths = [path] if isinstance(path, str) else list(path)
    if not recursive:
        paths = [f for p in paths for f in list_directory(spark, p, files_only=True)]
    files = reader.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
    extension = F.lower(F.regexp_extract("source", r"(\.[^./]+)$", 1))
    problem = F.concat(F.lit("unsupported extension: "), extension, F.lit(" of "), F.col("source"))
    return files.withColumn("text", F.when(extension.isin(list(extensions)), F.col("text")).otherwise(F.raise_error(problem)))


# Patterns of HTML parts without text, tags that end a line, and entities.
HTML_HIDDEN = ["(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "(?s)<!--.*?-->", "(?is)<title[^>]*>.*?</title>"]
HTML_BREAKS = "(?i)</?(p|br|div|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer)[^>]*>"
HTML_TAG = "<[^>]+>"
HTML_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def html_text(c: ColumnLike) -> Column:
    """Visible text of a page, one line per block, blanks collapsed."""
    out = col(c)
    for hidden in HTML_HIDDEN:
        out = F.regexp_replace(out, hidden, " ")
    out = F.regexp_replace(out, HTML_BREAKS, "\n")
    out = F.regexp_replace(out, HTML_TAG, "")
    for entity, char in HTML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, "[ \t\r]+", " ")
    out = F.regexp_replace(out, " ?\n[ \n]*", "\n")
    return F.trim(out, F.lit(" \n"))


def store_vectors(vectors: DataFrame, path: str) -> DataFrame:
    """Write a vector table once and return it read back."""
    vectors.write.mode("errorifexists").parquet(path)
    return open_vectors(vectors.sparkSession, path)


def open_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Reopen a stored vector table; nothing is embedded again."""
    return spark.read.parquet(path)
