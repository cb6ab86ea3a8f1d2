"""Helpers of the corpus operators: Arrow batches in Python workers, folds of documents, counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: White space that separates words: space and the control characters from tab to carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"

#: Rows handed to Python code at once, so that a run of very long texts stays small.
BATCH_ROWS = 1024


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_map(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """Rows of ``schema`` made from batches of ``df``.

    ``make`` runs once a task, in the Python worker, and returns a function from a batch
    to the columns of the rows that the batch gives.
    """
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                yield pa.RecordBatch.from_pydict(work(batch.slice(start, BATCH_ROWS)), schema=arrow)

    return df.mapInArrow(run, schema)


def arrow_totals(df: DataFrame, schema: str, make: Callable[[], tuple[Callable, Callable]]) -> DataFrame:
    """Partial totals of each task; group and sum them afterwards.

    ``make`` returns (add, take): add(batch) adds to the task's totals, take(last) returns
    columns to pass on now (or None), and is asked after each batch and once at the end.
    """
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, take = make()
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                add(batch.slice(start, BATCH_ROWS))
                if (out := take(False)) is not None:
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)
        if (out := take(True)) is not None:
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo the number of folds; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (stored), sent to all tasks if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def words_of(text: str) -> list[bytes]:
    """Runs of characters other than ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()
