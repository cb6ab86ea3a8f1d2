"""Named tables of a delivery: loading, aliases, column names and sinks."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import provider_list_class


def read_table(spark: SparkSession, path: str, schema: str | None = None, multiline: bool = False) -> DataFrame:
    """Parquet or CSV by extension; CSV has a header.

    ``multiline`` reads CSV cells with line breaks; each file is then one task.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    if path.endswith(".csv"):
        return reader.csv(path, header=True, multiLine=multiline, escape='"')
    return reader.parquet(path)


def list_directory(spark: SparkSession, directory: str, files_only: bool = False) -> list[str]:
    """Full paths of what lies directly in a directory of any Hadoop file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(s.getPath().toString() for s in found if s.isFile() or not files_only)


def read_tables(spark: SparkSession, directory: str, schemas: Mapping[str, str] | None = None,
                multiline: bool = False) -> dict[str, DataFrame]:
    """Every parquet or CSV table of a directory, by name."""
    schemas = schemas or {}
    tables = {}
    for path in list_directory(spark, directory):
        name, ext = os.path.splitext(os.path.basename(path))
        if ext in (".parquet", ".csv"):
            tables[name] = read_table(spark, path, schemas.get(name), multiline)
    return tables


@dataclass(frozen=True)
class Delivery:
    """How one delivery of the data is named: tables, their aliases, its own columns."""

    number: int
    tables: Sequence[str]
    aliases: Mapping[str, Sequence[str]]
    optional: Sequence[str] = ()
    columns: Mapping[str, Mapping[str, str]] = field(default_factory=dict)


REGISTRIES = ["ledger", "deaths", "births", "coverage", "alerts", "vaccination", "stays"]

# Table names of the deliveries and the columns whose name differs.
ALIASES = {
    "ledger": ["IAE"],
    "deaths": ["IAE_CDE", "CDE"],
    "births": ["IAE_CNV", "CNV"],
    "coverage": ["IAE_RUCAF"],
    "alerts": ["IAE_SHARPS", "SHARPS"],
    "vaccination": ["IAE_SIV", "SIV"],
    "stays": ["EH"],
}
LEDGER_COLUMNS = {
    1: {"NACIMIENTO": "birth_date", "PRESTADOR RECODIFICADO": "provider", "DECISIÓN": "decision", "EDAD": "age"},
    2: {"FECHA NACIMIENTO": "birth_date", "PRESTADOR": "provider", "DECISION": "decision"},
}
LEDGER_COMMON = {
    "CEDULA": "entity_id", "ID": "row_id", "FECHA IAE": "event_time", "REGISTRO": "recorded_time", "PERSONA": "sex",
    "METODO": "method", "IAE PREVIO": "previous_flag", "ESTABLECIMIENTO REGISTRO": "site",
}


def delivery(number: int) -> Delivery:
    if number not in LEDGER_COLUMNS:
        raise ValueError(f"unknown delivery {number!r}; known: {sorted(LEDGER_COLUMNS)}")
    names = REGISTRIES if number == 2 else REGISTRIES[:-1]
    return Delivery(number, names, ALIASES, ["stays"], {"ledger": {**LEDGER_COMMON, **LEDGER_COLUMNS[number]}})


def load_delivery(tables: Mapping[str, DataFrame], number: int) -> dict[str, DataFrame | None]:
    """Logical tables of a delivery: first alias present, neutral column names, None if optional and absent."""
    spec = delivery(number)
    out: dict[str, DataFrame | None] = {}
    for name in spec.tables:
        found = next((a for a in spec.aliases[name] if a in tables), None)
        if found is None:
            if name not in spec.optional:
                raise KeyError(f"table {name!r} is missing; looked for {list(spec.aliases[name])}")
            out[name] = None
            continue
        out[name] = tables[found].withColumnsRenamed(dict(spec.columns.get(name, {})))
    return out


def with_row_order(df: DataFrame, name: str = "row_no") -> DataFrame:
    """Number rows in the order of the files, by path, and of the rows in each.

    Spark keeps no row order after a shuffle, and packs the splits of a scan by size, so
    the order of its tasks is not that of the files. Rows are counted per split first (no
    column is read for that); the window over these counts has one row per split.
    Rows that do not come straight from files are numbered as they stand.
    """
    row = F.monotonically_increasing_id()
    try:
        scan = df.withColumns({"__file": F.col("_metadata.file_path"), "__start": F.col("_metadata.file_block_start"), "__row": row})
    except AnalysisException:  # not a scan of files
        return df.withColumn(name, row)
    split = ["__file", "__start"]
    splits = scan.groupBy(*split).agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = splits.select(*split, (before - F.col("__first")).alias("__shift"))
    number = (F.col("__row") + F.col("__shift")).alias(name)
    return scan.join(placed, split).select(*[F.col(f"`{c}`") for c in df.columns if c != name], number)


def stamped_name(base: str, number: int, at: datetime | None = None) -> str:
    return f"{base}_entrega{number}_{(at or datetime.now()).strftime('%Y-%m-%d_%H-%M-%S')}"


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write once; an existing path is an error. CSV cannot hold arrays."""
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt in ("parquet", "json", "orc"):
        writer.format(fmt).save(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}; known: csv, json, orc, parquet")
    return path


def provider_table(df: DataFrame, column: str, label: str = "provider_class") -> DataFrame:
    """Each distinct provider value with its class, ready to be written."""
    distinct = df.select(column).distinct()
    return distinct.withColumn(label, F.coalesce(provider_list_class(column), F.lit("nan")))
