"""Run a registered query and its SQL on the same tables and compare all rows."""

from __future__ import annotations

import math
import os

import duckdb

from ledgerline.queries import QUERIES, SQL
from ledgerline.queries.registry import SCHEMAS


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(sf_dir, name)}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def _kind(duck_type: str) -> str:
    t = str(duck_type).lower()
    return {"bigint": "bigint", "integer": "int", "varchar": "string", "double": "double", "boolean": "boolean",
            "timestamp": "timestamp_ntz", "date": "date", "float": "float"}.get(t, t)


def compare(spark, con, name: str, sf_dir: str) -> tuple[int, list[str]]:
    """Number of rows and a list of differences (empty when equal)."""
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    rel = con.execute(SQL[name])
    columns = [d[0] for d in rel.description]
    types = {d[0]: _kind(d[1]) for d in rel.description}
    want = rel.fetchall()
    problems = []
    if sorted(columns) != sorted(df.columns):
        return len(got), [f"columns {sorted(df.columns)} != {sorted(columns)}"]
    spark_types = dict(df.dtypes)
    for c in columns:
        if spark_types[c] != types[c]:
            problems.append(f"type of {c}: {spark_types[c]} != {types[c]}")
    order = sorted(columns)
    mine = sorted(tuple(_cell(r[c]) for c in order) for r in got)
    theirs = sorted(tuple(_cell(r[columns.index(c)]) for c in order) for r in want)
    if len(mine) != len(theirs):
        problems.append(f"rows {len(mine)} != {len(theirs)}")
    if mine != theirs:
        a, b = set(mine), set(theirs)
        problems.append(f"only mine {sorted(a - b)[:3]} only sql {sorted(b - a)[:3]} ({len(a - b)}/{len(b - a)})")
    return len(got), problems
