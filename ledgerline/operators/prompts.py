"""From ranked chunks and chat history to prompts."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import fixed_values as fixed
from ledgerline.functions.columns import ColumnLike, col
from ledgerline.functions.text import snippet


def contexts(hits: DataFrame, query_id: str, text: str, rank: str = "rank", out: str = "context") -> DataFrame:
    """Texts of the ranked chunks of each query, in rank order, joined by a blank line.

    The hits of a query are as many as were asked for in the search.
    """
    ranked = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(text).alias("t"))))
    return hits.groupBy(query_id).agg(F.array_join(F.transform(ranked, lambda s: s.t), "\n\n").alias(out))


def render(template: str, values: Mapping[str, ColumnLike]) -> Column:
    """Fill ``{name}`` places of a template; braces inside the values are left alone."""
    parts = re.split(r"\{(\w+)\}", template)
    missing = {p for p in parts[1::2]} - set(values)
    if missing:
        raise ValueError(f"no value for {sorted(missing)}")
    pieces = [F.coalesce(col(values[p]).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)]
    return F.concat(*pieces)


def last_turns(turns: DataFrame, conversation: str, turn: str, k: int | None) -> DataFrame:
    """The last k turns of each conversation (None: all); the limit applies before the exchange too."""
    if k is None:
        return turns
    w = Window.partitionBy(conversation).orderBy(F.desc(turn))
    return turns.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


def turn_text(role: str = "role", text: str = "text", names: Mapping[str, str] | None = None) -> Column:
    """One turn as a line of a transcript."""
    speaker = col(role)
    for value, name in (names or {}).items():
        speaker = F.when(col(role) == value, F.lit(name)).otherwise(speaker)
    return F.concat(speaker, F.lit(": "), F.col(text))


def history_turns(turns: DataFrame, names: Mapping[str, str] | None = None, role: str = "role", text: str = "text",
                  out: str = "line") -> DataFrame:
    """The whole buffer, one transcript line per turn."""
    return turns.withColumn(out, turn_text(role, text, names))


def histories(turns: DataFrame, conversation: str, turn: str, k: int | None, names: Mapping[str, str] | None = None,
              role: str = "role", text: str = "text", out: str = "chat_history") -> DataFrame:
    """Transcript of the last k turns (None: all) per conversation, oldest first."""
    lines = history_turns(last_turns(turns, conversation, turn, k), names, role, text)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("n"), F.col("line").alias("t"))))
    return lines.groupBy(conversation).agg(F.array_join(F.transform(ordered, lambda s: s.t), "\n").alias(out))


def source_report(hits: DataFrame, query_id: str, text: str, source: str = "source", rank: str = "rank",
                  unknown: str = fixed.SOURCE_UNKNOWN, length: int = 512) -> DataFrame:
    """Where each used chunk came from, with a display snippet."""
    return hits.select(query_id, rank, F.coalesce(source, F.lit(unknown)).alias("source"),
                       snippet(text, length).alias("snippet"))
