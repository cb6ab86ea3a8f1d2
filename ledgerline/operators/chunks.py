"""Splitting documents into overlapping chunks."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from ledgerline.sources.shared import spread

# Split first on blank lines, then lines, then spaces, then characters.
SEPARATORS = ("\n\n", "\n", " ", "")

HELD_CHARS = 1 << 20  # characters of chunks that a worker holds before it passes them on

_TOKEN = re.compile(r"\w+|[^\w\s]")


def token_count(text: str) -> int:
    return len(_TOKEN.findall(text))


def recursive_chunks(documents: DataFrame, size: int, overlap: int, text: str = "text", unit: str = "chars",
                     number: str = "chunk_no", out: str = "chunk") -> DataFrame:
    """One row per chunk of at most ``size`` characters or tokens where the text allows it.

    All other columns are carried along. A document without text gives no row.
    """
    if overlap > size:
        raise ValueError(f"overlap {overlap} is larger than the chunk size {size}")
    length = {"chars": len, "tokens": token_count}[unit]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return chunk_batches(batches, text, number, out, lambda t: split_text(t, size, overlap, length))

    schema = StructType([f for f in documents.schema.fields if f.name != text]).add(number, IntegerType()).add(out, StringType())
    return spread(documents).mapInArrow(split, schema)


def chunk_batches(batches: Iterator[pa.RecordBatch], text: str, number: str, out: str, split: Callable[[str], list[str]],
                  held_chars: int = HELD_CHARS) -> Iterator[pa.RecordBatch]:
    """Rows of all columns but ``text``, with the number and text of each chunk.

    Texts become Python strings one at a time, and chunks are passed on whenever they have
    ``held_chars`` characters, so what a worker holds does not grow with its batches.
    """
    for batch in batches:
        others = [c for c in batch.schema.names if c != text]
        rows, numbers, chunks, held = [], [], [], 0

        def made():
            columns = [batch.column(c).take(pa.array(rows, pa.int64())) for c in others]
            return pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.int32()), pa.array(chunks, pa.string())], names=[*others, number, out])

        for row, cell in enumerate(batch.column(text)):
            for i, chunk in enumerate(split(t) if (t := cell.as_py()) else ()):
                rows.append(row)
                numbers.append(i)
                chunks.append(chunk)
                held += len(chunk)
                if held >= held_chars:
                    yield made()
                    rows, numbers, chunks, held = [], [], [], 0
        if rows:
            yield made()


def split_text(text: str, size: int, overlap: int, length: Callable[[str], int] = len,
               separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of one text: short pieces are packed together, long ones split further."""
    level = next(i for i, s in enumerate(separators) if not s or s in text)
    finer = separators[level + 1:]
    chunks, short = [], []
    for piece in _pieces(text, separators[level]):
        if length(piece) < size:
            short.append(piece)
            continue
        chunks += _pack(short, size, overlap, length)
        short = []
        chunks += split_text(piece, size, overlap, length, finer) if finer else [piece]
    return chunks + _pack(short, size, overlap, length)


def _pieces(text: str, separator: str) -> list[str]:
    """Parts of the text, each starting with the separator before it."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in (head, *(separator + r for r in rest)) if p]


def _pack(pieces: list[str], size: int, overlap: int, length: Callable[[str], int]) -> list[str]:
    """Join pieces up to the size; each chunk repeats the end of the one before."""
    chunks, held, total = [], deque(), 0

    def emit():
        joined = "".join(p for p, _ in held).strip()
        if joined:
            chunks.append(joined)

    for piece in pieces:
        n = length(piece)
        if held and total + n > size:
            emit()
            while held and (total > overlap or total + n > size):
                total -= held.popleft()[1]
        held.append((piece, n))
        total += n
    emit()
    return chunks


def window_chunks(documents: DataFrame, size: int, overlap: int, text: str = "text", number: str = "chunk_no",
                  out: str = "chunk") -> DataFrame:
    """Sliding window over whitespace-separated words; every word is in some chunk."""
    step = size - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the size")
    others = [c for c in documents.columns if c != text]
    blanks = " \t\r\n\f"
    trimmed = F.trim(F.col(text), F.lit(blanks))
    words = F.split(trimmed, f"[{blanks}]+")
    # The last window starts where the words after the previous one begin to be new.
    last = F.greatest(F.ceil((F.size("__w") - overlap) / step).cast("int") - 1, F.lit(0))
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("__w", i * step + 1, size), " "))
    # The windows are cut in one expression, so the word list is not copied per window.
    return (spread(documents).filter(trimmed != "").select(*others, words.alias("__w"))
            .select(*others, F.posexplode(windows).alias(number, out)))
