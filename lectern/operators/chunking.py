"""Cutting text into chunks.

* :func:`chunk_fixed` – fixed-length cut, one output row per chunk, built
  by one pass of a bounded pattern + ``posexplode`` (no Python).
* :func:`notice_rows` – chunk rows decorated with their URL, with the
  text column blanked, as in the notice table.
* :func:`recursive_split` – separator-driven recursive splitter with
  overlap.  Rows no longer than the chunk size take a native fast path
  (they come out whole, only stripped); only longer rows go through an
  Arrow-batched pandas UDF.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import posexplode_rows
from ..functions.text import decorate_chunk, strip_ws
from ..params import CHUNK_LENGTH, SPLIT_OVERLAP, SPLIT_SEPARATORS, SPLIT_SIZE


def fixed_chunks(text: Column, length: int = CHUNK_LENGTH) -> Column:
    """Array of consecutive ``length``-code-point pieces; NULL for an empty
    or NULL text so that exploding it yields no row."""
    return F.when(F.length(text) > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{length}}}"), F.lit(0)))


def chunk_fixed(
    df: DataFrame,
    text_col: str,
    length: int = CHUNK_LENGTH,
    pos_col: str = "chunk_no",
    out_col: str = "chunk",
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per chunk; rows with empty or NULL text disappear."""
    keep = keep if keep is not None else [c for c in df.columns if c != text_col]
    return posexplode_rows(df, keep, fixed_chunks(F.col(text_col), length), pos_col, out_col)


def notice_rows(
    df: DataFrame,
    text_col: str = "texto",
    url_col: str = "url",
    length: int = CHUNK_LENGTH,
    keep: list[str] | None = None,
) -> DataFrame:
    """Chunk, then ``resumen = chunk + "\\nURL: " + url``; ``texto`` is
    blanked in the output, as in the stored notice table."""
    chunks = chunk_fixed(df, text_col, length, keep=keep)
    return chunks.select(
        *[c for c in chunks.columns if c not in ("chunk",)],
        F.lit("").alias(text_col),
        decorate_chunk("chunk", url_col).alias("resumen"),
    )


# --------------------------------------------------------------------------
# recursive splitter
# --------------------------------------------------------------------------


def _starts(text: str, lo: int, hi: int, sep: str) -> list[int]:
    """Where the pieces of ``text[lo:hi]`` start, and ``hi``: every
    occurrence of ``sep`` opens a piece (an empty one: every character)."""
    if not sep:
        return list(range(lo, hi + 1))
    out, at = [lo], text.find(sep, lo, hi)
    while at >= 0:
        if at > lo:
            out.append(at)
        at = text.find(sep, at + len(sep), hi)
    return [*out, hi]


def _windows(starts: list[int], size: int, overlap: int):
    """``(from, to)`` of the windows over neighbouring pieces: each takes the
    pieces that fit into ``size`` and the next one begins inside its last
    ``overlap`` characters, or later if its first new piece would not fit."""
    first, end = 0, len(starts) - 1
    while True:
        last = max(first + 1, bisect_right(starts, starts[first] + size) - 1)
        yield starts[first], starts[last]
        if last == end:
            return
        first = bisect_left(starts, max(starts[last] - overlap, starts[last + 1] - size), first, last)


def split_text(
    text: str | None,
    size: int = SPLIT_SIZE,
    overlap: int = SPLIT_OVERLAP,
    separators: tuple = SPLIT_SEPARATORS,
) -> list[str]:
    """Recursive split of one text (the per-row helper of the UDF).

    Offsets are cut at the first separator that occurs; neighbouring pieces
    shorter than ``size`` share windows, a longer piece is split by the
    separators that are left, or stays whole when none is."""
    out: list[str] = []

    def emit(lo: int, hi: int) -> None:
        if part := text[lo:hi].strip():
            out.append(part)

    def split(lo: int, hi: int, seps: tuple) -> None:
        used = next((i for i, s in enumerate(seps) if not s or text.find(s, lo, hi) >= 0), len(seps) - 1)
        left = seps[used + 1 :] if seps[used] else ()
        starts = _starts(text, lo, hi, seps[used])
        run: list[int] = []
        for a, b in zip(starts, starts[1:]):
            if b - a < size:
                run = run or [a]
                run.append(b)
                continue
            flush(run)
            run = []
            if left:
                split(a, b, left)
            else:
                out.append(text[a:b])
        flush(run)

    def flush(run: list[int]) -> None:
        if run:
            for window in _windows(run, size, overlap):
                emit(*window)

    if text:
        split(0, len(text), tuple(separators))
    return out


def _split_udf(size: int, overlap: int, separators: tuple):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split_batch(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap, separators))

    return split_batch


def recursive_split(
    df: DataFrame,
    text_col: str,
    size: int = SPLIT_SIZE,
    overlap: int = SPLIT_OVERLAP,
    separators: tuple = SPLIT_SEPARATORS,
    pos_col: str = "split_no",
    out_col: str = "split",
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per split; metadata columns in ``keep`` are carried along.

    A text of at most ``size`` characters always packs into a single window
    equal to the stripped text, so those rows never leave the JVM.
    """
    keep = keep if keep is not None else [c for c in df.columns if c != text_col]
    t = F.col(text_col)
    stripped = strip_ws(t)
    short = F.when(stripped != "", F.array(stripped)).otherwise(F.array())
    # Spark lifts Python UDFs out of conditionals and runs them on every
    # row, so short rows are handed over as NULL: only long texts cross
    # into Python.
    long_text = F.when(F.length(t) > size, t)
    pieces = F.when(F.length(t) <= size, short).otherwise(
        _split_udf(size, overlap, tuple(separators))(long_text)
    )
    return posexplode_rows(df, keep, pieces, pos_col, out_col)
