"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.storage import settle, shared_dir

__all__ = ["WHITE", "WHITE_RE", "WORD_RE", "free_name", "if_small", "settle", "shared_dir", "signed", "store", "text_slices", "word_count", "words"]

#: ASCII white space; a word is a maximal run of anything else.
WHITE = b" \t\n\x0b\x0c\r"
WHITE_RE = r"[\x20\x09-\x0D]"
WORD_RE = r"[^\x20\x09-\x0D]+"


def store(frame: DataFrame, label: str) -> DataFrame:
    """Write a wide table as Parquet in the shared folder and read it again."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/logloom-{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.parquet(path)


def text_slices(batches: Iterable[pa.RecordBatch], column: int, most_bytes: int = 2 << 20, most_rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices with bounded rows and bytes of text in ``column`` (a longer text is a slice of its own)."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            room = (ends[start - 1] if start else 0) + most_bytes
            end = min(max(start + 1, int(np.searchsorted(ends, room, "right"))), start + most_rows)
            yield batch.slice(start, end - start)
            start = end


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """Array of words; null text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE_RE + "+"), "")


def if_small(frame: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """Mark a narrow table for broadcast if its counted rows are within ``limit``; else leave the join to Spark."""
    return F.broadcast(frame) if rows <= limit else frame


def free_name(taken: list[str], want: str) -> str:
    """``want``, with underscores added until no column has that name (case is ignored)."""
    low = {x.lower() for x in taken}
    while want.lower() in low:
        want += "_"
    return want


def signed(value: int) -> int:
    """Unsigned 64-bit integer as Spark's long."""
    return value - (1 << 64) if value >> 63 else value
