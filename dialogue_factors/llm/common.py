"""Helpers shared by the operators: UTF-8 buffers, row keys, checked broadcasts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

# Bytes of text that a task works on at once; a longer document is taken alone.
CHUNK_BYTES = 4 << 20
# A side of a join is broadcast up to this many bytes, counted before.
BROADCAST_BYTES = 32 << 20
NO_ID = -(1 << 63)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null is empty."""
    if column.offset:  # a slice that is cast keeps offsets which are misread
        column = column.take(pa.array(np.arange(len(column))))
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes together, one row at least."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high
        low = high


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a fixed invertible finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def batch(**columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """`doc_id`, `text` (never null) and a key of the row, safe for null and repeated ids:
    rows share a key only if they are equal in both."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key_id"),
        F.xxhash64(text).alias("key_text"), text.alias("text"), *more,
    )


def bounded(stored: DataFrame, row_bytes: int) -> DataFrame:
    """Mark a stored table for broadcast when its counted rows fit; else a plain join."""
    return F.broadcast(stored) if stored.count() * row_bytes <= BROADCAST_BYTES else stored
