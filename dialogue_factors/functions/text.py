"""Text expressions of built-in Spark functions, and words of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from dialogue_factors.config import WHITESPACE

# Bytes of text whose words a task lays out at once; a longer text is taken alone.
CHUNK_BYTES = 4 << 20


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column | str) -> Column:
    """Remove all Unicode whitespace from both ends (plain `trim` removes spaces only)."""
    return F.btrim(_col(text), F.lit(WHITESPACE))


def clean(text: Column | str) -> Column:
    return F.lower(strip(text))


def text_chunks(texts: pa.Array, limit: int) -> Iterator[pa.Array]:
    """Slices of at most `limit` bytes of text together, one row at least."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < len(texts):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield texts.slice(low, high - low)
        low = high


def token_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of lower-cased texts: maximal runs of letters and digits.

    Returns all words in order, the row of each, and its position within the row.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    pieces = pc.split_pattern_regex(texts.fill_null("").cast(pa.large_string()), r"[^\p{L}\p{N}]+")
    flat, sizes = pieces.flatten(), np.diff(pieces.offsets.to_numpy())
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(texts)), sizes)[real]
    per_row = np.bincount(rows, minlength=len(texts))
    position = np.arange(len(rows)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    return flat.filter(pa.array(real)), rows, position


def seeded_hash(seed: int | str, *keys: Column | str) -> Column:
    """md5 hex of `seed:key[:key...]`: a random order every engine agrees on."""
    parts = [F.lit(str(seed))] + [_col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def hash_number(hex_digest: Column) -> Column:
    """First 32 bits of a hex digest as a non-negative bigint."""
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("bigint")
