"""Packing by power-of-two decomposition of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from dialogue_factors.llm.common import batch, chunks, utf8
from dialogue_factors.llm.tokens import CHUNK_BYTES, WordEncoder, default_tokenizer
from dialogue_factors.session import materialize

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "task long, place long"
)


def binary_lengths(tokens: int, longest: int) -> list[int]:
    """Lengths of the pieces: whole sequences first, then the powers of two of the rest."""
    whole, rest = divmod(tokens, longest)
    return [longest] * whole + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack_powers_of_two(
    docs: DataFrame, tokenizer: str | None = None, longest: int = 4096, end_id: int = 2, keep_ids: bool = False,
) -> DataFrame:
    """Cut every document into pieces of power-of-two length, each a sequence of its own.

    A document's ids and `end_id` are cut into as many pieces of `longest` as go and the
    binary decomposition of the rest. A sequence holds one piece, so none crosses a
    document and none is padded. Sequences are numbered bucket by bucket, longest first
    and without gaps, so that a range of `sequence_id` is a bucket of equal lengths.

    Returns a row per piece: `doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset`, and `ids` (array) with `keep_ids`. Null or empty texts are one piece of
    `end_id`; null ids stay null; a repeated row is packed as often as it occurs. Columns
    other than `doc_id` and `text` are not read. No rows give no rows.

    Pieces are stored once; numbers come from counts per task and length, a few rows for
    each task, so nothing is ranked globally.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    path = tokenizer or default_tokenizer()
    schema = PIECES + (", ids array<long>" if keep_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = WordEncoder(path), TaskContext.get().partitionId(), {}
        for rows in batches:
            _, sizes = utf8(rows.column(1))
            for low, high in chunks(sizes, CHUNK_BYTES):
                part = rows.slice(low, high - low)
                flat, offsets = encoder.encode(part.column(1))
                out: dict[str, list] = {n.split()[0]: [] for n in schema.split(", ")}
                for i, doc_id in enumerate(part.column(0).to_pylist()):
                    ids = np.append(flat[offsets[i]:offsets[i + 1]], np.uint32(end_id)).astype("<u4")
                    start = 0
                    for length in binary_lengths(len(ids), longest):
                        place = seen.get(length, 0)
                        seen[length] = place + 1
                        piece = ids[start:start + length]
                        values = [doc_id, start, length, zlib.crc32(piece.tobytes()), len(ids), task, place]
                        for column, value in zip(out.values(), values + [piece.tolist()] * keep_ids):
                            column.append(value)
                        start += length
                yield batch(**{n: pa.array(v, pa.list_(pa.int64()) if n == "ids" else pa.int64()) for n, v in out.items()})

    pieces = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("pieces"))
    in_bucket = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = counts.withColumn("before", F.coalesce(F.sum("pieces").over(in_bucket), F.lit(0)))
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each length
    buckets = counts.groupBy("length").agg(F.sum("pieces").alias("pieces")).select(
        "length", F.coalesce(F.sum("pieces").over(longer), F.lit(0)).alias("first")
    )
    bases = by_task.join(F.broadcast(buckets), "length").select("length", "task", (F.col("first") + F.col("before")).alias("base"))
    return pieces.join(bases, ["length", "task"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        *(["ids"] if keep_ids else []),
    )
