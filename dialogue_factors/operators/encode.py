"""Token ids of fixed length over a vocabulary learned from the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from dialogue_factors.config import END_ID, FIRST_TOKEN_ID, PAD_ID, START_ID, UNKNOWN_ID, Settings
from dialogue_factors.functions.text import CHUNK_BYTES, text_chunks, token_lists
from dialogue_factors.session import materialize

# Longer words are known to tasks by digest, which bounds the size of a vocabulary.
LONGEST_WORD = 64


def count_tokens(texts: DataFrame, text: str = "text") -> DataFrame:
    """`(token, n)` over whole texts, added up per batch before the shuffle."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pc.value_counts(token_lists(part)[0]) for part in text_chunks(batch.column(0), CHUNK_BYTES)]
            tables = [pa.table([f.field("values"), f.field("counts")], ["token", "n"]) for f in found]
            if tables:
                summed = pa.concat_tables(tables).group_by("token").aggregate([("n", "sum")])
                columns = [summed.column("token").cast(pa.string()), summed.column("n_sum")]
                yield from pa.table(columns, ["token", "n"]).to_batches()

    partial = texts.select(F.lower(text)).mapInArrow(counts, "token string, n bigint")
    return partial.groupBy("token").agg(F.sum("n").alias("n"))


def build_vocabulary(texts: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """`(token, n, id)`: the most frequent tokens of the whole corpus, ties by token.

    A histogram of the counts' binary lengths (64 rows at most) tells which counts
    can make it, so that only tokens near the top are sorted.
    """
    counted = materialize(count_tokens(texts, text), "token-counts")
    digits = F.length(F.bin("n"))
    need, least = settings.vocabulary_size, 1
    for row in counted.groupBy(digits.alias("digits")).agg(F.count(F.lit(1)).alias("tokens")).orderBy(F.desc("digits")).collect():
        need, least = need - row.tokens, 2 ** (row.digits - 1)
        if need <= 0:
            break
    top = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(settings.vocabulary_size)
    # Numbering runs over the vocabulary alone, whose size is a setting.
    return top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "token")) - 1 + FIRST_TOKEN_ID)


def _short_form(token: Column | str) -> Column:
    return F.when(F.length(token) <= LONGEST_WORD, F.col(token)).otherwise(F.concat(F.lit("#"), F.md5(token)))


def token_ids(text: Column | str, words: pa.Array, length: int) -> Column:
    """Start mark, ids of the leading tokens, end mark, padding up to `length`."""

    def encoded(texts: pa.Array) -> pa.Array:
        tokens, rows, position = token_lists(texts)
        kept = position < length - 2
        tokens, rows, position = tokens.filter(pa.array(kept)).cast(pa.string()), rows[kept], position[kept]
        long = pc.greater(pc.utf8_length(tokens), LONGEST_WORD)
        if pc.any(long).as_py():
            digests = ["#" + hashlib.md5(w.encode()).hexdigest() for w in tokens.filter(long).to_pylist()]
            tokens = pc.replace_with_mask(tokens, long, pa.array(digests))
        found = pc.index_in(tokens, value_set=words)
        ids = pc.fill_null(pc.add(found, FIRST_TOKEN_ID), UNKNOWN_ID).to_numpy(zero_copy_only=False)
        out = np.full((len(texts), length), PAD_ID, dtype=np.int32)
        out[:, 0] = START_ID
        out[rows, position + 1] = ids
        out[np.arange(len(texts)), np.bincount(rows, minlength=len(texts)) + 1] = END_ID
        offsets = pa.array(np.arange(len(texts) + 1) * length, pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        out = [encoded(part) for part in text_chunks(texts, CHUNK_BYTES)]
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    return run(F.lower(text))


def encode_tokens(texts: DataFrame, text: str = "text", vocabulary: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """Add `input_ids` and `attention_mask` of `max_tokens` entries each.

    Truncation to `max_tokens` is the encoding's own; the vocabulary counts whole
    texts. Rows need no shuffle: tasks hold the vocabulary, a bounded list.
    """
    words = vocabulary if vocabulary is not None else build_vocabulary(texts, text, settings)
    known = words.orderBy("id").select(_short_form("token").alias("w")).toArrow().column("w").combine_chunks()
    return texts.withColumn("input_ids", token_ids(text, known, settings.max_tokens)).withColumn(
        "attention_mask", F.transform("input_ids", lambda i: (i != PAD_ID).cast("int"))
    )
