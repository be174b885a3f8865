"""Text to vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from dialogue_factors.config import Settings
from dialogue_factors.functions.matrices import as_lists, map_rows
from dialogue_factors.functions.text import CHUNK_BYTES, text_chunks, token_lists

Encoder = Callable[[list[str]], np.ndarray]


def bucket_counts(text: Column | str, dims: int) -> Column:
    """Words of the whole text counted by hash bucket, the md5's first 32 bits mod `dims`."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for part in text_chunks(texts, CHUNK_BYTES):
            words, rows, _ = token_lists(part)
            coded = words.dictionary_encode()
            # Each distinct word of the chunk is hashed once.
            bucket = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dims for w in coded.dictionary.to_pylist()]
            at = rows * dims + np.array(bucket, dtype=np.int64)[coded.indices.to_numpy()]
            out.append(as_lists(np.bincount(at, minlength=len(part) * dims).reshape(len(part), dims)))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.float64()))

    return run(F.lower(text))


def merge_parts(counts: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Add up the vectors of keys that span several parts; others pass unshuffled.

    `counts` carries `parts`, the number of parts of the row's key.
    """
    single = counts.where("parts = 1").select(*keys, column)
    several = (
        counts.where("parts > 1").groupBy(*keys)
        .agg(vector_to_array(Summarizer.sum(array_to_vector(column))).alias(column))
    )
    return single.unionByName(several)


def inverse_document_frequency(counts: DataFrame, column: str = "counts") -> np.ndarray:
    """ln((n + 1) / (rows holding the bucket + 1)), one value per bucket."""
    vector = array_to_vector(column)
    # Grouped by a constant, so that an empty table gives no row instead of failing.
    row = counts.groupBy(F.lit("all")).agg(
        F.count(F.lit(1)).alias("n"),
        vector_to_array(Summarizer.numNonZeros(vector)).alias("holding"),
    ).first()
    return np.log((row.n + 1.0) / (np.asarray(row.holding) + 1.0)) if row else np.zeros(0)


def _hashed_counts(texts: DataFrame, keys: Sequence[str], text: str, dims: int) -> DataFrame:
    columns = [*keys, *(c for c in ("parts",) if c in texts.columns and c not in keys)]
    counts = texts.select(*columns, bucket_counts(text, dims).alias("counts"))
    return merge_parts(counts, keys, "counts") if "parts" in columns else counts


def hashed_idf(
    texts: DataFrame, keys: str | Sequence[str], text: str = "text", settings: Settings = Settings(), dims: int | None = None
) -> np.ndarray:
    """The term weights that `hashed_tfidf` takes from `texts`, to be kept or given to it."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return inverse_document_frequency(_hashed_counts(texts, keys, text, dims or settings.text_dims))


def hashed_tfidf(
    texts: DataFrame, keys: str | Sequence[str], text: str = "text", settings: Settings = Settings(),
    dims: int | None = None, idf: np.ndarray | None = None,
) -> DataFrame:
    """`(keys, embedding)`: hashed term counts times inverse document frequency, unit length.

    Texts never leave their rows: two passes and no shuffle but that of one
    vector of bucket frequencies; one pass with given weights `idf`, whose number is then
    the width. With a `parts` column, parts of a key add up.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    counts = _hashed_counts(texts, keys, text, dims or (settings.text_dims if idf is None else len(idf)))
    if idf is None:
        idf = inverse_document_frequency(counts)

    def weigh(x: np.ndarray) -> np.ndarray:
        w = x * idf
        length = np.sqrt(np.einsum("ij,ij->i", w, w))
        return w / np.where(length > 0, length, 1.0)[:, None]

    return counts.select(*keys, map_rows("counts", weigh).alias("embedding"))


def encode_texts(texts: DataFrame, key: str, text: str, load_encoder: Callable[[], Encoder]) -> DataFrame:
    """`(key, embedding)`, one row per key, from any encoder; `load_encoder` runs once per task.

    The encoder maps a list of texts to a matrix. Weights are the caller's. Rows of one
    key, such as the parts of a long persona, are averaged by their length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load_encoder()
        for batch in batches:
            vectors = np.asarray(encoder(batch[text].tolist()), dtype=float)
            length = batch[text].str.len().fillna(0).clip(lower=1).astype(float)
            yield pd.DataFrame({key: batch[key], "part": list(vectors), "length": length})

    key_type = texts.schema[key].dataType.simpleString()
    encoded = texts.select(key, text).mapInPandas(run, f"{key} {key_type}, part array<double>, length double")
    averaged = Summarizer.mean(array_to_vector("part"), F.col("length"))
    return encoded.groupBy(key).agg(vector_to_array(averaged).alias("embedding"))
