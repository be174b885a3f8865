"""Word vectors learned from a corpus: co-occurrence counts, pointwise mutual information,
and a randomised factorisation; texts as weighted means of them.

What a task or the driver holds depends on the size of the vocabulary and of the vectors,
both settings, never on the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from dialogue_factors.config import FIRST_TOKEN_ID, Settings
from dialogue_factors.functions.matrices import as_lists, as_matrix
from dialogue_factors.functions.text import CHUNK_BYTES, text_chunks, token_lists
from dialogue_factors.operators.encode import build_vocabulary
from dialogue_factors.session import materialize


# Pairs that a counting task holds before it passes on those met once.
HELD_PAIRS = 4_000_000


def word_table(texts: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """`(word, token, n)`: the most frequent words, numbered from 0 by count and then name."""
    counted = build_vocabulary(texts, text, replace(settings, vocabulary_size=settings.word_vocabulary))
    return materialize(counted.select((F.col("id") - FIRST_TOKEN_ID).cast("int").alias("word"), "token", "n"), "words")


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their totals."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(n[order], heads) if len(keys) else n


def pairs_of_tasks(texts: DataFrame, known: pa.Array, text: str = "text", window: int = Settings().word_window) -> DataFrame:
    """`(pair, n)`: pairs of known words at most `window` places apart, both orders as one:
    the lower number x words + the higher. A task holds what it has seen; pairs met more
    than once stay until its end, as long as they are few enough."""

    def pairs(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for part in (part for batch in batches for part in text_chunks(batch.column(0), CHUNK_BYTES)):
            tokens, rows, _ = token_lists(part)
            ids = pc.fill_null(pc.index_in(tokens.cast(known.type), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            for step in range(1, window + 1):
                left, right = ids[:-step], ids[step:]
                both = (left >= 0) & (right >= 0) & (rows[:-step] == rows[step:])
                left, right = left[both], right[both]
                held.append(np.unique(np.minimum(left, right) * len(known) + np.maximum(left, right), return_counts=True))
            if sum(len(keys) for keys, _ in held) > HELD_PAIRS:
                keys, n = _summed(*map(np.concatenate, zip(*held)))
                stay = n > 1 if np.count_nonzero(n > 1) <= HELD_PAIRS // 2 else np.zeros(len(n), bool)
                yield pairs(keys[~stay], n[~stay])
                held = [(keys[stay], n[stay])]
        yield pairs(*_summed(*map(np.concatenate, zip(*held))))

    return texts.select(F.lower(text)).mapInArrow(count, "pair bigint, n bigint")


def count_pairs(texts: DataFrame, words: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """`(word, context, n)`: how often two words of the table lie at most `word_window`
    places apart in a text, in both orders. Other words take up places.

    Pairs are counted per task before the shuffle, both orders as one, so that the pairs of
    frequent words come to the reducers as one number per task; the second order is added
    behind the shuffle.
    """
    known = words.orderBy("word").select("token").toArrow().column(0).combine_chunks()
    # Tasks have added up already, so that rows are grouped behind the shuffle only.
    counted = pairs_of_tasks(texts, known, text, settings.word_window).repartition("pair").groupBy("pair").agg(F.sum("n").alias("n"))
    size = max(len(known), 1)
    low, high = (F.col("pair") / size).cast("int"), F.pmod("pair", F.lit(size)).cast("int")
    entry = lambda word, context, n: F.struct(word.alias("word"), context.alias("context"), n.alias("n"))
    n = F.col("n")
    orders = F.when(low == high, F.array(entry(low, high, 2 * n))).otherwise(F.array(entry(low, high, n), entry(high, low, n)))
    return counted.select(F.inline(orders))


def positive_pmi(pairs: DataFrame) -> DataFrame:
    """`(word, context, n, pmi)` of the pairs that are met more often than by chance:
    ln(n N / (n_word n_context)) above 0. `pairs` should be stored."""
    margins = materialize(pairs.groupBy("word").agg(F.sum("n").alias("margin")), "margins")
    total = margins.agg(F.sum("margin")).first()[0] or 0
    # One row per word of the vocabulary.
    side = lambda name: F.broadcast(margins.select(F.col("word").alias(name), F.col("margin").cast("double").alias(f"of_{name}")))
    pmi = F.log(F.col("n") * F.lit(float(total)) / (F.col("of_word") * F.col("of_context")))
    return pairs.join(side("word"), "word").join(side("context"), "context").select("word", "context", "n", pmi.alias("pmi")).where("pmi > 0")


def _times(rows: DataFrame, matrix: np.ndarray) -> np.ndarray:
    """The sparse rows `(word, contexts, values)` times a matrix of one row per word."""
    shared = rows.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = shared.value
        for batch in batches:
            contexts, values = batch.column("contexts"), batch.column("values")
            out = np.zeros((batch.num_rows, dense.shape[1]))
            for i in range(batch.num_rows):
                out[i] = values[i].values.to_numpy() @ dense[contexts[i].values.to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), as_lists(out)], ["word", "product"])

    product = np.zeros_like(matrix)
    found = rows.mapInArrow(run, "word int, product array<double>").toArrow()
    if found.num_rows:
        product[found.column("word").to_numpy()] = as_matrix(found.column("product"))
    shared.unpersist()
    return product


def factorise(pmi: DataFrame, words: int, settings: Settings = Settings()) -> np.ndarray:
    """(words, word_dims) vectors whose inner products come nearest to the matrix of `pmi`.

    A random block is multiplied by the matrix and made orthogonal `word_rounds` times,
    which finds the range of its largest eigenvalues; the rest is a small eigenproblem.
    The matrix stays a table of sparse rows; the driver holds words x dims numbers.
    """
    sparse = pmi.groupBy("word").agg(F.collect_list(F.struct("context", "pmi")).alias("run")).select(
        "word", F.col("run.context").alias("contexts"), F.col("run.pmi").alias("values")
    )
    rows = materialize(sparse, "pmi")  # a row holds at most one entry per word
    block = min(words, settings.word_dims + 10)
    basis = np.random.default_rng(settings.seed).standard_normal((words, block))
    for _ in range(settings.word_rounds):
        basis, _ = np.linalg.qr(_times(rows, basis))
    small = basis.T @ _times(rows, basis)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-np.abs(values))[:settings.word_dims]
    vectors = basis @ turn[:, best] * np.sqrt(np.abs(values[best]))
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return vectors * np.where(signs == 0, 1, signs)


def fit_word_vectors(texts: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """`(word, token, n, vector)`, stored: vectors of the corpus's frequent words."""
    words = word_table(texts, text, settings)
    known = words.orderBy("word").toArrow()
    if not known.num_rows:
        return words.withColumn("vector", F.lit(None).cast("array<double>"))
    pairs = materialize(count_pairs(texts, words, text, settings), "pairs")
    vectors = factorise(positive_pmi(pairs), known.num_rows, settings)
    table = known.append_column("vector", as_lists(vectors))
    return materialize(texts.sparkSession.createDataFrame(table, schema="word int, token string, n bigint, vector array<double>"), "word-vectors")


def mean_word_vector(text: Column | str, words: pa.Table, smoothing: float) -> Column:
    """Mean vector of a text's known words, rare ones weighing more, at unit length (zero
    where no word is known)."""
    known, matrix = words.column("token").combine_chunks(), as_matrix(words.column("vector"))
    share = words.column("n").to_numpy() / max(words.column("n").to_numpy().sum(), 1)
    weighted = matrix * (smoothing / (smoothing + share))[:, None]

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for part in text_chunks(texts, CHUNK_BYTES):
            tokens, rows, _ = token_lists(part)
            found = pc.index_in(tokens.cast(known.type), value_set=known)
            hit = found.is_valid().to_numpy(zero_copy_only=False)
            keys, n = np.unique(rows[hit] * len(known) + found.drop_null().to_numpy(), return_counts=True)
            total = np.zeros((len(part), weighted.shape[1]))
            for low in range(0, len(keys), 50_000):
                some = keys[low:low + 50_000]
                row, first = np.unique(some // len(known), return_index=True)
                total[row] += np.add.reduceat(weighted[some % len(known)] * n[low:low + 50_000, None], first)
            length = np.sqrt(np.einsum("ij,ij->i", total, total))
            out.append(as_lists(total / np.where(length > 0, length, 1.0)[:, None]))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.float64()))

    return run(F.lower(text))


def encode_with_words(
    texts: DataFrame, keys: str | Sequence[str], words: DataFrame, text: str = "text", settings: Settings = Settings(),
) -> DataFrame:
    """`(keys, embedding)` of any texts by the word vectors of `fit_word_vectors`."""
    model = words.orderBy("word").select("token", "n", "vector").toArrow()
    keys = [keys] if isinstance(keys, str) else list(keys)
    if not model.num_rows:
        raise ValueError("no word vectors")
    return texts.select(*keys, mean_word_vector(text, model, settings.word_smoothing).alias("embedding"))
