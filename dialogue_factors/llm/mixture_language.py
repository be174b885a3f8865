"""Language of a document as a mixture, inferred by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dialogue_factors.llm.common import batch, chunks, mix, utf8

BUCKETS = 1 << 14
UNKNOWN = "und"


def letter_grams(text: str) -> np.ndarray:
    """Buckets of the 1- to 3-grams of letters; all else counts as one space."""
    lowered = text.lower()
    points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.unique(points)
    letter = np.array([chr(p).isalpha() for p in kinds.tolist()], bool)
    if not letter.any():
        return np.zeros(0, np.int64)
    is_letter = letter[np.searchsorted(kinds, points)]
    points = np.where(is_letter, points, 32).astype(np.uint64)
    points = points[np.concatenate([[True], is_letter[1:] | is_letter[:-1]])]
    points = np.concatenate([[32], points, [32]]).astype(np.uint64)
    bigram = points[:-1] << np.uint64(21) | points[1:]
    trigram = bigram[:-1] << np.uint64(21) | points[2:]
    keys = np.concatenate([points[1:-1], bigram | np.uint64(1 << 62), trigram | np.uint64(1 << 63)])
    return (mix(keys) >> np.uint64(50)).astype(np.int64)


def gram_counts(texts: list[str | None]) -> Iterator[np.ndarray | None]:
    """Counts by bucket, or None for a text without letters. Long texts go in steps."""
    for text in texts:
        total, step = None, 1 << 20
        for i in range(0, len(text or ""), step):
            grams = letter_grams(text[i:i + step])
            if len(grams):
                counts = np.bincount(grams, minlength=BUCKETS)
                total = counts if total is None else total + counts
        yield total


def train(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Log-probabilities (languages x buckets) learned from all `text`, `lang` rows.

    Tasks add up counts by language and pass on what each has seen; the model has
    `BUCKETS` numbers for each language. Rows with a null text or lang teach nothing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for part in batches:
            for lang, counts in zip(part.column(1).to_pylist(), gram_counts(part.column(0).to_pylist())):
                if counts is not None:
                    totals[lang] = totals.get(lang, 0) + counts
        for lang, counts in totals.items():
            seen = np.flatnonzero(counts)
            yield batch(lang=pa.array([lang] * len(seen)), bucket=pa.array(seen.astype(np.int32)), n=pa.array(counts[seen]))

    counted = rows.where("text is not null and lang is not null").select("text", "lang").mapInArrow(count, "lang string, bucket int, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    langs = sorted(table.lang.unique())
    counts = np.full((len(langs), BUCKETS), 0.5)
    counts[[langs.index(x) for x in table.lang], table.bucket.to_numpy(int)] += table.n.to_numpy(float)
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True))


def proportions(counts: np.ndarray, likelihood: np.ndarray, steps: int = 25, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """EM for the shares of the languages in n-grams with these likelihoods (languages x
    n-grams); also the log-likelihood. A step is two products of a matrix and a vector."""
    languages, all_counts = len(likelihood), counts.sum()
    share = np.full(languages, 1.0 / languages)
    for _ in range(steps):
        updated = share * (likelihood @ (counts / (share @ likelihood))) / all_counts
        moved = np.abs(updated - share).max()
        share = updated
        if moved < tolerance:
            break
    return share, float(counts @ np.log(share @ likelihood))


def infer_mixture(counts: np.ndarray, logs: np.ndarray, penalty: float = 3.0) -> np.ndarray:
    """Shares of the languages of one document.

    Starts from all languages and drops the one of the least share as long as the
    log-likelihood, less `penalty` x log(n-grams) for each language, does not fall; a
    single language that beats the rest by more than that is taken at once.
    """
    seen = np.flatnonzero(counts)
    c, l = counts[seen].astype(float), logs[:, seen]
    shifted = l - l.max(axis=0)
    likelihood = np.exp(shifted)
    cost = penalty * np.log(c.sum() + 1.0)
    single = shifted @ c
    chosen = np.arange(logs.shape[0])
    share, value = proportions(c, likelihood)
    while len(chosen) > 1:
        if len(chosen) == 2:
            best = chosen[np.argmax(single[chosen])]
            fewer, fit, fitted = np.array([best]), np.ones(1), single[best]
        else:
            fewer = np.delete(chosen, np.argmin(share))
            fit, fitted = proportions(c, likelihood[fewer])
        if fitted - cost * len(fewer) < value - cost * len(chosen):
            break
        chosen, share, value = fewer, fit, fitted
    out = np.zeros(logs.shape[0])
    out[chosen] = share
    return out


def identify(docs: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """`doc_id, lang_pred, score, languages`: the language of the largest share, that
    share, and all shares. A null text, a text without letters, or an empty model give
    `und` and 0. Equal shares go to the first language by name. Only the text is read.
    """
    model = docs.sparkSession.sparkContext.broadcast(logs.astype(np.float32))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = model.value.astype(float)
        for rows in batches:
            _, sizes = utf8(rows.column(1))
            for low, high in chunks(sizes):
                part = rows.slice(low, high - low)
                names, scores, mixtures = [], [], []
                for counts in gram_counts(part.column(1).to_pylist()):
                    share = infer_mixture(counts, logs) if counts is not None and langs else np.zeros(1)
                    best = int(share.argmax())
                    names.append(langs[best] if share[best] > 0 else UNKNOWN)
                    scores.append(min(1.0, float(share[best])))
                    mixtures.append([(langs[k], float(share[k])) for k in np.flatnonzero(share).tolist()] if langs else [])
                yield batch(
                    doc_id=part.column(0), lang_pred=pa.array(names, pa.string()), score=pa.array(scores, pa.float64()),
                    languages=pa.array(mixtures, pa.map_(pa.string(), pa.float64())),
                )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(predict, "doc_id long, lang_pred string, score double, languages map<string,double>")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def predict_languages(docs: DataFrame) -> DataFrame:
    """Train on the rows that are not held out, predict all: `doc_id, held_out,
    lang_pred, score, languages`. A null id is not held out."""
    langs, logs = train(docs.where(~held_out()))
    return identify(docs, langs, logs).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "languages")
