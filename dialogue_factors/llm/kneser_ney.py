"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from dialogue_factors.llm.common import batch, bounded, chunks, keyed, mix
from dialogue_factors.session import materialize

ORDER = 5
BITS = 12  # of a symbol; a key of five symbols fits a long
SYMBOLS = 1 << BITS
START = 0
# Entries of a shard of the model, broadcast one at a time. The driver collects a shard in
# some copies of 13 bytes an entry, in Spark and in Python, so that they set its memory.
SHARD_ENTRIES = 500_000
# Symbols of a stretch of text that is judged by itself.
STRETCH = 8
# What a word says for the toxic model counts above the first and up to the second of these.
WORD_EVIDENCE = (0.5, 3.0)
# Distinct n-grams that a counting task holds before it passes them on.
HELD_NGRAMS = 4_000_000
# Bytes of texts that are scored together: each shard is read once for them.
CHUNK = 1 << 21
# Symbols that are counted, looked up or judged at once: all beyond keys and values of a
# chunk, some twenty arrays, has this length. A longer text is taken alone.
PIECE = 1 << 18


def mask(order: int) -> int:
    return (1 << BITS * order) - 1


def symbols(text: str) -> np.ndarray:
    """Code points as symbols: 1 to 3071 as they are, the rest hashed into 1,024 more."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 3072, np.maximum(points, 1), 3072 + points % 1024).astype(np.uint16)


def ngram_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The five-symbol key of every character of all texts, and the offsets of each.
    A text is preceded by start symbols."""
    pad = np.full(ORDER - 1, START, np.uint16)
    parts = [symbols(t) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    flat = np.concatenate([x for p in parts for x in (pad, p)] + [np.zeros(0, np.uint16)])
    del parts
    keys = np.zeros(max(len(flat) - ORDER + 1, 0), np.int64)
    for j in range(ORDER):
        keys <<= BITS
        keys |= flat[j:j + len(keys)]
    # The key at place i ends at i + 4; keys that end in padding are left out.
    real = np.ones(len(flat), bool)
    real[((np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1))[:, None] + np.arange(ORDER - 1)).ravel()] = False
    return keys[real[ORDER - 1:]], np.concatenate([[0], np.cumsum(sizes)])


def _texts(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for rows in batches:
        sizes = pc.fill_null(pc.binary_length(rows.column(column)), 0).to_numpy()
        for low, high in chunks(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), limit):
            part = rows.slice(low, high - low)
            yield part, [t or "" for t in part.column(column).to_pylist()]


def count_ngrams(trusted: DataFrame) -> DataFrame:
    """`part, key, n`: how often each five-symbol sequence occurs in all texts of a part. A
    task adds up what it has seen before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(part: int) -> tuple[np.ndarray, np.ndarray]:
            keys, n = (np.concatenate(some) for some in zip(*held.pop(part)))
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            heads = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
            return keys[heads], np.add.reduceat(n, heads) if len(heads) else n

        def rows_of(part: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return batch(part=pa.array(np.full(len(keys), part, np.int32)), key=pa.array(keys), n=pa.array(n))

        for rows, texts in _texts(batches, 0, PIECE):
            keys, offsets = ngram_keys(texts)
            owner = np.repeat(rows.column(1).to_numpy(), np.diff(offsets))
            for part in np.unique(owner).tolist():
                held.setdefault(part, []).append(np.unique(keys[owner == part], return_counts=True))
            if sum(len(k) for some in held.values() for k, _ in some) > HELD_NGRAMS:
                for part in list(held):
                    held[part] = [merged(part)]
                if sum(len(some[0][0]) for some in held.values()) > HELD_NGRAMS // 2:
                    for part in list(held):
                        yield rows_of(part, *held.pop(part)[0])
        for part in list(held):
            yield rows_of(part, *merged(part))

    part = F.col("part").cast("int") if "part" in trusted.columns else F.lit(0)
    counted = trusted.select("text", part.alias("part")).mapInArrow(count, "part int, key long, n long")
    return counted.groupBy("part", "key").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame, models: int) -> list[list[float]]:
    """For each model, discounts of counts 1, 2 and 3 or more, from the number of n-grams of
    each count."""
    have = {(r.model, r.n): r.types for r in counts.where("n <= 4").groupBy("model", "n").agg(F.count("*").alias("types")).collect()}
    out = []
    for model in range(models):
        n1, n2, n3, n4 = (have.get((model, i), 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        out.append([min(max(d, 0.1), i + 0.9) for i, d in enumerate(raw)])
    return out


@dataclass(frozen=True)
class Model:
    """`entries` (stored): `model, order, context, key, value`: the natural logarithm of an
    n-gram's probability, or of a context's weight for lower orders; those of a fold make
    `shards` of bounded size. `floor`: for each model, that of a symbol never seen. `taught`: which models have
    seen any text."""

    entries: DataFrame
    shards: int
    floor: np.ndarray
    taught: np.ndarray


def shard_of(pair: Column, shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned(pair * F.lit(0x9E3779B1), 8), F.lit(shards))


def fit(trusted: DataFrame, folds: int = 1, models: int = 1) -> Model:
    """Interpolated modified Kneser-Ney of order five over characters.

    Five-grams have their counts; a shorter n-gram counts the different symbols before it.
    Each order joins its counts with the totals of their contexts and with the
    probabilities of the next lower order; all joins are keyed by n-gram.

    With `folds`, the column `part` (under `models`) numbers the folds of each kind of text,
    kind after kind, and the model of a part learns from the other folds of its kind.
    """
    parts = materialize(count_ngrams(trusted), "ngrams")
    if folds > 1:
        others = F.array(*[F.lit(i) for i in range(1, folds)])
        fold = F.col("part") % folds
        parts = parts.withColumn("by", F.explode(others)).select(
            (F.col("part") - fold + (fold + F.col("by")) % folds).alias("model"), "key", "n"
        ).groupBy("model", "key").agg(F.sum("n").alias("n"))
        counts = {ORDER: materialize(parts, "ngrams")}
    else:
        counts = {ORDER: parts.withColumnRenamed("part", "model")}
    for order in range(ORDER - 1, 0, -1):
        shorter = counts[order + 1].groupBy("model", F.col("key").bitwiseAND(F.lit(mask(order))).alias("key")).agg(F.count("*").alias("n"))
        counts[order] = materialize(shorter, "ngrams")
    parts, lower = [], None
    floor, taught = np.full(models, np.log(1 / SYMBOLS)), np.zeros(models, bool)
    for order in range(1, ORDER + 1):
        discounts = F.array(*[F.lit(d) for three in _discounts(counts[order], models) for d in three])
        grams = counts[order].withColumn("d", F.element_at(discounts, (F.col("model") * 3 + F.least("n", F.lit(3))).cast("int"))).withColumn("ctx", F.shiftright("key", BITS))
        contexts = grams.groupBy("model", "ctx").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("weight"))
        grams = grams.join(contexts, ["model", "ctx"])
        own = (F.col("n") - F.col("d")) / F.col("total")
        if order == 1:
            for row in contexts.collect():
                floor[row.model], taught[row.model] = np.log(row.weight / SYMBOLS), True
            grams = grams.select("model", "key", (own + F.col("weight") / SYMBOLS).alias("p"))
        else:
            grams = grams.withColumn("suffix", F.col("key").bitwiseAND(F.lit(mask(order - 1)))).join(
                lower.select("model", F.col("key").alias("suffix"), F.col("p").alias("q")), ["model", "suffix"]
            ).select("model", "key", (own + F.col("weight") * F.col("q")).alias("p"))
            parts.append(contexts.select("model", F.lit(order).alias("order"), F.lit(True).alias("context"), F.col("ctx").alias("key"), F.log("weight").alias("value")))
        lower = materialize(grams, "ngrams")
        parts.append(lower.select("model", F.lit(order).alias("order"), F.lit(False).alias("context"), "key", F.log("p").alias("value")))
    entries = parts[0]
    for part in parts[1:]:
        entries = entries.unionByName(part)
    entries = materialize(entries, "model")
    most = entries.groupBy(F.col("model") % folds).count().agg(F.max("count").alias("n")).first().n or 0
    return Model(entries, max(1, -(-most // SHARD_ENTRIES)), floor, taught)


def _shard(model: Model, number: int, fold: int = 0, folds: int = 1) -> dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]]:
    """Arrays of one shard of a fold's models: what is keyed by its pairs of symbols, and the
    short entries. A model's number stands above the bits of the key."""
    pair = F.when(F.col("context"), F.col("key")).otherwise(F.shiftright("key", BITS)).bitwiseAND(F.lit(mask(2)))
    short = F.col("order") <= 2
    kind = (F.col("order") * 2 + F.col("context").cast("int")).cast("byte")
    key = F.col("key").bitwiseOR(F.shiftleft(F.col("model").cast("long"), BITS * ORDER))
    own = model.entries.where(F.col("model") % folds == fold)
    table = own.where(short | (shard_of(pair, model.shards) == number)).select(
        kind.alias("kind"), key.alias("key"), F.col("value").cast("float").alias("value")
    ).toArrow()
    kinds, keys, values = (table.column(i).to_numpy() for i in range(3))
    del table
    out = {}
    for one in np.unique(kinds).tolist():
        own = np.flatnonzero(kinds == one)
        own = own[np.argsort(keys[own])]
        out[one >> 1, bool(one & 1)] = keys[own], values[own]
    return out


def _lookup(table: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if table is None or not len(table[0]):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return table[0][at] == keys, table[1][at]


def log_probabilities(keys: np.ndarray, shard: dict, floor: np.ndarray, model: np.ndarray | None = None) -> np.ndarray:
    """Of the last symbol of each key given those before, under the key's model: the longest
    known n-gram, with the weights of the longer contexts that are known."""
    model = np.zeros(len(keys), np.int64) if model is None else model
    out, left, weight = np.zeros(len(keys)), np.arange(len(keys)), np.zeros(len(keys))
    for order in range(ORDER, 0, -1):
        own, key = model[left] << BITS * ORDER, keys[left] & mask(order)
        found, value = _lookup(shard.get((order, False)), key | own)
        out[left[found]] = weight[found] + value[found]
        if order == 1:
            out[left[~found]] = weight[~found] + floor[model[left[~found]]]
            break
        left, key, weight, own = left[~found], key[~found], weight[~found], own[~found]
        known, value = _lookup(shard.get((order, True)), key >> BITS | own)
        weight = weight + np.where(known, value, 0.0)
    return out


def running(values: np.ndarray, before: float = 0.0) -> np.ndarray:
    """Sums up to each place, from `before` on: pieces that hand on their last sum round as
    all values in one."""
    return np.cumsum(np.concatenate([[before], values]))


def worst_stretch(ratios: np.ndarray, offsets: np.ndarray, before: float = 0.0) -> np.ndarray:
    """The highest sum of `STRETCH` neighbouring ratios of each text that has any symbol;
    the running sum starts at `before`."""
    sums, sizes = running(ratios, before), np.diff(offsets)
    low = np.arange(len(ratios))
    stretch = sums[np.minimum(low + STRETCH, np.repeat(offsets[1:], sizes))] - sums[low]
    return np.maximum.reduceat(stretch, offsets[:-1][sizes > 0]) if len(ratios) else np.zeros(0)


def worst_family(ratios: np.ndarray, keys: np.ndarray, offsets: np.ndarray, before: float = 0.0) -> np.ndarray:
    """The most evidence of each text that distinct words with one beginning, their first
    `ORDER` symbols, give together: insults come in many forms, and a rare word that only
    happens to be likelier under the toxic model comes alone. The running sum of ratios starts
    at `before`."""
    out = np.zeros(len(offsets) - 1)
    symbol = keys & mask(1)
    blank = (symbol == 32) | ((symbol >= 9) & (symbol <= 13))
    edge = np.zeros(len(keys) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~blank & (edge[:-1] | np.concatenate([[True], blank[:-1]])))
    if not len(starts):
        return out
    ends = np.flatnonzero(~blank & (edge[1:] | np.concatenate([blank[1:], [True]]))) + 1
    sums = running(ratios, before)
    after = np.where(edge[ends], ends, np.minimum(ends + 1, len(keys)))  # the blank behind a word is part of it
    least, most = WORD_EVIDENCE
    said = np.minimum(sums[after] - sums[starts] - least, most)
    chosen = np.flatnonzero((said > 0) & (ends - starts > ORDER))
    starts, ends, said = starts[chosen], ends[chosen], said[chosen]
    marks = np.isin(symbol[ends - 1], [ord(c) for c in ".,;:!?"])
    mixed = np.concatenate([[np.uint64(0)], np.cumsum(mix(keys.view(np.uint64)))])
    word = mixed[ends - marks] - mixed[starts + ORDER - 1]
    text = np.searchsorted(offsets, starts, "right") - 1
    order = np.lexsort((-said, word, text))
    new = np.ones(len(order), bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (word[order][1:] != word[order][:-1])
    kept = order[new]
    family = keys[starts[kept] + ORDER - 1]
    order = np.lexsort((family, text[kept]))
    text, family, said = text[kept][order], family[order], said[kept][order]
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(family) != 0)])) if len(text) else np.zeros(0, np.int64)
    if len(heads):
        np.maximum.at(out, text[heads], np.add.reduceat(said, heads))
    return out


def judge(
    texts: list[str], fold: np.ndarray, shared: list[Broadcast], floor: np.ndarray, folds: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text of a chunk: its log probability under its fold's model, its symbols, and
    how much likelier its worst stretch and family of words are under the second model.

    Each distinct key is looked up once, and the shards of the model are taken one after the
    other: a shard scores the characters that follow its pairs of symbols. Look-ups, and
    then texts, are taken in pieces, so that only keys and values are held for the whole
    chunk. The running sums go on from piece to piece.
    """
    keys, offsets = ngram_keys(texts)
    keys |= np.repeat(fold.astype(np.int64) << BITS * ORDER, np.diff(offsets))
    distinct = np.sort(keys)
    distinct = distinct[np.concatenate([np.ones(min(len(keys), 1), bool), distinct[1:] != distinct[:-1]])]
    values, second = np.zeros(len(distinct)), np.zeros(len(distinct))
    place = (((distinct >> BITS) & mask(2)) * 0x9E3779B1 >> 8) % len(shared)
    for number, table in enumerate(shared):
        mine = np.flatnonzero(place == number)
        for low in range(0, len(mine), PIECE):
            some = mine[low:low + PIECE]
            own, by = distinct[some] & mask(ORDER), distinct[some] >> BITS * ORDER
            values[some] = log_probabilities(own, table.value, floor, by)
            second[some] = log_probabilities(own, table.value, floor, by + folds)
        if len(shared) > 1 and len(mine) and table._path is not None:
            del table._value  # read again from the executor's disk: one shard in memory
    total, worst, family = (np.zeros(len(texts)) for _ in range(3))
    before, ahead = 0.0, 0.0
    for low, high in chunks(offsets, PIECE):
        own, ends = keys[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        known, at = np.unique(own, return_inverse=True)
        at = np.searchsorted(distinct, known)[at]
        likely = values[at]
        ratios = second[at] - likely
        sums = running(likely, before)
        total[low:high] = sums[ends[1:]] - sums[ends[:-1]]
        worst[low:high][np.diff(ends) > 0] = worst_stretch(ratios, ends, ahead)
        family[low:high] = worst_family(ratios, own & mask(ORDER), ends, ahead)
        before, ahead = sums[-1], running(ratios, ahead)[-1]
    return total, np.diff(offsets), worst, family


def score(rows: DataFrame, model: Model, folds: int, *carry: str) -> DataFrame:
    """`carry` columns, `log_probability` and `symbols` of each text, a row for each row;
    a text is scored by the model that its column `fold` names. `worst` and `family`: how
    much likelier the worst stretch of the whole text, and the worst family of words, are
    under the fold's second model (null without).

    A fold after the other is scored and stored, so that the driver and the executors hold
    the shards of one fold only.
    """
    base = rows.select("text", F.col("fold").cast("int").alias("fold"), "key_id", "key_text", *carry)
    schema = base.drop("text", "fold").schema.add("log_probability", "double").add("symbols", "long").add("worst", "double").add("family", "double")
    context = rows.sparkSession.sparkContext
    floor, both = model.floor, model.taught[:folds] & model.taught[folds:]

    def scored(one: int, shared: list[Broadcast]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in _texts(batches, 0, CHUNK):
                fold = part.column(1).to_numpy()
                total, sizes, worst, family = judge(texts, fold, shared, floor, folds)
                unknown = (sizes == 0) | ~both[fold]
                columns = {n: part.column(i) for i, n in enumerate(part.schema.names) if i > 1}
                yield batch(
                    **columns, log_probability=pa.array(total), symbols=pa.array(sizes),
                    worst=pa.array(worst, mask=unknown), family=pa.array(family, mask=unknown),
                )

        return materialize(base.where(F.col("fold") == one).mapInArrow(run, schema), "scored")

    out = None
    for one in range(folds):
        shared = [context.broadcast(_shard(model, number, one, folds)) for number in range(model.shards)]
        part = scored(one, shared)
        out = part if out is None else out.unionByName(part)
        for table in shared:
            table.destroy()
    return out


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids whose labels all say good and none says toxic."""
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(1))).alias("t")
    ).where("q = 1 and t = 0").select("doc_id")


def toxic_ids(labels: DataFrame) -> DataFrame:
    """Ids that any label says to be toxic."""
    return labels.where("doc_id is not null and toxic = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def limits(trusted: DataFrame, value: str, quantile: float) -> DataFrame:
    """`lang, limit`: the quantile of each language's trusted documents. The distance from
    the language's own median to its quantile is drawn towards that of all documents, each
    taken from the median of its language, by as many documents as put ten over the quantile:
    with fewer the language's own is hardly more than its largest value."""
    prior = 10 / (1 - quantile)
    at = lambda column, q: F.percentile_approx(column, q, 10_000)
    own = trusted.groupBy("lang").agg(at(value, 0.5).alias("middle"), at(value, quantile).alias("own"), F.count("*").alias("n"))
    own = F.broadcast(materialize(own, "limits"))  # a row per language
    pooled = trusted.join(own, "lang").agg(at(F.col(value) - F.col("middle"), quantile).alias("x")).first()["x"]
    reach = (F.col("n") * (F.col("own") - F.col("middle")) + F.lit(prior * (pooled or 0.0))) / (F.col("n") + F.lit(prior))
    return own.select("lang", (F.col("middle") + reach).alias("limit"))


def classify(
    docs: DataFrame, labels: DataFrame, quantile: float = 0.995, slack: float = 1.05, folds: int = 4, family_quantile: float = 0.99,
) -> DataFrame:
    """Perplexity of every document under a model of trusted text, and whether to keep it.

    Documents fall into `folds` by crc32 of the id, and each is scored by the model of the
    trusted documents of the other folds. So all trusted documents give, for each language,
    the limit (see `limits`) of perplexity, times `slack`, over which a document is
    rejected. A null language is one more language. Documents of a language without any
    trusted document are not rejected for their perplexity.

    A mean over a whole text hides a few insults, so a text is also judged by what speaks
    for a model of the labelled toxic texts against the model of the trusted ones, both of
    the other folds: in its worst stretch, and in its worst family of words (see
    `worst_family`). Both grow with the logarithm of a text's length, as fitted on trusted
    documents, and what exceeds that has a limit for each language too (the highest of all
    for a language without trusted text), at `quantile` and `family_quantile`. `toxic` is
    true over either; `keep` speaks of perplexity only, so keep what is `keep and not
    toxic`. Without toxic or without trusted labels nothing is toxic.

    Returns `doc_id, key_id, key_text, lang, perplexity, threshold, keep, toxic`, a row for
    each row. Null and empty texts have a null perplexity and are rejected.
    """
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(0)).cast("int")
    rows = keyed(docs.withColumn("__lang", lang), F.col("__lang").alias("lang")).withColumn("fold", fold)
    good, bad = (bounded(materialize(ids, "labelled"), 16) for ids in (trusted_ids(labels), toxic_ids(labels)))
    taught = rows.join(good, "doc_id", "left_semi").withColumn("part", F.col("fold")).unionByName(
        rows.join(bad, "doc_id", "left_semi").withColumn("part", F.col("fold") + folds)
    )
    model = fit(taught, folds, 2 * folds)
    surprisal = F.when(F.col("symbols") > 0, -F.col("log_probability") / F.col("symbols"))
    size = F.when(F.col("symbols") > 0, F.log("symbols"))
    scored = score(rows, model, folds, "doc_id", "lang").withColumn("surprisal", surprisal).withColumn("size", size)
    scored = scored.drop("log_probability", "symbols")
    held = scored.where("surprisal is not null").join(good, "doc_id", "left_semi").select("lang", "surprisal", "size", "worst", "family")
    held = materialize(held, "held")
    by_lang = limits(held, "surprisal", quantile).select("lang", (F.exp("limit") * slack).alias("threshold"))
    threshold = F.coalesce("threshold", F.lit(float("inf")))
    judged, toxic = scored.join(F.broadcast(by_lang), "lang", "left"), F.lit(False)
    for sign, share in (("worst", quantile), ("family", family_quantile)):
        line = held.agg(F.regr_slope(sign, "size").alias("slope"), F.regr_intercept(sign, "size").alias("base")).first()
        excess = F.col(sign) - (line.base or 0.0) - (line.slope or 0.0) * F.col("size")
        most = limits(held.where(F.col(sign).isNotNull()).withColumn("excess", excess), "excess", share)
        most = materialize(most.withColumnRenamed("limit", f"most_{sign}"), "limits")  # a row per language
        highest = F.lit(most.agg(F.max(f"most_{sign}").alias("most")).first()["most"]).cast("double")
        judged = judged.join(F.broadcast(most), "lang", "left")
        toxic = toxic | F.coalesce((excess > F.coalesce(f"most_{sign}", highest)) & (F.col(sign) > 0), F.lit(False))
    return judged.withColumn("perplexity", F.exp("surprisal")).select(
        "doc_id", "key_id", "key_text", F.when(F.col("lang") != "", F.col("lang")).alias("lang"), "perplexity",
        threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("keep"), toxic.alias("toxic"),
    )
