"""A corpus pipeline: quality, near duplicates, benchmark leaks, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dialogue_factors.llm.common import NO_ID, bounded
from dialogue_factors.llm.decontaminate import find_leaks
from dialogue_factors.llm.jaccard_join import near_duplicates
from dialogue_factors.llm.kneser_ney import classify
from dialogue_factors.llm.packing import pack_powers_of_two
from dialogue_factors.llm.secret_forest import find_secrets, redact
from dialogue_factors.session import materialize


def _by_key(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of `docs` with (`left_semi`) or without (`left_anti`) a key of `keys`."""
    keys = materialize(keys.select(F.col("key_id").alias("__id"), F.col("key_text").alias("__text")).distinct(), "keys")
    own_id = F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID))
    own_text = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    keys = bounded(keys, 24)
    return docs.join(keys, (own_id == keys["__id"]) & (own_text == keys["__text"]), how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier rejects, or takes for toxic, go."""
    judged = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _by_key(docs, judged.where("not keep or toxic"), "left_anti")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays: that of the least id (rows
    without id last), of several with it that of the least text hash, and of equal rows
    one. Documents without words are linked with nothing and all stay."""
    keys = materialize(near_duplicates(docs), "components")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), "key_text", "key_id")
    groups = keys.where("root is not null").groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("rows"))
    first = materialize(groups.select("first.key_id", "first.key_text", "root", "rows"), "first")
    blank = keys.where("root is null").select("key_id", "key_text")
    kept = _by_key(docs, first.select("key_id", "key_text").unionByName(blank), "left_semi")
    # Only rows that are in the table several times need a comparison of their texts.
    chosen = first.where("rows > 1").select("key_id", "key_text")
    several = keys.join(bounded(chosen, 24), ["key_id", "key_text"], "left_semi").groupBy("key_id", "key_text").count().where("count > 1")
    several = materialize(several.select("key_id", "key_text"), "several")
    if several.isEmpty():
        return kept
    return _by_key(kept, several, "left_anti").unionByName(_by_key(kept, several, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a stretch of a benchmark item go."""
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _by_key(docs, leaks, "left_anti")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; all documents stay."""
    return redact(docs, find_secrets(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_powers_of_two(docs)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("packing", packed),
]
# Perplexity, forests and token ids have no SQL form; tests/llm compare each stage with
# a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stored and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
