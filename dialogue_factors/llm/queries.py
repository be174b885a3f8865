"""Registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dialogue_factors.llm.bitplanes import write_and_read
from dialogue_factors.llm.decontaminate import find_leaks
from dialogue_factors.llm.invertible_sketch import fingerprints
from dialogue_factors.llm.jaccard_join import near_duplicates
from dialogue_factors.llm.kneser_ney import classify
from dialogue_factors.llm.lookup_shards import moved_rows
from dialogue_factors.llm.mixture_language import predict_languages
from dialogue_factors.llm.packing import pack_powers_of_two
from dialogue_factors.llm.prefix_trie import prefix_trie, trie_sql
from dialogue_factors.llm.secret_forest import find_secrets
from dialogue_factors.llm.suffix_dedup import remove_repeats
from dialogue_factors.llm.swap_packing import pack_by_swaps
from dialogue_factors.llm.zone_maps import cluster_sql, cluster_vectors

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_power_of_two_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_powers_of_two(table(spark, folder, "documents"))


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"))


def op3_invertible_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(table(spark, folder, "documents"))


def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_mixture_language(spark: SparkSession, folder: str) -> DataFrame:
    return predict_languages(table(spark, folder, "documents"))


def op6_secret_forest(spark: SparkSession, folder: str) -> DataFrame:
    return find_secrets(table(spark, folder, "documents")).select("doc_id", "start", "length", "sha256", "probability")


def op7_bit_planes(spark: SparkSession, folder: str) -> DataFrame:
    return write_and_read(table(spark, folder, "documents"))


def op8_kneser_ney_quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.selectExpr("doc_id", "lang", "perplexity", "threshold", "keep and not toxic as keep", "toxic")


def op9_qgram_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    leaks = find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return leaks.select("doc_id", "item_id", "item_start", "item_end", "doc_start", "doc_end", "edits")


def op10_lookup_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shards of all documents, and where they go when the last shard leaves."""
    return moved_rows(table(spark, folder, "documents"), SHARDS, SHARDS[:-1])


def op11_swap_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_by_swaps(table(spark, folder, "documents"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"))


def op13_zone_map_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return cluster_vectors(table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (
        op1_power_of_two_packing, op2_suffix_dedup, op3_invertible_fingerprints, op4_jaccard_join, op5_mixture_language, op6_secret_forest, op7_bit_planes,
        op8_kneser_ney_quality, op9_qgram_decontamination, op10_lookup_sharding, op11_swap_packing, op12_prefix_trie, op13_zone_map_clustering,
    )
}
ORACLES: dict[str, str] = {"op12_prefix_trie": trie_sql(), "op13_zone_map_clustering": cluster_sql()}
