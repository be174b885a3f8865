"""Labelled utterance rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dialogue_factors.config import Settings
from dialogue_factors.functions.text import clean
from dialogue_factors.operators.labels import attach_labels
from dialogue_factors.operators.order import rank_by_hash


def keep_utterances(utterances: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Strip and lower-case, then keep texts longer than the minimum length."""
    return utterances.withColumn("text", clean("text")).where(F.length("text") > settings.min_text_length)


def explode_records(records: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Nested speaker records to one row per utterance, in order, label carried along."""
    first = F.expr(f"part * {2 * settings.record_lines}") if "part" in records.columns else F.lit(0)
    rows = records.select(
        "speaker_id", F.col("cluster_id").cast("int").alias("label"),
        first.cast("bigint").alias("_first"), F.posexplode("utterances").alias("_at", "text"),
    ).select("speaker_id", (F.col("_first") + F.col("_at")).alias("pos"), "text", "label")
    return keep_utterances(rows, settings)


def label_utterances(utterances: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Long-form utterances with their speaker's label (and split, where it has one)."""
    keyed = labels.withColumn("label", F.col("label").cast("int"))
    return attach_labels(keep_utterances(utterances, settings), keyed)


def seeded_shuffle(examples: DataFrame, epoch: int, *keys: str, settings: Settings = Settings()) -> DataFrame:
    """Add `rank`, a row order that differs by epoch and repeats for a seed."""
    return rank_by_hash(examples, f"{settings.seed}:{epoch}", *keys)
