"""Attaching cluster labels to speakers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dialogue_factors.operators.order import with_row_index


def attach_labels(rows: DataFrame, labels: DataFrame, key: str = "speaker_id") -> DataFrame:
    """Inner join on the key. The optimizer broadcasts labels it knows to be small;
    otherwise a sort-merge join, whose hot keys adaptive execution splits."""
    return rows.join(labels, key)


def attach_by_position(left: DataFrame, left_order: list[str], right: DataFrame, right_order: list[str]) -> DataFrame:
    """Pair the i-th row of both sides; the longer side is cut to the shorter."""
    a = with_row_index(left, *left_order, name="position")
    b = with_row_index(right, *right_order, name="position")
    return a.join(b, "position")


def label_mismatch_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: sizes of both sides, how many keys match, how many stand alone."""
    marked = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_key = marked.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return per_key.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("n_left"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("n_right"),
        F.count_if((F.col("l") > 0) & (F.col("r") > 0)).alias("n_matched"),
        F.count_if((F.col("l") > 0) & (F.col("r") == 0)).alias("n_left_only"),
        F.count_if((F.col("l") == 0) & (F.col("r") > 0)).alias("n_right_only"),
    ).withColumn("mismatch", F.col("n_left") != F.col("n_right"))
