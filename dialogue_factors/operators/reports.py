"""Count tables and chart data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def class_distribution(examples: DataFrame) -> DataFrame:
    """Rows per split and label; only labels present, all splits."""
    return examples.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n")).orderBy("split", "label")


def cluster_sizes(speakers: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    return speakers.groupBy(cluster).agg(F.count(F.lit(1)).alias("n")).orderBy(cluster)


def split_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).orderBy("split")


def chart_sample(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in the given order of a unique key, for a scatter chart.

    The keys are chosen first, so that the wide rows of every task need not meet;
    n bounds what is broadcast.
    """
    first = rows.select(*order).orderBy(*order).limit(n)
    return rows.join(F.broadcast(first), list(order), "left_semi").orderBy(*order).limit(n)


def best_k(scores: DataFrame) -> DataFrame:
    """The k with the highest silhouette; the smallest k wins a tie."""
    return scores.orderBy(F.desc("silhouette"), F.asc("k")).limit(1)
