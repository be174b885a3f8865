"""Readers and writers of the tables that pass between steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dialogue_factors import schema
from dialogue_factors.operators.order import with_row_index
from dialogue_factors.sources.dialogue_lines import scan_block


def read_cluster_records(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Cluster records as JSON: one array per file, or one object per line."""
    return spark.read.schema(schema.CLUSTER_RECORDS).option("multiLine", multi_line).json(path)


def place_cluster_records(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """`(position, cluster_id)`: cluster records by their place in the file, or in a folder
    of files taken in the order of their names."""
    records = read_cluster_records(spark, path, multi_line).select("cluster_id", *scan_block(), F.monotonically_increasing_id().alias("at"))
    records = records.select("cluster_id", F.col("file").alias("from_file"), F.col("start").alias("from_start"), "at")
    placed = with_row_index(records, "from_file", "from_start", "at", name="position")
    return placed.select("position", "cluster_id")


def read_examples(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Labelled examples as JSON; a `split=` folder level becomes the split column.

    JSON arrays need `multi_line`, which reads a file in one task; the writer
    below makes one object per line, which splits.
    """
    return spark.read.schema(schema.EXAMPLES).option("multiLine", multi_line).json(path)


def read_example_tables(spark: SparkSession, path: str) -> DataFrame:
    """Labelled examples as Parquet partitioned by split: reading one split prunes the others."""
    return spark.read.schema(schema.EXAMPLES).parquet(path)


def write_examples(examples: DataFrame, path: str, fmt: str = "parquet") -> None:
    """All splits in one write, a folder each; an existing result is replaced."""
    examples.write.mode("overwrite").partitionBy("split").format(fmt).save(path)


def write_speakers(records: DataFrame, path: str, fmt: str = "json") -> None:
    """Speaker records with utterances and cluster id."""
    records.write.mode("overwrite").format(fmt).save(path)


def write_cluster_records(personas: DataFrame, path: str, fmt: str = "json") -> None:
    """Persona text and cluster id only."""
    personas.select("speaker_id", "persona_text", "cluster_id").write.mode("overwrite").format(fmt).save(path)


def write_k_scores(scores: DataFrame, path: str) -> None:
    """CSV with the header `K,Silhouette`; a handful of rows, hence one file."""
    (
        scores.selectExpr("k AS K", "silhouette AS Silhouette").orderBy("K").coalesce(1)
        .write.mode("overwrite").option("header", True).csv(path)
    )


def read_k_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("K int, Silhouette double").option("header", True).csv(path).toDF("k", "silhouette")
