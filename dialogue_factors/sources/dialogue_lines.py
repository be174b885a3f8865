"""Numbered dialogue lines from text files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def scan_block() -> list[Column]:
    """The file split a row was read from, `(file, start)`; one task reads it in order."""
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]


def read_lines(spark: SparkSession, sources: Sequence[str]) -> DataFrame:
    """Lines of the given sources, UTF-8: `(source, file, start, ln, line)`.

    A source is a file, or a folder whose part files in order (by part number, then
    name) make up one long file. Sources rank in the order given; parser state never
    crosses them. A missing path raises. `ln` increases within a file split.
    """

    def one(rank: int, path: str) -> DataFrame:
        return spark.read.text(path).select(
            F.lit(rank).alias("source"), *scan_block(), F.monotonically_increasing_id().alias("ln"), F.col("value").alias("line")
        )

    if not sources:
        raise ValueError("no dialogue source given")
    return reduce(DataFrame.unionByName, (one(rank, path) for rank, path in enumerate(sources)))
