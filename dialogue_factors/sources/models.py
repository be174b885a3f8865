"""Fitted parameters as tables: one format for every kind of model, kept by run and epoch.

A version is written to a folder of its own and then marked by one appended row. Readers
go by the marks, so that a version whose writing was broken off is never seen, and a
newer one takes the place of the current one at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from dialogue_factors import schema

# A part is a matrix with one bias for each row.
Part = tuple[np.ndarray, np.ndarray]


def part(weights: np.ndarray, bias: np.ndarray | None = None) -> Part:
    matrix = np.atleast_2d(np.asarray(weights, dtype=float))
    return matrix, np.zeros(len(matrix)) if bias is None else np.asarray(bias, dtype=float)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def versions(spark: SparkSession, store: str) -> DataFrame:
    """`(run, epoch, number, version)` of all complete versions; none if nothing is stored."""
    if not _exists(spark, f"{store}/marks"):
        return spark.createDataFrame([], schema.MODEL_MARKS)
    return spark.read.schema(schema.MODEL_MARKS).parquet(f"{store}/marks")


def save_model(spark: SparkSession, store: str, run: str, parts: Mapping[str, Part], epoch: int = 0) -> str:
    """Write a version of a run's parameters and make it the current one; returns its name.

    An epoch may be saved again: the later version counts and the earlier one stays."""
    if not parts or any(not len(weights) for weights, _ in parts.values()):
        raise ValueError("a model needs parts, and a part needs rows")
    version = uuid.uuid4().hex
    rows = [
        (name, i, [float(v) for v in w], float(b))
        for name, (weights, bias) in parts.items() for i, (w, b) in enumerate(zip(weights, bias, strict=True))
    ]
    spark.createDataFrame(rows, schema.MODEL_PARTS).coalesce(1).write.parquet(f"{store}/parts/{version}")
    newest = versions(spark, store).where(F.col("run") == run).agg(F.max("number")).first()[0] or 0
    mark = spark.createDataFrame([(run, epoch, newest + 1, version)], schema.MODEL_MARKS)
    mark.coalesce(1).write.mode("append").parquet(f"{store}/marks")
    return version


def read_model(spark: SparkSession, store: str, run: str, epoch: int | None = None) -> dict[str, Part]:
    """The parts of a run's current version, or of the last version of an epoch."""
    marked = versions(spark, store).where(F.col("run") == run)
    if epoch is not None:
        marked = marked.where(F.col("epoch") == epoch)
    newest = marked.orderBy(F.desc("number"), F.desc("version")).first()
    if newest is None:
        raise ValueError(f"no model of run {run!r}" + ("" if epoch is None else f" at epoch {epoch}"))
    rows = spark.read.schema(schema.MODEL_PARTS).parquet(f"{store}/parts/{newest.version}").orderBy("part", "row").collect()
    return {
        name: (np.array([r.weights for r in rows if r.part == name]), np.array([r.bias for r in rows if r.part == name]))
        for name in sorted({r.part for r in rows})
    }
