"""Split a vector into a label-carrying and a label-free part.

A linear counterpart of adversarial training: directions in which the classes
differ are collected in an orthonormal basis B; z_p = B(x - mean) holds what they
say about the label, z_c = x - B'z_p is the rest, and x = z_c + B'z_p.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from dialogue_factors import schema
from dialogue_factors.config import Settings
from dialogue_factors.functions.matrices import affine, map_rows
from dialogue_factors.operators.probe import fit_probe


@dataclass(frozen=True)
class FactorBasis:
    mean: np.ndarray  # (dims,)
    basis: np.ndarray  # (factors, dims), orthonormal rows

    def to_table(self, spark: SparkSession) -> DataFrame:
        """Row 0 holds the mean, rows 1.. the basis."""
        rows = [(i, [float(v) for v in r]) for i, r in enumerate([self.mean, *self.basis])]
        return spark.createDataFrame(rows, schema.FACTOR_BASIS)

    @staticmethod
    def from_table(table: DataFrame) -> "FactorBasis":
        rows = [np.array(r.vector) for r in table.orderBy("row").collect()]
        return FactorBasis(rows[0], np.array(rows[1:]).reshape(-1, len(rows[0])))


def class_means(rows: DataFrame, vector: str, label: str) -> DataFrame:
    """`(label, n, mean)`, partial sums first; one row per class."""
    return rows.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.mean(array_to_vector(vector))).alias("mean")
    )


def _orthonormal_rows(directions: np.ndarray) -> np.ndarray:
    if not directions.size:
        return directions.reshape(0, directions.shape[-1])
    _, strength, rows = np.linalg.svd(directions, full_matrices=False)
    return rows[strength > 1e-10 * max(strength[0], 1e-300)] if strength[0] > 0 else rows[:0]


def fit_factors(
    rows: DataFrame, vector: str, label: str, passes: int = 1, settings: Settings = Settings()
) -> FactorBasis:
    """The first pass takes the class means, so that their remainders coincide.

    Each further pass fits a linear probe on the remainder and removes the
    directions it still uses.
    """
    classes = class_means(rows, vector, label).collect()  # one row per class
    if not classes:
        raise ValueError("no rows to fit")
    weight = np.array([float(c.n) for c in classes])
    means = np.array([c["mean"] for c in classes])
    mean = weight @ means / weight.sum()
    basis = _orthonormal_rows(means - mean)
    for _ in range(1, passes):
        rest = split_factors(rows.select(label, vector), vector, FactorBasis(mean, basis)).select(label, "z_c")
        weights = fit_probe(rest, "z_c", label, settings).coefficientMatrix.toArray()
        fresh = weights - (weights @ basis.T) @ basis
        basis = _orthonormal_rows(np.vstack([basis, _orthonormal_rows(fresh)]))
    return FactorBasis(mean, basis)


def split_factors(rows: DataFrame, vector: str, factors: FactorBasis) -> DataFrame:
    """Add `z_p` and `z_c`."""
    mean, b = factors.mean, factors.basis
    return rows.withColumn("z_p", affine(vector, b, -(b @ mean))).withColumn(
        "z_c", map_rows(vector, lambda x: x - (x - mean) @ b.T @ b)
    )


HEADS = ("persona", "content", "classifier", "adversary")


@dataclass(frozen=True)
class LinearHeads:
    """Two projections of a vector and a linear classifier on each; (weights, bias) pairs."""

    persona: tuple[np.ndarray, np.ndarray]
    content: tuple[np.ndarray, np.ndarray]
    classifier: tuple[np.ndarray, np.ndarray]
    adversary: tuple[np.ndarray, np.ndarray]


def heads_table(spark: SparkSession, heads: LinearHeads, epoch: int) -> DataFrame:
    """Parameters by name, one row per output; write partitioned by epoch to keep each."""
    rows = [
        (epoch, name, i, [float(v) for v in w], float(b))
        for name in HEADS for i, (w, b) in enumerate(zip(*getattr(heads, name)))
    ]
    return spark.createDataFrame(rows, schema.HEADS)


def read_heads(table: DataFrame, epoch: int) -> LinearHeads:
    rows = table.where(F.col("epoch") == epoch).orderBy("name", "row").collect()
    if not rows:
        raise ValueError(f"no parameters kept for epoch {epoch}")
    pick = lambda name, field: np.array([r[field] for r in rows if r["name"] == name])
    return LinearHeads(**{name: (pick(name, "weights"), pick(name, "bias")) for name in HEADS})


def apply_heads(rows: DataFrame, vector: str, heads: LinearHeads) -> DataFrame:
    """Add `z_p`, `z_c`, `logits`, `adv_logits`."""
    return (
        rows.withColumn("z_p", affine(vector, *heads.persona))
        .withColumn("z_c", affine(vector, *heads.content))
        .withColumn("logits", affine("z_p", *heads.classifier))
        .withColumn("adv_logits", affine("z_c", *heads.adversary))
    )
