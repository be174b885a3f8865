"""Small dense-matrix steps applied to Arrow batches inside tasks.

Each helper closes over a matrix whose size depends on classes, clusters and
dimensions only, never on the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def as_matrix(vectors: pa.Array) -> np.ndarray:
    """(rows, dims) view of a list array; rows must be non-null and equally long."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if vectors.null_count:
        raise ValueError("vector column holds nulls")
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(vectors) == 0:
        return flat.reshape(0, 0).astype(float)
    if flat.size % len(vectors) or (np.diff(vectors.offsets.to_numpy()) != flat.size // len(vectors)).any():
        raise ValueError("vectors differ in length")
    return flat.reshape(len(vectors), -1)


def as_lists(matrix: np.ndarray) -> pa.ListArray:
    rows, width = matrix.shape
    offsets = np.arange(0, (rows + 1) * width, width) if width else np.zeros(rows + 1)
    values = np.ascontiguousarray(matrix, dtype=np.float64).ravel()
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def map_rows(column: Column | str, step: Callable[[np.ndarray], np.ndarray]) -> Column:
    """array<double> -> array<double>, `step` working on a whole batch as a matrix."""

    @F.arrow_udf("array<double>")
    def run(vectors: pa.Array) -> pa.Array:
        x = as_matrix(vectors)
        return as_lists(step(x)) if len(x) else pa.array([], pa.list_(pa.float64()))

    return run(column)


def affine(column: Column | str, weights: np.ndarray, bias: np.ndarray | float = 0.0) -> Column:
    """W.x + b for weights of shape (out, in)."""
    w, b = np.asarray(weights, float), np.asarray(bias, float)
    return map_rows(column, lambda x: x @ w.T + b)


def nearest(column: Column | str, centres: np.ndarray) -> Column:
    """Index of the centre at least Euclidean distance; ties go to the lower index."""
    c = np.asarray(centres, float)
    origin = c.mean(axis=0)  # squares are expanded around it, so that far data lose no digits
    c = c - origin
    half = 0.5 * np.einsum("ij,ij->i", c, c)

    @F.arrow_udf("int")
    def run(vectors: pa.Array) -> pa.Array:
        x = as_matrix(vectors)
        index = (half - (x - origin) @ c.T).argmin(axis=1) if len(x) else np.zeros(0)
        return pa.array(index.astype(np.int32), pa.int32())

    return run(column)


def nearest_square(column: Column | str, centres: np.ndarray) -> Column:
    """Squared Euclidean distance to the nearest centre."""
    c = np.asarray(centres, float)
    origin = c.mean(axis=0)
    c = c - origin
    half = 0.5 * np.einsum("ij,ij->i", c, c)

    @F.arrow_udf("double")
    def run(vectors: pa.Array) -> pa.Array:
        x = as_matrix(vectors)
        if not len(x):
            return pa.array([], pa.float64())
        x = x - origin
        near = c[(half - x @ c.T).argmin(axis=1)]
        return pa.array(((x - near) ** 2).sum(axis=1))

    return run(column)
