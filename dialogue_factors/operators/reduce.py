"""Centred principal components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from dialogue_factors.functions.matrices import as_lists, as_matrix
from dialogue_factors.operators.reports import chart_sample


def fit_reducer(rows: DataFrame, vector: str, dims: int) -> PipelineModel:
    """Centre, project on the leading components, fix each component's sign.

    The sign makes the loading of largest magnitude positive. Rows stay on the
    executors; the driver sees one dims x dims matrix.
    """
    features = rows.select(array_to_vector(vector).alias("_in"))
    centre = StandardScaler(inputCol="_in", outputCol="_centred", withMean=True, withStd=False).fit(features)
    pca = PCA(k=dims, inputCol="_centred", outputCol="_raw").fit(centre.transform(features))
    loadings = pca.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(dims)])
    signs[signs == 0] = 1.0
    flip = ElementwiseProduct(scalingVec=Vectors.dense(signs), inputCol="_raw", outputCol="_reduced")
    return PipelineModel([centre, pca, flip])


def reducer_rows(model: PipelineModel) -> tuple[np.ndarray, np.ndarray]:
    """Mean and components (one a row, signs set) of a fitted reducer: a vector x becomes
    components @ (x - mean)."""
    centre, pca, flip = model.stages
    return centre.mean.toArray(), (pca.pc.toArray() * flip.getScalingVec().toArray()).T


def apply_reducer(model: PipelineModel, rows: DataFrame, vector: str, output: str = "reduced") -> DataFrame:
    shaped = rows.withColumn("_in", array_to_vector(vector))
    return (
        model.transform(shaped)
        .withColumn(output, vector_to_array("_reduced"))
        .drop("_in", "_centred", "_raw", "_reduced")
    )


def reduce_vectors(rows: DataFrame, vector: str, dims: int, output: str = "reduced") -> DataFrame:
    return apply_reducer(fit_reducer(rows, vector, dims), rows, vector, output)


def map_2d(rows: DataFrame, keys: Sequence[str], label: str, spaces: Sequence[str], sample: int | None = None) -> DataFrame:
    """`(keys, space, x, y, label)`: two components per vector column, for a chart.

    The components come from all rows; `sample` limits what is drawn.
    """

    def one(space: str) -> DataFrame:
        points = apply_reducer(fit_reducer(rows, space, 2), drawn.select(*keys, label, space), space, "xy")
        at = lambda i: F.get("xy", F.lit(i))
        return points.select(*keys, F.lit(space).alias("space"), at(0).alias("x"), at(1).alias("y"), label)

    drawn = chart_sample(rows, sample, *keys) if sample else rows
    return reduce(DataFrame.unionByName, map(one, spaces))


def covariance(rows: DataFrame, vector: str) -> DataFrame:
    """Sample covariance in long form `(i, j, covariance)`, 0-based dimensions.

    Tasks add up centred products and pass on one row per dimension.
    """
    first = rows.groupBy(F.lit("all")).agg(
        vector_to_array(Summarizer.mean(array_to_vector(vector))).alias("mean"), F.count(F.lit(1)).alias("n")
    ).first()
    if first is None:
        raise ValueError("no rows to measure")
    mean, n = np.asarray(first.mean), first.n

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            if batch.num_rows:
                x = as_matrix(batch.column(0)) - mean
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(mean)), pa.int32()), as_lists(total)], ["i", "row"])

    summed = (
        rows.select(vector).mapInArrow(products, "i int, row array<double>")
        .groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))
    )
    return summed.select("i", F.posexplode("row").alias("j", "s")).select(
        "i", "j", (F.col("s") / F.lit(float(max(n - 1, 1)))).alias("covariance")
    )
