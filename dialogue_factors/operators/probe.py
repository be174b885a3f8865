"""Linear probes: how much of the label a vector still tells."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from dialogue_factors.config import Settings
from dialogue_factors.functions.matrices import nearest
from dialogue_factors.operators.splits import hash_holdout


def fit_probe(train: DataFrame, vector: str, label: str, settings: Settings = Settings()) -> LogisticRegressionModel:
    """Multinomial logistic regression with ridge weight 1/n, the unit-penalty default
    of common toolkits. Labels are 0-based class numbers."""
    rows = train.select(F.col(label).cast("double").alias("label"), array_to_vector(vector).alias("features"))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = rows.count()
        if not n:
            raise ValueError("no rows to fit a probe on")
        return LogisticRegression(
            family="multinomial", maxIter=settings.probe_max_iter, regParam=1.0 / n, elasticNetParam=0.0, standardization=False
        ).fit(rows)
    finally:
        rows.unpersist()


def predict(model: LogisticRegressionModel, rows: DataFrame, vector: str, output: str = "prediction") -> DataFrame:
    """Add the logits (raw scores) and the predicted class."""
    scored = model.transform(rows.withColumn("features", array_to_vector(vector)))
    dropped = [c for c in ("features", "rawPrediction", "probability", "prediction") if c != output]
    return (
        scored.withColumn("logits", vector_to_array("rawPrediction"))
        .withColumn(output, F.col("prediction").cast("int")).drop(*dropped)
    )


def leakage(
    rows: DataFrame, keys: list[str], label: str, spaces: list[str], settings: Settings = Settings(), group: str | None = None
) -> DataFrame:
    """`(space, n_train, n_test, accuracy)`: a probe per vector column, tested on a fifth.

    Rows are held out one by one; with `group` a speaker is on one side only.
    """
    held = rows.withColumn("_held", hash_holdout(*([group] if group else keys), settings=settings))
    out = []
    for space in spaces:
        pair = held.select("_held", label, space)
        train, test = pair.where(~F.col("_held")), pair.where("_held")
        hits = predict(fit_probe(train, space, label, settings), test, space).agg(
            F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy")
        ).first()
        out.append((space, train.count(), hits.n, hits.accuracy))
    return rows.sparkSession.createDataFrame(out, "space string, n_train bigint, n_test bigint, accuracy double")


def nearest_mean_predictions(train: DataFrame, test: DataFrame, vector: str, label: str) -> DataFrame:
    """Add `prediction`: the class whose training mean is nearest, the least label in a tie."""
    means = (
        train.groupBy(label).agg(vector_to_array(Summarizer.mean(array_to_vector(vector))).alias("mean"))
        .orderBy(label).collect()  # one row per class
    )
    names = F.array(*(F.lit(m[label]) for m in means))
    return test.withColumn("prediction", F.get(names, nearest(vector, np.array([m["mean"] for m in means]))))
