"""Choice of k by silhouette."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from dialogue_factors import schema
from dialogue_factors.config import Settings
from dialogue_factors.functions.matrices import nearest
from dialogue_factors.operators import kmeans
from dialogue_factors.operators.silhouette import silhouette_exact, silhouette_of_models


def score_models(
    vectors: DataFrame, key: str, vector: str, models: dict[int, kmeans.Clustering], settings: Settings = Settings()
) -> DataFrame:
    """`(k, silhouette)` for fitted models, by the metric named in the settings."""
    ks = sorted(models)
    if settings.silhouette_metric == "squared":
        scored = silhouette_of_models(vectors, vector, [models[k] for k in ks])
    elif settings.silhouette_metric == "euclidean":
        labelled = vectors.select(key, vector, *(nearest(vector, models[k].centres).alias(f"k{k}") for k in ks))
        scored = silhouette_exact(labelled, key, vector, [f"k{k}" for k in ks])
    else:
        raise ValueError(f"unknown silhouette metric {settings.silhouette_metric!r}")
    rows = [(ks[r.labelling], float(r.silhouette)) for r in scored.collect()]  # one row per k
    return vectors.sparkSession.createDataFrame(sorted(rows), schema.K_SCORES)


def sweep(
    vectors: DataFrame, key: str, vector: str, ks: Iterable[int] | None = None,
    settings: Settings = Settings(), spread: bool = True,
) -> tuple[DataFrame, dict[int, kmeans.Clustering]]:
    """Scores per k and the best model of each k, so the chosen one needs no second fit."""
    ks = list(ks or range(settings.k_min, settings.k_max + 1))
    kept = vectors.select(key, vector).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        begun = kmeans.starts(kept, key, vector, ks, settings, spread)
        fitted = kmeans.fit(kept, vector, begun, settings.kmeans_max_iter, settings.kmeans_tol)
        best = kmeans.best_of_starts(fitted)
        return score_models(kept, key, vector, best, settings), best
    finally:
        kept.unpersist()
