"""How well the parts of a vector tell the label."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame

from dialogue_factors.config import Settings
from dialogue_factors.operators.embed import hashed_idf, hashed_tfidf
from dialogue_factors.operators.factors import FactorBasis, fit_factors, split_factors
from dialogue_factors.operators.metrics import accuracy, confusion_matrix
from dialogue_factors.operators.probe import fit_probe, leakage, predict
from dialogue_factors.operators.reduce import map_2d
from dialogue_factors.session import materialize


@dataclass(frozen=True)
class Analysis:
    factors: FactorBasis
    probe: LogisticRegressionModel  # label from z_p
    scored: DataFrame  # keys, label, vector, z_p, z_c, logits, prediction
    accuracy: DataFrame
    confusion: DataFrame
    leakage: DataFrame
    persona_map: DataFrame
    chart: DataFrame  # persona and content side by side
    idf: np.ndarray | None = None  # term weights of the training part, if texts were embedded by hash


def analyse(
    train: DataFrame, test: DataFrame, keys: Sequence[str], vector: str, label: str,
    settings: Settings = Settings(), passes: int = 1,
) -> Analysis:
    """Fit the split and a persona classifier on `train`, report on `test`."""
    keys = list(keys)
    factors = fit_factors(train, vector, label, passes, settings)
    probe = fit_probe(split_factors(train, vector, factors), "z_p", label, settings)
    scored = materialize(predict(probe, split_factors(test, vector, factors), "z_p"), "scored")
    return Analysis(
        factors,
        probe,
        scored,
        accuracy(scored, "prediction", label),
        confusion_matrix(scored, "prediction", label),
        leakage(scored, keys, label, [vector, "z_p", "z_c"], settings),
        map_2d(scored, keys, label, ["z_p"], settings.map_rows),
        map_2d(scored, keys, label, ["z_p", "z_c"], settings.compare_rows),
    )


def analyse_examples(examples: DataFrame, settings: Settings = Settings(), passes: int = 1) -> Analysis:
    """Analyse labelled utterances `(speaker_id, pos, text, label, split)`, embedded by hash with the
    term weights of the training part."""
    kept = materialize(examples.select("speaker_id", "pos", "text", "label", "split"), "examples")
    keys = ["speaker_id", "pos", "label", "split"]
    idf = hashed_idf(kept.where("split = 'train'"), keys, "text", settings)
    if not idf.size:
        raise ValueError("no rows to fit")
    embedded = materialize(hashed_tfidf(kept, keys, "text", settings, idf=idf), "utterance-vectors")
    part = lambda name: embedded.where(embedded.split == name).drop("split")
    return replace(analyse(part("train"), part("test"), ["speaker_id", "pos"], "embedding", "label", settings, passes), idf=idf)
