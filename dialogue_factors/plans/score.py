"""A finished run kept as models, and new dialogue scored with them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from dialogue_factors.config import Settings
from dialogue_factors.functions.matrices import affine, nearest
from dialogue_factors.functions.vectors import argmax
from dialogue_factors.operators.embed import hashed_tfidf
from dialogue_factors.operators.episodes import Dialogue, parse_dialogue
from dialogue_factors.operators.examples import label_utterances
from dialogue_factors.operators.factors import FactorBasis, split_factors
from dialogue_factors.operators.reduce import reducer_rows
from dialogue_factors.plans.analyse import Analysis
from dialogue_factors.plans.label_dialogue import LabelledDialogue, persona_table
from dialogue_factors.sources.models import part, read_model, save_model

LABELLER, ANALYSIS = "label", "analyse"


@dataclass(frozen=True)
class Scored:
    speakers: DataFrame  # speaker_id, label
    utterances: DataFrame  # speaker_id, pos, text, label (the speaker's), logits, prediction


def save_labeller(spark: SparkSession, store: str, result: LabelledDialogue) -> str:
    """Keep what turns a persona text into a label: term weights, reducer, centres."""
    if result.idf is None:
        raise ValueError("the personas were embedded by a foreign encoder; only hashed texts can be scored again")
    mean, components = reducer_rows(result.reducer)
    parts = {"idf": part(result.idf), "mean": part(mean), "components": part(components), "centres": part(result.model.centres)}
    return save_model(spark, store, LABELLER, parts)


def save_analysis(spark: SparkSession, store: str, result: Analysis) -> str:
    """Keep what predicts a label from one utterance: term weights, factor basis, probe."""
    if result.idf is None:
        raise ValueError("the utterances were embedded elsewhere; only hashed texts can be scored again")
    probe = part(result.probe.coefficientMatrix.toArray(), result.probe.interceptVector.toArray())
    basis = part(np.vstack([result.factors.mean, *result.factors.basis]))
    return save_model(spark, store, ANALYSIS, {"idf": part(result.idf), "basis": basis, "probe": probe})


def label_new_speakers(spark: SparkSession, store: str, dialogue: Dialogue, settings: Settings = Settings()) -> DataFrame:
    """`(speaker_id, label)`: the nearest stored centre of each new persona."""
    model = read_model(spark, store, LABELLER)
    texts = persona_table(dialogue, settings)
    embedded = hashed_tfidf(texts, "speaker_id", "persona_text", settings, idf=model["idf"][0][0])
    components, mean = model["components"][0], model["mean"][0][0]
    reduced = embedded.withColumn("reduced", affine("embedding", components, -(components @ mean)))
    return reduced.select("speaker_id", nearest("reduced", model["centres"][0]).alias("label"))


def predict_utterances(spark: SparkSession, store: str, utterances: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Add `logits` and `prediction` to `(speaker_id, pos, text, ...)`, row by row."""
    model = read_model(spark, store, ANALYSIS)
    rows = model["basis"][0]
    keys = utterances.columns
    embedded = hashed_tfidf(utterances, keys, "text", settings, idf=model["idf"][0][0])
    split = split_factors(embedded, "embedding", FactorBasis(rows[0], rows[1:]))
    scored = split.select(*keys, affine("z_p", *model["probe"]).alias("logits"))
    return scored.withColumn("prediction", argmax("logits").cast("int"))


def score_lines(lines: DataFrame, store: str, settings: Settings = Settings()) -> Scored:
    """Label the speakers of new dialogue lines and predict the label of every utterance.

    Nothing is fitted: the same rows get the same result in any corpus."""
    spark, dialogue = lines.sparkSession, parse_dialogue(lines)
    speakers = label_new_speakers(spark, store, dialogue, settings)
    kept = label_utterances(dialogue.utterances, speakers.withColumn("split", F.lit("new")), settings)
    utterances = predict_utterances(spark, store, kept.select("speaker_id", "pos", "text", "label"), settings)
    return Scored(speakers, utterances)
