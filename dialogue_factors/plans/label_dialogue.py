"""From numbered dialogue lines to labelled, split utterances."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from dialogue_factors.config import Settings
from dialogue_factors.operators import kmeans
from dialogue_factors.operators.embed import hashed_idf, hashed_tfidf
from dialogue_factors.operators.episodes import Dialogue, number_speakers, parse_dialogue, persona_texts
from dialogue_factors.operators.examples import label_utterances
from dialogue_factors.operators.ksweep import sweep
from dialogue_factors.operators.labels import attach_labels, label_mismatch_report
from dialogue_factors.operators.reduce import apply_reducer, fit_reducer
from dialogue_factors.operators.reports import best_k
from dialogue_factors.operators.splits import split_exact
from dialogue_factors.session import broadcast_if_small, materialize


@dataclass(frozen=True)
class LabelledDialogue:
    dialogue: Dialogue
    vectors: DataFrame  # speaker_id, reduced
    k_scores: DataFrame  # k, silhouette
    reducer: PipelineModel
    model: kmeans.Clustering  # the fitted model of the chosen k
    speakers: DataFrame  # speaker_id, label, split
    examples: DataFrame  # speaker_id, pos, text, label, split
    idf: np.ndarray | None = None  # term weights, if personas were embedded by hash


def persona_table(dialogue: Dialogue, settings: Settings = Settings()) -> DataFrame:
    """`(speaker_id, part, persona_text, parts)`, stored, as embedding may read it twice."""
    parts = F.expr(f"last_offset div {settings.record_lines} + 1").alias("parts")
    long = broadcast_if_small(dialogue.speakers.select("speaker_id", parts).where("parts > 1"))
    texts = persona_texts(dialogue.facts, settings).join(long, "speaker_id", "left").fillna({"parts": 1})
    return materialize(texts, "personas")


def label_vectors(
    dialogue: Dialogue, embedded: DataFrame, settings: Settings = Settings(), ks: Sequence[int] | None = None
) -> LabelledDialogue:
    """Reduce, choose k, cluster, split by speaker, label every utterance.

    `embedded` holds `(speaker_id, embedding)`, one row per speaker, from any encoder.
    """
    stored = materialize(embedded, "embeddings")
    if stored.groupBy("speaker_id").count().where("count > 1").limit(1).count():
        raise ValueError("a speaker has more than one embedding")
    width = stored.select(F.size("embedding").alias("w")).first()
    if width is None:
        raise ValueError("the corpus has no speaker with both persona text and dialogue")
    reducer = fit_reducer(stored, "embedding", min(settings.pca_dim, width.w))
    vectors = materialize(apply_reducer(reducer, stored, "embedding").select("speaker_id", "reduced"), "reduced")
    scores, models = sweep(vectors, "speaker_id", "reduced", ks, settings)
    model = models[best_k(scores).first().k]
    labels = kmeans.assign(vectors, "reduced", model, "label").select("speaker_id", "label")
    speakers = materialize(split_exact(labels, "speaker_id", settings), "speakers")
    examples = label_utterances(dialogue.utterances, speakers, settings)
    return LabelledDialogue(dialogue, vectors, scores, reducer, model, speakers, examples)


@dataclass(frozen=True)
class GivenLabels:
    speakers: DataFrame  # speaker_id, label, split
    examples: DataFrame  # speaker_id, pos, text, label, split
    report: DataFrame  # sizes of both sides and whether they differ


def label_by_position(dialogue: Dialogue, clusters: DataFrame, settings: Settings = Settings()) -> GivenLabels:
    """Label speakers from `(position, cluster_id)`: the i-th cluster goes to the i-th
    speaker. Speakers or clusters without a partner are left out and counted in `report`."""
    numbered = materialize(number_speakers(dialogue.speakers).select("speaker_id", "position"), "numbered")
    report = label_mismatch_report(numbered, clusters, "position")
    labels = attach_labels(numbered, clusters, "position").select("speaker_id", F.col("cluster_id").cast("int").alias("label"))
    speakers = materialize(split_exact(labels, "speaker_id", settings), "speakers")
    return GivenLabels(speakers, label_utterances(dialogue.utterances, speakers, settings), report)


def label_lines(lines: DataFrame, settings: Settings = Settings(), ks: Sequence[int] | None = None) -> LabelledDialogue:
    dialogue = parse_dialogue(lines)
    texts = persona_table(dialogue, settings)
    idf = hashed_idf(texts, "speaker_id", "persona_text", settings)
    embedded = hashed_tfidf(texts, "speaker_id", "persona_text", settings, idf=idf)
    return replace(label_vectors(dialogue, embedded, settings, ks), idf=idf)
