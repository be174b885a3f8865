"""Explicit schemas; nothing is inferred on read."""

from __future__ import annotations

LINES = "source int, file string, start bigint, ln bigint, line string"
CLUSTER_RECORDS = "speaker_id bigint, persona_text string, cluster_id int"
SPEAKER_RECORDS = (
    "speaker_id bigint, part bigint, persona_text string, "
    "utterances array<string>, cluster_id int"
)
EXAMPLES = "speaker_id bigint, pos bigint, text string, label int, split string"
K_SCORES = "k int, silhouette double"
HISTORY = "epoch int, metric string, value double"
FACTOR_BASIS = "row int, vector array<double>"
CENTRES = "cluster int, centre array<double>"
MODEL_PARTS = "part string, row int, weights array<double>, bias double"
MODEL_MARKS = "run string, epoch int, number bigint, version string"
HEADS = "epoch int, name string, row int, weights array<double>, bias double"
