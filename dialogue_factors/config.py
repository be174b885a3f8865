"""Constants of the analysis in one frozen object handed to each operator."""

from __future__ import annotations

from dataclasses import dataclass

# The input format and the figures every result depends on.
PERSONA_MARKER = "your persona:"
FIRST_LINE_NUMBER = "1"
FIELD_SEPARATOR = "\t"
# Every character that str.isspace() accepts, i.e. what a full strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
PAD_ID, UNKNOWN_ID, START_ID, END_ID, FIRST_TOKEN_ID = 0, 1, 2, 3, 4


@dataclass(frozen=True)
class Settings:
    """Fixed values of the published configuration; override by keyword."""

    seed: int = 42
    pca_dim: int = 100
    k_min: int = 5
    k_max: int = 15
    kmeans_starts: int = 10
    kmeans_max_iter: int = 300
    kmeans_tol: float = 1e-4
    seeding_rounds: int = 5
    silhouette_metric: str = "squared"  # or "euclidean": exact, quadratic in rows
    text_dims: int = 384
    min_text_length: int = 3
    max_tokens: int = 64
    vocabulary_size: int = 30_000
    word_vocabulary: int = 20_000
    word_window: int = 4
    word_dims: int = 100
    word_rounds: int = 3
    word_smoothing: float = 1e-3
    persona_dim: int = 128
    content_dim: int = 128
    classes: int = 14
    epochs: int = 10
    batch_size: int = 64
    staged_from_epoch: int = 5
    adversary_weight: float = 0.1
    overlap_weight: float = 0.005
    probe_max_iter: int = 1000
    map_rows: int = 4000
    compare_rows: int = 3000
    # Longest run of lines kept in one nested record; longer episodes take
    # several records, so that no single row grows without bound.
    record_lines: int = 4096
