"""Whole runs that leave their results in a folder.

    python -m dialogue_factors.plans.jobs label OUT train.txt valid.txt
    python -m dialogue_factors.plans.jobs analyse OUT
    python -m dialogue_factors.plans.jobs score OUT new.txt
    python -m dialogue_factors.plans.jobs assign OUT train.txt valid.txt --clusters clusters.json

On a cluster give this file to spark-submit. `analyse` reads the examples that
`label` left; `score` needs the models that both left, and fits nothing; `assign` takes
the labels from a cluster file in the order of the speakers. Settings are flags, such as `--k-max 20 --seed 7 --silhouette-metric euclidean`.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from dialogue_factors.config import Settings
from dialogue_factors.operators import kmeans, reports
from dialogue_factors.operators.episodes import parse_dialogue, persona_texts, speaker_records
from dialogue_factors.operators.labels import attach_labels
from dialogue_factors.operators.reduce import map_2d
from dialogue_factors.plans.analyse import Analysis, analyse_examples
from dialogue_factors.plans.label_dialogue import GivenLabels, LabelledDialogue, label_by_position, label_lines
from dialogue_factors.plans.score import Scored, save_analysis, save_labeller, score_lines
from dialogue_factors.session import build_session, drop_scratch
from dialogue_factors.sources.dialogue_lines import read_lines
from dialogue_factors.sources.records import (
    place_cluster_records,
    read_example_tables,
    write_cluster_records,
    write_examples,
    write_k_scores,
    write_speakers,
)


def _table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def label_sources(
    spark: SparkSession, sources: Sequence[str], out: str, settings: Settings = Settings(), ks: Sequence[int] | None = None
) -> LabelledDialogue:
    """Label the utterances of dialogue files and write every table of the run."""
    result = label_lines(read_lines(spark, sources), settings, ks)
    clusters = result.speakers.select("speaker_id", result.speakers.label.alias("cluster_id"))
    write_examples(result.examples, f"{out}/examples")
    write_speakers(attach_labels(speaker_records(result.dialogue, settings), clusters), f"{out}/speakers")
    write_cluster_records(attach_labels(persona_texts(result.dialogue.facts, settings), clusters), f"{out}/personas")
    write_k_scores(result.k_scores, f"{out}/k_scores")
    _table(kmeans.centres_table(spark, result.model), f"{out}/centres")
    save_labeller(spark, f"{out}/models", result)
    stored = read_example_tables(spark, f"{out}/examples")
    _table(reports.class_distribution(stored), f"{out}/class_distribution")
    _table(reports.split_sizes(stored), f"{out}/split_sizes")
    _table(reports.cluster_sizes(clusters), f"{out}/cluster_sizes")
    labelled = attach_labels(result.vectors, result.speakers.select("speaker_id", "label"))
    _table(map_2d(labelled, ["speaker_id"], "label", ["reduced"]), f"{out}/map")
    return result


def analyse_labelled(spark: SparkSession, out: str, settings: Settings = Settings(), passes: int = 1) -> Analysis:
    """Analyse the examples under `out` and write the reports next to them."""
    result = analyse_examples(read_example_tables(spark, f"{out}/examples"), settings, passes)
    for name in ("scored", "accuracy", "confusion", "leakage", "persona_map", "chart"):
        _table(getattr(result, name), f"{out}/analysis/{name}")
    _table(result.factors.to_table(spark), f"{out}/analysis/factors")
    save_analysis(spark, f"{out}/models", result)
    return result


def assign_sources(
    spark: SparkSession, sources: Sequence[str], clusters: str, out: str, settings: Settings = Settings(), multi_line: bool = True
) -> GivenLabels:
    """Label dialogue files from a file of cluster records and write the examples, their
    counts, and the report of speakers and records without a partner."""
    result = label_by_position(parse_dialogue(read_lines(spark, sources)), place_cluster_records(spark, clusters, multi_line), settings)
    write_examples(result.examples, f"{out}/examples")
    stored = read_example_tables(spark, f"{out}/examples")
    _table(reports.class_distribution(stored), f"{out}/class_distribution")
    _table(reports.split_sizes(stored), f"{out}/split_sizes")
    _table(result.report, f"{out}/mismatch")
    return result


def score_sources(spark: SparkSession, sources: Sequence[str], out: str, settings: Settings = Settings()) -> Scored:
    """Score new dialogue files with the models under `out`; the tables go to `out`/scored."""
    result = score_lines(read_lines(spark, sources), f"{out}/models", settings)
    _table(result.speakers, f"{out}/scored/speakers")
    _table(result.utterances, f"{out}/scored/utterances")
    return result


# Settings that are flags of the command line.
FLAGS = ("seed", "k_min", "k_max", "kmeans_starts", "pca_dim", "text_dims", "silhouette_metric", "record_lines")


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("step", choices=("label", "analyse", "score", "assign"))
    parser.add_argument("out")
    parser.add_argument("sources", nargs="*")
    parser.add_argument("--clusters", help="cluster records as JSON, for assign")
    for flag in FLAGS:
        parser.add_argument(f"--{flag.replace('_', '-')}", type=type(getattr(Settings, flag)), default=getattr(Settings, flag))
    given = parser.parse_args(arguments)
    if given.step == "assign" and not given.clusters:
        parser.error("assign needs --clusters")
    settings = replace(Settings(), **{flag: getattr(given, flag) for flag in FLAGS})
    spark = build_session()
    try:
        if given.step == "label":
            label_sources(spark, given.sources, given.out, settings)
        elif given.step == "analyse":
            analyse_labelled(spark, given.out, settings)
        elif given.step == "assign":
            assign_sources(spark, given.sources, given.clusters, given.out, settings)
        else:
            score_sources(spark, given.sources, given.out, settings)
    finally:
        drop_scratch(spark)


if __name__ == "__main__":
    main()
