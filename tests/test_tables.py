"""Order, labels, splits, counts, files, streams."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import sys
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from dialogue_factors.config import Settings
from dialogue_factors.operators import reports, splits
from dialogue_factors.operators.examples import keep_utterances, label_utterances, seeded_shuffle
from dialogue_factors.operators.labels import attach_by_position, label_mismatch_report
from dialogue_factors.operators.order import rank_by_hash, with_row_index
from dialogue_factors.session import broadcast_if_small, materialize, shared_folder
from dialogue_factors.sources import records
from dialogue_factors.streaming.utterances import stream_utterances, write_stream


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_row_index_over_partitions(spark):
    df = spark.range(0, 1000, 3).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    rows = with_row_index(df, "k", partitions=7).orderBy("k").collect()
    assert [r.row_index for r in rows] == list(range(len(rows)))


def test_rank_by_hash(spark):
    keys = list(range(300))
    rows = rank_by_hash(spark.createDataFrame([(k,) for k in keys], "k int"), 42, "k", total="n").orderBy("rank").collect()
    assert [r.k for r in rows] == sorted(keys, key=lambda k: md5(f"42:{k}"))
    assert [r["rank"] for r in rows] == list(range(1, 301)) and {r.n for r in rows} == {300}


@pytest.mark.parametrize("n,sizes", [(1, (0, 0, 1)), (7, (5, 1, 1)), (20, (16, 2, 2)), (101, (80, 10, 11))])
def test_exact_split_sizes(spark, n, sizes):
    got = {r.split: r.n for r in reports.split_sizes(splits.split_exact(spark.range(n).withColumnRenamed("id", "speaker_id"))).collect()}
    assert tuple(got.get(s, 0) for s in splits.SPLITS) == sizes


def test_splits_repeat_and_stay_apart(spark):
    speakers = spark.range(200).withColumnRenamed("id", "speaker_id")
    one = splits.split_exact(speakers.repartition(1)).orderBy("speaker_id").collect()
    many = splits.split_exact(speakers.repartition(8)).orderBy("speaker_id").collect()
    assert one == many
    rows = speakers.withColumn("split", splits.hash_split("speaker_id")).select("*", F.explode(F.sequence(F.lit(1), F.lit(3))))
    assert {(r.pair, r.n) for r in splits.split_overlap(rows).collect()} == {("train-val", 0), ("train-test", 0), ("val-test", 0)}
    mixed = spark.createDataFrame([(1, "train"), (1, "test"), (2, "val")], "speaker_id int, split string")
    assert {r.pair: r.n for r in splits.split_overlap(mixed).collect()}["train-test"] == 1


def test_positional_labels_are_cut_to_the_shorter_side(spark):
    left = spark.createDataFrame([("b",), ("a",), ("c",)], "name string")
    right = spark.createDataFrame([(9, 1), (5, 0)], "at int, label int")
    got = attach_by_position(left, ["name"], right, ["at"]).orderBy("position").collect()
    assert [(r.name, r.label) for r in got] == [("a", 0), ("b", 1)]


def test_mismatch_report(spark):
    left, right = spark.range(5).toDF("k"), spark.range(3, 10).toDF("k")
    assert tuple(label_mismatch_report(left, right, "k").first()) == (5, 7, 2, 3, 5, True)
    assert tuple(label_mismatch_report(left.limit(0), left.limit(0), "k").first()) == (0, 0, 0, 0, 0, False)


def test_hot_speaker_is_split_and_keeps_every_row(spark):
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    }
    hot = F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id"))  # a third of all rows
    utterances = spark.range(0, 60000, 1, 6).select(hot.alias("speaker_id"), F.col("id").alias("pos"), F.concat(F.lit("hello "), "id").alias("text"))
    labels = spark.range(60000).select(F.col("id").alias("speaker_id"), (F.col("id") % 5).cast("int").alias("label"))
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        joined = label_utterances(utterances, labels).groupBy("label").agg(F.count("pos").alias("n"), F.max("text"))
        rows = {r.label: r.n for r in joined.collect()}
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        assert sum(rows.values()) == 60000 and rows[1] > 20000
    finally:
        for key in small:
            spark.conf.unset(key)


def test_clean_keeps_longer_than_three_code_points(spark):
    df = spark.createDataFrame([("\xa0ABCD　",), (" abc ",), ("\U0001f600\U0001f600\U0001f600",), ("ÄÖÜß",)], "text string")
    assert [r.text for r in keep_utterances(df).collect()] == ["abcd", "äöüß"]


def test_shuffle_differs_by_epoch_and_repeats(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    order = lambda epoch: [r.k for r in seeded_shuffle(df, epoch, "k").orderBy("rank").collect()]
    assert order(0) == order(0) != order(1) and sorted(order(1)) == list(range(50))


def test_reports(spark):
    rows = spark.createDataFrame([(5, 0.2), (6, 0.3), (7, 0.3), (8, -0.1)], "k int, silhouette double")
    assert reports.best_k(rows).first().k == 6
    assert [r.k for r in reports.chart_sample(rows, 2, "k").collect()] == [5, 6]
    speakers = spark.createDataFrame([(0, 1), (1, 1), (2, 4)], "speaker_id int, cluster_id int")
    assert [tuple(r) for r in reports.cluster_sizes(speakers).collect()] == [(1, 2), (4, 1)]


def test_files(spark, tmp_path):
    array = tmp_path / "clusters.json"
    array.write_text(json.dumps([{"persona_text": "a", "cluster_id": 3}, {"persona_text": "b", "cluster_id": 1}], indent=2))
    assert [(r.persona_text, r.cluster_id) for r in records.read_cluster_records(spark, str(array)).collect()] == [("a", 3), ("b", 1)]
    examples = tmp_path / "train.json"
    examples.write_text(json.dumps([{"text": "hello", "label": 2}]))
    row = records.read_examples(spark, str(examples), multi_line=True).first()
    assert (row.text, row.label) == ("hello", 2)

    df = spark.createDataFrame([(0, 1, "hello", 2, "train"), (1, 0, "there", 3, "val")], "speaker_id bigint, pos bigint, text string, label int, split string")
    out = str(tmp_path / "examples")
    for _ in range(2):  # a second write replaces the first
        records.write_examples(df, out)
    assert records.read_example_tables(spark, out).count() == 2
    assert "PartitionFilters: [isnotnull(split" in records.read_example_tables(spark, out).where("split = 'train'")._jdf.queryExecution().toString()

    scores = spark.createDataFrame([(6, 0.5), (5, 0.25)], "k int, silhouette double")
    records.write_k_scores(scores, str(tmp_path / "scores"))
    text = next((tmp_path / "scores").glob("part-*.csv")).read_text().splitlines()
    assert text == ["K,Silhouette", "5,0.25", "6,0.5"]
    assert records.read_k_scores(spark, str(tmp_path / "scores")).orderBy("k").collect() == scores.orderBy("k").collect()

    nested = spark.createDataFrame([(0, 0, "p", ["u", "v"], 1)], "speaker_id bigint, part bigint, persona_text string, utterances array<string>, cluster_id int")
    records.write_speakers(nested, str(tmp_path / "speakers"))
    records.write_cluster_records(nested, str(tmp_path / "personas"))
    back = spark.read.schema(nested.schema).json(str(tmp_path / "speakers"))
    assert back.collect() == nested.collect()
    assert spark.read.json(str(tmp_path / "personas")).columns == ["cluster_id", "persona_text", "speaker_id"]


def test_stream_of_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1 your persona: x\n2 Hello there\tok\n3 no tab\n")
    rows = stream_utterances(spark, str(tmp_path / "in"))
    assert rows.isStreaming
    write_stream(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("2", 0, "hello there")]


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_broadcast_only_below_the_limit(spark):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(broadcast_if_small(spark.range(10), 10)) and not hinted(broadcast_if_small(spark.range(11), 10))


def test_materialized_table_is_stored(spark):
    df = materialize(spark.range(5).withColumn("r", F.rand()), "check")
    assert shared_folder(spark) in df.inputFiles()[0] and df.collect() == df.collect()


def test_scratch_can_be_dropped(tmp_path):
    script = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from dialogue_factors.session import build_session, drop_scratch, materialize\n"
        "spark = build_session('local[1]', **{'spark.checkpoint.dir': sys.argv[2], 'spark.ui.enabled': 'false'})\n"
        "materialize(spark.range(3), 'x').count(); drop_scratch(spark); spark.stop()\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "kept.txt").write_text("not ours")
    subprocess.run([sys.executable, "-c", script, root, str(tmp_path)], check=True, capture_output=True, timeout=120)
    assert not [p for p in tmp_path.rglob("*.parquet")] and (tmp_path / "kept.txt").exists()


def test_settings_are_frozen():
    with pytest.raises(AttributeError):
        Settings().seed = 1
    assert replace(Settings(), seed=1).seed == 1
