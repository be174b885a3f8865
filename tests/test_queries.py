"""Each registered query against its SQL on the small tables, and the whole chain."""

from __future__ import annotations

import json
import os
import sys
from collections import Counter
from dataclasses import replace

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from dialogue_factors.config import Settings  # noqa: E402
from dialogue_factors.operators.metrics import epoch_batches, epoch_history, number_batches  # noqa: E402
from dialogue_factors.operators.splits import split_overlap  # noqa: E402
from dialogue_factors.plans.catalog import QUERIES  # noqa: E402
from dialogue_factors.plans.jobs import analyse_labelled, assign_sources, label_sources, score_sources
from dialogue_factors.plans.label_dialogue import label_lines
from dialogue_factors.schema import SPEAKER_RECORDS  # noqa: E402
from dialogue_factors.sources.dialogue_lines import read_lines  # noqa: E402


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for name in os.listdir(data):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{data}/{name}'")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: f"{v + 0.0:.6f}".replace("-0.000000", "0.000000") if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


# The corpus operators have their tests in tests/llm; a scan of few documents may rightly find nothing.
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    result = contract.queries()[name](spark, data)
    rows = result.collect()
    if name not in contract.oracle_sql():
        assert rows
        return
    expected = duck.sql(contract.oracle_sql()[name])
    assert sorted(result.columns) == sorted(expected.columns)
    assert canonical(result.columns, rows) == canonical(expected.columns, expected.fetchall())


def test_every_oracle_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_labels_from_a_cluster_file(spark, tmp_path):
    """A JSON array of clusters that is longer than the corpus: the surplus is reported."""
    lines = [x for s in range(20) for x in (f"1 your persona: speaker {s} .", f"2 good day number {s}\tgood day to you")]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    (tmp_path / "clusters.json").write_text(json.dumps([{"persona_text": "", "cluster_id": i % 7} for i in range(23)]))
    out = str(tmp_path / "out")
    result = assign_sources(spark, [str(tmp_path / "a.txt")], str(tmp_path / "clusters.json"), out)
    report = spark.read.parquet(f"{out}/mismatch").first()
    assert (report.n_left, report.n_right, report.n_matched, report.n_right_only, report.mismatch) == (20, 23, 20, 3, True)
    rows = spark.read.parquet(f"{out}/examples").collect()
    assert len(rows) == 40 and {r.split for r in rows} == {"train", "val", "test"}
    assert all(r.label == int(r.text.split()[-1]) % 7 for r in rows if r.text.startswith("good day number"))
    assert {r.label for r in rows} == set(range(7)) and result.speakers.count() == 20


def test_batches_hold_every_row_once(spark):
    scored = [(e, i, i % 2, [float(i % 3), 1.0], [0.0, 1.0], [1.0, float(i)], [0.5, 2.0]) for e in (0, 7) for i in range(70)]
    rows = spark.createDataFrame(scored, "epoch int, id int, label int, logits array<double>, adv_logits array<double>, z_p array<double>, z_c array<double>")
    batches = number_batches(rows, "id").collect()
    sizes = Counter((r.epoch, r.batch) for r in batches)
    assert sizes == {(e, b): n for e in (0, 7) for b, n in ((0, 64), (1, 6))}
    order = lambda e: [r.id for r in sorted(batches, key=lambda r: (r.batch, r.id)) if r.epoch == e]
    assert sorted(order(0)) == list(range(70)) and order(0) != order(7)
    one = replace(Settings(), batch_size=1000)
    whole = {r.epoch: r.loss for r in epoch_history(rows).collect()}
    assert all(abs(r.loss - whole[r.epoch]) < 1e-12 and r.n_batches == 1 for r in epoch_batches(rows, "id", settings=one).collect())
    assert epoch_batches(rows.limit(0), "id").count() == 0


def test_chain_from_files(spark, tmp_path):
    topics = [["cats", "dogs", "pets"], ["ski", "snow", "hills"], ["bread", "oven", "flour"]]
    lines = []
    for s in range(45):
        words = topics[s % 3]
        lines += [f"1 your persona: i love {words[0]} and {words[1]} .", f"2 your persona: {words[2]} are great ."]
        lines += [f"{t + 3} do you like {words[t % 3]}\tyes , {words[(t + 1) % 3]} too" for t in range(4)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    out = str(tmp_path / "out")
    result = label_sources(spark, [str(tmp_path / "a.txt")], out, ks=[2, 3, 4])
    assert result.model.k == 3 and result.k_scores.count() == 3
    assert {r["count"] for r in result.speakers.groupBy("label").count().collect()} == {15}
    examples = result.examples.persist()
    assert examples.count() == 45 * 8
    assert {r.n for r in split_overlap(examples).collect()} == {0}
    assert {r.split: r["count"] // 8 for r in examples.groupBy("split").count().collect()} == {"train": 36, "val": 4, "test": 5}
    speakers = spark.read.schema(SPEAKER_RECORDS).json(f"{out}/speakers")
    assert speakers.count() == 45 and {len(r.utterances) for r in speakers.collect()} == {8}
    assert spark.read.parquet(f"{out}/map").count() == 45 and spark.read.parquet(f"{out}/centres").count() == 3
    analysis = analyse_labelled(spark, out)
    assert analysis.accuracy.first().n == 40 and analysis.accuracy.first().accuracy == 1.0
    assert {r.space for r in spark.read.parquet(f"{out}/analysis/leakage").collect()} == {"embedding", "z_p", "z_c"}
    # The stored models alone give the speakers their labels again, and new ones theirs.
    known = {r.speaker_id: r.label for r in result.speakers.collect()}
    again = score_sources(spark, [str(tmp_path / "a.txt")], out)
    assert {r.speaker_id: r.label for r in again.speakers.collect()} == known
    assert again.utterances.count() == 45 * 8 and again.utterances.where("label <> prediction").count() == 0
    assert spark.read.parquet(f"{out}/scored/utterances").columns == ["speaker_id", "pos", "text", "label", "logits", "prediction"]
    (tmp_path / "new.txt").write_text("\n".join(lines[6:12]))
    fresh = score_sources(spark, [str(tmp_path / "new.txt")], out)
    assert [r.label for r in fresh.speakers.collect()] == [known[min(known) + 1]] and fresh.utterances.count() == 8
    (tmp_path / "empty.txt").write_text("nothing here\n")
    with pytest.raises(ValueError):
        label_lines(read_lines(spark, [str(tmp_path / "empty.txt")]))
