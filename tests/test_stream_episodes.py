"""Episodes from streams against the batch parser."""

from __future__ import annotations

import random
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from dialogue_factors.config import Settings
from dialogue_factors.operators.episodes import parse_dialogue, speaker_records
from dialogue_factors.sources.dialogue_lines import read_lines
from dialogue_factors.streaming.episodes import stream_episodes, stream_lines, write_episodes

GOLDEN = (
    "1 your persona: I like Cats .\n2 your persona: i ski .\n3 hello there\thi , how are you ?\n4 ok\tFine .\t\tc1|c2\n\n9\n"
    "1 your persona: i run .\n2 hey\tYO\n3 plain line without tab\n"
)


def dialogue(seed, episodes):
    draw, lines = random.Random(seed), ["5 before any start\tdropped"]
    for e in range(episodes):
        kind = draw.random()
        if kind < 0.9:
            lines += [f"1 your persona: i am {e} ."] + [f"{i + 2} your persona: fact {i} ." for i in range(draw.randint(0, 2))]
        else:
            lines.append("1 your persona: nobody answers .")
        if kind > 0.15:
            lines += [f"{i + 4} q{e}.{i}\ta{e}.{i}" for i in range(draw.randint(1, 9))] + ["7 no second field", ""]
    return lines


def test_three_batches_with_restarts(spark, tmp_path):
    texts = {"a": dialogue(1, 30), "b": dialogue(2, 3), "c": GOLDEN.split("\n")}
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "state")
    cuts = {name: [0, len(rows) // 3 + 1, 2 * len(rows) // 3, len(rows)] for name, rows in texts.items()}
    for turn in range(3):  # cuts fall inside episodes; each turn is a new query on the same checkpoint
        for name, rows in texts.items():
            (tmp_path / "in" / name).mkdir(parents=True, exist_ok=True)
            (tmp_path / "in" / name / f"part-{turn:05d}.txt").write_text("\n".join(rows[cuts[name][turn]:cuts[name][turn + 1]]) + "\n")
        write_episodes(stream_episodes(stream_lines(spark, str(tmp_path / "in"))), out, checkpoint).awaitTermination(120)
    got = spark.read.parquet(out).collect()
    for name, rows in texts.items():
        path = tmp_path / f"{name}.txt"
        path.write_text("\n".join(rows) + "\n")
        batch = speaker_records(parse_dialogue(read_lines(spark, [str(path)]))).collect()
        expected = sorted((r.speaker_id, r.part, r.persona_text, r.utterances) for r in batch)
        mine = sorted((r.episode, r.part, r.persona_text, r.utterances) for r in got if r.source == name)
        assert mine == expected[:-1]  # the last episode of a source is still open


def run_memory(spark, tmp_path, rows, settings=Settings(), **options):
    """Rows in batches of `(source, part, line)`, one query per batch."""
    schema, out = "source string, part long, file string, start long, n long, line string", str(tmp_path / "out")
    for turn, batch in enumerate(rows):
        spark.createDataFrame([(s, p, "f", 0, i, line) for i, (s, p, line) in enumerate(batch)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        lines = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        write_episodes(stream_episodes(lines, settings=settings, **options), out, str(tmp_path / "state")).awaitTermination(120)
    return sorted((r.source, r.episode, r.part, r.persona_text, r.utterances) for r in spark.read.parquet(out).collect())


def test_end_marks_and_long_episodes(spark, tmp_path):
    lines = ["1 your persona: P .", *[f"{i + 2} q{i}\ta{i}" for i in range(7)], "1 your persona: alone .", None]
    got = run_memory(spark, tmp_path, [[("x", 0, line) for line in lines[:5]], [("x", 1, line) for line in lines[5:]]], replace(Settings(), record_lines=3))
    assert [g[:4] for g in got] == [("x", 1, 0, "p ."), ("x", 1, 1, ""), ("x", 1, 2, "")]
    assert [u for g in got for u in g[4]] == [f"{side}{i}" for i in range(7) for side in "qa"]


def test_late_lines_raise(spark, tmp_path):
    with pytest.raises(Exception, match="comes after later ones"):
        run_memory(spark, tmp_path, [[("x", 5, "1 your persona: a .")], [("x", 4, "2 q\ta")]])


def test_idle_sources_let_out_what_is_complete(spark, tmp_path):
    schema, folder = "source string, part long, file string, start long, n long, line string", str(tmp_path / "in")
    add = lambda rows: spark.createDataFrame([(s, p, "f", 0, i, line) for i, (s, p, line) in enumerate(rows)], schema).write.mode("append").parquet(folder)
    add([("x", 0, "1 your persona: a ."), ("x", 0, "2 q\ta"), ("y", 0, "1 your persona: waits .")])
    lines = spark.readStream.schema(schema).parquet(folder)
    query = write_episodes(stream_episodes(lines, idle_ms=1000), str(tmp_path / "out"), str(tmp_path / "state"), available_now=False, every="1 second")
    records = lambda: sorted((r.source, r.episode, r.part, r.persona_text, r.utterances) for r in spark.read.schema(query_schema).parquet(str(tmp_path / "out")).collect())
    query_schema = "source string, episode long, part long, persona_text string, utterances array<string>"
    until = time.time() + 90
    while time.time() < until and not (list((tmp_path / "out").glob("*.parquet")) and records()):
        time.sleep(0.5)
    assert records() == [("x", 1, 0, "a .", ["q", "a"])]
    add([("x", 1, "3 more\tyes")])  # a further part of the same episode
    while time.time() < until and len(records()) < 2:
        time.sleep(0.5)
    query.stop()
    assert records() == [("x", 1, 0, "a .", ["q", "a"]), ("x", 1, 1, "", ["more", "yes"])]
