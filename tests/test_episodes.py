"""Lines to episodes: golden files, odd lines, order, long episodes."""

from __future__ import annotations

from dataclasses import replace

import pytest
from hypothesis import HealthCheck, given, settings as hyp, strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from dialogue_factors.config import Settings
from dialogue_factors.operators.episodes import (
    first_fact_personas,
    number_islands,
    number_speakers,
    parse_dialogue,
    persona_texts,
    segment_episodes,
    speaker_records,
    summarize_episodes,
)
from dialogue_factors.operators.examples import explode_records, label_utterances
from dialogue_factors.operators.order import place_in_order
from dialogue_factors.operators.lines import (
    classify_lines,
    is_dialogue,
    number_lines,
    persona_fact,
    persona_fact_between,
)
from dialogue_factors.operators.order import place_in_order
from dialogue_factors.sources.dialogue_lines import read_lines

GOLDEN = (
    "1 your persona: I like Cats .\n"
    "2 your persona: i ski .\n"
    "3 hello there\thi , how are you ?\n"
    "4 ok\tFine .\t\tc1|c2\n"
    "\n"
    "9\n"
    "1 your persona: i run .\n"
    "2 hey\tYO\n"
    "3 plain line without tab\n"
)


def write(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def records(dialogue, settings=Settings()):
    rows = speaker_records(dialogue, settings).orderBy("speaker_id", "part").collect()
    return [(r.persona_text, list(r.utterances)) for r in rows]


def test_golden_file(spark, tmp_path):
    dialogue = parse_dialogue(read_lines(spark, [write(tmp_path, "a.txt", GOLDEN)]))
    assert records(dialogue) == [
        ("i like cats . i ski .", ["hello there", "hi , how are you ?", "ok", "Fine ."]),
        ("i run .", ["hey", "YO"]),
    ]
    labels = spark.createDataFrame([(1, 3), (2, 4)], "speaker_id bigint, label int")
    flat = label_utterances(dialogue.utterances, labels).orderBy("speaker_id", "pos").collect()
    assert [(r.text, r.label) for r in flat] == [("hello there", 3), ("hi , how are you ?", 3), ("fine .", 3)]


def test_golden_variants(spark, tmp_path):
    path = write(tmp_path, "a.txt", GOLDEN)
    first = first_fact_personas(read_lines(spark, [path])).orderBy("source", "island").collect()
    assert [r.persona_text for r in first] == ["i like cats .", "i run ."]
    strict = parse_dialogue(read_lines(spark, [path]), exactly_two=True)
    assert records(strict)[0] == ("i like cats . i ski .", ["hello there", "hi , how are you ?"])
    replies = parse_dialogue(read_lines(spark, [path]), sides=["reply"])
    assert records(replies)[1] == ("i run .", ["YO"])
    with pytest.raises(ValueError):
        parse_dialogue(read_lines(spark, [path]), sides=["other"])


def test_first_fact_variant_on_odd_lines(spark, tmp_path):
    text = (
        "2 your persona: early\n1 hi\tyou\n"  # facts before a closing line that is no persona line
        "1 your persona: A\n2 your persona: b\n3 your persona: c\n1 yes\tno\n"  # own fact, then b and c
        "2 your persona: lost\n1 your persona: D\n"  # a persona line numbered 1 starts afresh
        "1 x your persona: E your persona: F\n"  # closes with its own fact, up to the second marker
        "2 your persona: open\n"  # never closed
    )
    rows = first_fact_personas(read_lines(spark, [write(tmp_path, "a.txt", text)])).orderBy("island").collect()
    assert [r.persona_text for r in rows] == ["early", "a", "b c", "d", "e"]


def test_odd_lines(spark, tmp_path):
    text = (
        "5 early\tturn\n"  # before the first persona line: episode 0 has no persona text
        "\xa0 1 your persona:   Tea 　\r\n"
        "2 tail\t\n"  # the strip removes the trailing tab
        "3 a\tb\n"
        "1 your persona: nobody speaks\n"
        "1 your persona: x your persona: y\n"
        "2 left\t right \tmore\n"
    )
    dialogue = parse_dialogue(read_lines(spark, [write(tmp_path, "a.txt", text)]))
    assert records(dialogue) == [("tea", ["a", "b"]), ("x  y", ["left", "right"])]


def test_markers_and_fields(spark):
    df = spark.createDataFrame([("1 your persona: x your persona: y", "your persona: x your persona: y")], "line string, rest string")
    row = df.select(persona_fact().alias("all"), persona_fact_between().alias("between")).first()
    assert (row["all"], row.between) == ("x  y", "x")
    fields = spark.createDataFrame([("a\tb",), ("a\tb\tc",), ("a",)], "rest string")
    assert [tuple(r) for r in fields.select(is_dialogue(), is_dialogue(exactly_two=True)).collect()] == [(True, True), (True, False), (False, False)]


def test_sources_keep_apart_and_missing_raises(spark, tmp_path):
    one = write(tmp_path, "one.txt", "1 your persona: a\n2 b\tc\n")
    two = write(tmp_path, "two.txt", "3 d\te\n1 your persona: f\n2 g\th\n")
    assert records(parse_dialogue(read_lines(spark, [two, one]))) == [("f", ["g", "h"]), ("a", ["b", "c"])]
    with pytest.raises(AnalysisException):
        read_lines(spark, [str(tmp_path / "absent.txt")]).count()
    with pytest.raises(ValueError):
        read_lines(spark, [])


def test_persona_without_dialogue_counts_on_request(spark, tmp_path):
    lines = read_lines(spark, [write(tmp_path, "a.txt", "1 your persona: a\n1 your persona: b\n2 c\td\n")])
    segments = segment_episodes(lines)
    assert summarize_episodes(segments).where("kept").count() == 1
    assert summarize_episodes(segments, require_dialogue=False).where("kept").count() == 2


def test_positions_run_across_sources(spark, tmp_path):
    one = write(tmp_path, "one.txt", "1 your persona: a\n1 your persona: b\n2 c\td\n1 your persona: e\n2 f\tg\n")
    two = write(tmp_path, "two.txt", "1 your persona: h\n2 i\tj\n")
    dialogue = parse_dialogue(read_lines(spark, [one, two]))
    rows = number_speakers(dialogue.speakers).orderBy("position").collect()
    assert [(r.source, r.episode, r.position) for r in rows] == [(0, 2, 0), (0, 3, 1), (1, 1, 2)]
    assert [r.speaker_id for r in rows] == [2, 3, (1 << 40) + 1]


def long_corpus(episodes):
    lines, expected = [], []
    for e in range(episodes):
        lines.append(f"1 your persona: fact {e}")
        turns = 60 if e == 3 else e % 4 + 1
        lines += [f"{t + 2} said {e} {t}\treply {e} {t}" for t in range(turns)]
        expected.append((f"fact {e}", [f"{w} {e} {t}" for t in range(turns) for w in ("said", "reply")]))
    return "\n".join(lines) + "\n", expected


def test_blocks_do_not_change_the_result(spark, tmp_path):
    text, expected = long_corpus(40)
    path = write(tmp_path, "a.txt", text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = read_lines(spark, [path])
        assert lines.select("file", "start").distinct().count() > 5
        assert records(parse_dialogue(lines)) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert records(parse_dialogue(read_lines(spark, [path]))) == expected


def test_long_episode_spans_records(spark, tmp_path):
    text, expected = long_corpus(6)
    dialogue = parse_dialogue(read_lines(spark, [write(tmp_path, "a.txt", text)]))
    small = replace(Settings(), record_lines=8)
    parts = speaker_records(dialogue, small).orderBy("speaker_id", "part").collect()
    assert max(len(r.utterances) for r in parts) <= 16
    joined = {}
    for r in parts:
        joined.setdefault(r.speaker_id, []).extend(r.utterances)
    assert list(joined.values()) == [u for _, u in expected]
    labels = spark.createDataFrame([(i + 1, i) for i in range(6)], "speaker_id bigint, cluster_id int")
    nested = explode_records(speaker_records(dialogue, small).join(labels, "speaker_id"), small).orderBy("speaker_id", "pos").collect()
    flat = label_utterances(dialogue.utterances, labels.withColumnRenamed("cluster_id", "label")).orderBy("speaker_id", "pos").collect()
    assert [(r.speaker_id, r.text, r.label) for r in nested] == [(r.speaker_id, r.text, r.label) for r in flat]
    assert persona_texts(dialogue.facts, small).where("part = 0").count() == 6


def test_records_without_parts(spark):
    nested = spark.createDataFrame([(7, ["  Hello ", "no", "World"], 2)], "speaker_id bigint, utterances array<string>, cluster_id bigint")
    rows = explode_records(nested).orderBy("pos").collect()
    assert [(r.pos, r.text, r.label) for r in rows] == [(0, "hello", 2), (2, "world", 2)]


def test_only_spaced_lines_survive(spark):
    df = spark.createDataFrame([("  7 rest of it ",), ("",), ("  ",), ("9",), (None,)], "line string")
    assert [(r.number, r.rest) for r in number_lines(df).collect()] == [("7", "rest of it")]
    assert classify_lines(number_lines(df)).first().is_dialogue is False


@hyp(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.booleans(), min_size=1, max_size=40), st.integers(1, 6), st.booleans())
def test_islands_against_a_loop(spark, flags, blocks, including):
    rows = [(0, i, f) for i, f in enumerate(flags)]
    lines = spark.createDataFrame(rows, "source int, at int, opens boolean")
    placed = place_in_order(lines, "source", "at", partitions=blocks)
    got = {r["at"]: (r.island, r.offset) for r in number_islands(placed, F.col("opens"), F.lit(True), including).collect()}
    count, last = 0, 0
    for i, opens in enumerate(flags):
        if not including:
            assert got[i] == (count, i - last)
        if opens:
            count, last = count + 1, i
        if including:
            assert got[i] == (count, i - last)


@pytest.mark.parametrize("stored", [False, True])
def test_splits_that_change_before_the_action_lose_no_line(spark, tmp_path, stored):
    text, _ = long_corpus(400)
    lines = read_lines(spark, [write(tmp_path, "a.txt", text)])
    if stored:
        lines = place_in_order(lines.select("source", "ln", "line"), "ln").select("source", "file", "start", "ln", "line")
    read = lambda df: sorted(map(repr, df.collect()))
    expected = read(segment_episodes(lines))
    segmented = segment_episodes(lines)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.minPartitionNum", "9")
        assert read(segmented) == expected and expected
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
        spark.conf.unset("spark.sql.files.minPartitionNum")
