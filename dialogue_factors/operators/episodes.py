"""Episodes: runs of lines that belong to one speaker.

The running counts that delimit episodes are taken per block (a file split, which one
task reads in order) and shifted by what the earlier blocks add up to. A source of any
size is spread over many tasks and its lines are not shuffled; blocks contribute one
small row each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from dialogue_factors.config import FIRST_LINE_NUMBER, PERSONA_MARKER, Settings
from dialogue_factors.operators.lines import (
    classify_lines,
    mentions_persona,
    number_lines,
    persona_fact_between,
)
from dialogue_factors.operators.order import rank_in_buckets
from dialogue_factors.session import broadcast_if_small, materialize


def running_opens(opens: str, including_current: bool) -> Column:
    """`(seen, opened)`: opening lines so far in the block, and `ln` of the last one (-1: none).

    Rows must come in the order of the scan, as they do right after a read; what a
    task has counted in a block carries over its batches.
    """

    @F.arrow_udf("seen bigint, opened bigint")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        current, seen, opened, last = None, 0, -1, -1
        for block_, ln_, opens_ in batches:
            block, ln = block_.to_numpy(), ln_.to_numpy()
            flags = opens_.to_numpy(zero_copy_only=False).astype(bool)
            counts, lines = np.empty(len(ln), np.int64), np.empty(len(ln), np.int64)
            bounds = [0, *(np.flatnonzero(np.diff(block)) + 1), len(ln)] if len(ln) else []
            for low, high in zip(bounds[:-1], bounds[1:]):
                if block[low] != current:
                    current, seen, opened, last = block[low], 0, -1, -1
                part = slice(low, high)
                if (np.diff(ln[part], prepend=last) <= 0).any():
                    raise ValueError("lines are out of order: number them right after reading")
                run_count = np.concatenate([[seen], seen + np.cumsum(flags[part])])
                run_line = np.maximum.accumulate(np.concatenate([[opened], np.where(flags[part], ln[part], -1)]))
                shift = slice(1, None) if including_current else slice(None, -1)
                counts[part], lines[part] = run_count[shift], run_line[shift]
                seen, opened, last = run_count[-1], run_line[-1], ln[high - 1]
            yield pa.StructArray.from_arrays([pa.array(counts), pa.array(lines)], ["seen", "opened"])

    return run.asNondeterministic()("block", "ln", opens)


def block_key() -> Column:
    """A source's share of a file split, as one number."""
    return F.xxhash64("source", "file", "start")


def block_offsets(flagged: DataFrame, opens: str) -> DataFrame:
    """One row per block: what the blocks before it in its source add up to."""
    # Aggregates of numbers only, so that lines are hashed, not sorted.
    totals = flagged.groupBy("source", "file", "start").agg(
        F.count_if(opens).alias("opened"),
        F.min("ln").alias("first"),
        (F.max("ln") - F.min("ln") + 1).alias("lines"),
        F.max(F.when(F.col(opens), F.col("ln"))).alias("last_open"),
    )
    part = F.regexp_extract(F.element_at(F.split("file", "/"), -1), r"^part-(\d+)", 1).try_cast("bigint")
    earlier = Window.partitionBy("source").orderBy("part", "file", "start").rowsBetween(Window.unboundedPreceding, -1)
    alike = F.count(F.lit(1)).over(Window.partitionBy("source", "block"))
    clash = F.raise_error(F.lit("two file splits share a block key")).cast("bigint")
    return (
        totals.withColumn("block", block_key()).withColumn("part", part)
        .withColumn("first", F.when(alike == 1, F.col("first")).otherwise(clash))
        .withColumn("island0", F.coalesce(F.sum("opened").over(earlier), F.lit(0)))
        .withColumn("row0", F.coalesce(F.sum("lines").over(earlier), F.lit(0)))
        .withColumn("open_row", F.col("row0") + F.col("last_open") - F.col("first"))
        .withColumn("carried", F.coalesce(F.max("open_row").over(earlier), F.lit(0)))
        .select("source", "block", "first", "island0", "row0", "carried")
    )


def number_islands(lines: DataFrame, opens: Column, keep: Column, including_current: bool = True) -> DataFrame:
    """Add `island`, the number of opening lines so far in the source, and `offset`,
    the distance in lines from the last one. Rows that fail `keep` are left out.

    With `including_current=False` an opening line still counts to the island before
    it. `lines` come straight from `read_lines` or `place_in_order`: they are counted
    where they are read, and only one row per block is shuffled. They are read once and
    stored with their block, as another read may split the files elsewhere.
    """
    flagged = lines.withColumn("_opens", opens).withColumn("block", block_key())
    flagged = materialize(flagged.withColumn("_run", running_opens("_opens", including_current)), "lines")
    offsets = broadcast_if_small(materialize(block_offsets(flagged, "_opens"), "blocks"))
    lost = F.raise_error(F.lit("a line's block has no offset")).cast("bigint")
    return (
        flagged.where(keep).join(offsets, ["source", "block"], "left")
        .withColumn("_row", F.coalesce("row0", lost)).withColumn("_row", F.col("row0") + F.col("ln") - F.col("first"))
        .withColumn(
            "_open_row",
            F.when(F.col("_run.opened") < 0, F.col("carried"))
            .otherwise(F.col("row0") + F.col("_run.opened") - F.col("first")),
        )
        .withColumn("island", F.col("island0") + F.col("_run.seen"))
        .withColumn("offset", F.col("_row") - F.col("_open_row"))
        .drop("block", "_opens", "_run", "_row", "_open_row", "first", "island0", "row0", "carried")
    )


def segment_episodes(lines: DataFrame, exactly_two: bool = False) -> DataFrame:
    """One row per persona or dialogue line: `(source, episode, offset, is_fact, fact, said, reply)`.

    An episode starts at a persona line numbered 1 and ends before the next start
    or at the end of the source. Lines before the first start form episode 0.
    """
    kinds = classify_lines(number_lines(lines), exactly_two)
    placed = number_islands(kinds, F.col("is_start"), F.col("is_persona") | F.col("is_dialogue"))
    return placed.select(
        "source", F.col("island").alias("episode"), "offset", F.col("is_persona").alias("is_fact"), "fact", "said", "reply"
    )


def speaker_key() -> Column:
    """One number per episode, rising with source and episode."""
    return F.shiftleft(F.col("source").cast("bigint"), 40) + F.col("episode")


def summarize_episodes(segments: DataFrame, require_dialogue: bool = True) -> DataFrame:
    """`(source, episode, speaker_id, last_offset, kept)`: whether an episode has
    persona text (and dialogue), and how far it runs."""
    kept = F.col("has_fact") & F.col("has_dialogue") if require_dialogue else F.col("has_fact")
    flags = segments.groupBy("source", "episode").agg(
        F.max("is_fact").alias("has_fact"), F.max(~F.col("is_fact")).alias("has_dialogue"), F.max("offset").alias("last_offset")
    )
    return flags.select("source", "episode", speaker_key().alias("speaker_id"), "last_offset", kept.alias("kept"))


def number_speakers(speakers: DataFrame) -> DataFrame:
    """Add `position`: 0, 1, 2, ... in the order of sources and episodes."""
    # Episode numbers are consecutive, so a slice of them makes an even bucket.
    sliced = speakers.withColumn("slice", F.expr("episode div 65536"))
    ranked = rank_in_buckets(sliced, ["source", "slice"], ["episode"])
    return ranked.withColumn("position", F.col("rank") - 1).drop("slice", "rank")


@dataclass(frozen=True)
class Dialogue:
    """A parsed corpus in long form; nothing per speaker is gathered into one row."""

    speakers: DataFrame  # source, episode, speaker_id, last_offset
    facts: DataFrame  # speaker_id, pos, fact
    utterances: DataFrame  # speaker_id, pos, text


def parse_dialogue(
    lines: DataFrame, sides: Sequence[str] = ("said", "reply"), exactly_two: bool = False,
    require_dialogue: bool = True,
) -> Dialogue:
    """Segment lines and key facts and utterances by speaker.

    `sides` chooses which half of each turn counts as the speaker's utterances. Without
    `require_dialogue` an episode of persona text alone is a speaker too.
    """
    if not sides or not set(sides) <= {"said", "reply"}:
        raise ValueError("sides must name 'said', 'reply' or both")
    segments = materialize(segment_episodes(lines, exactly_two), "segments")
    episodes = materialize(summarize_episodes(segments, require_dialogue), "episodes")
    # Incomplete episodes are few in an orderly corpus: leaving them out by a
    # broadcast saves a shuffle of all lines. Beyond the limit it is a plain join.
    rejected = broadcast_if_small(episodes.where(~F.col("kept")).select("speaker_id"))
    keyed = segments.withColumn("speaker_id", speaker_key()).join(rejected, "speaker_id", "left_anti")
    facts = keyed.where("is_fact").select("speaker_id", F.col("offset").alias("pos"), "fact")
    ordered = [s for s in ("said", "reply") if s in sides]
    utterances = (
        keyed.where(~F.col("is_fact"))
        .select("speaker_id", "offset", F.posexplode(F.array(*ordered)).alias("side", "text"))
        .select("speaker_id", (F.col("offset") * 2 + F.col("side")).alias("pos"), "text")
    )
    return Dialogue(episodes.where("kept").drop("kept"), facts, utterances)


def persona_texts(facts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`(speaker_id, part, persona_text)`: facts in order, joined by a space, lower-cased.

    Each part covers `record_lines` lines, so a group stays small; ordinary
    episodes have part 0 only.
    """
    return (
        facts.groupBy("speaker_id", F.expr(f"pos div {settings.record_lines}").alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "fact"))).alias("run"))
        .select("speaker_id", "part", F.lower(F.array_join("run.fact", " ")).alias("persona_text"))
    )


def speaker_records(dialogue: Dialogue, settings: Settings = Settings()) -> DataFrame:
    """Nested records `(speaker_id, part, persona_text, utterances)`.

    An episode longer than `record_lines` lines continues in part 1, 2, ...; text
    or utterances a part lacks are empty.
    """
    none = F.lit(None).cast("string")
    facts = dialogue.facts.select(
        "speaker_id", F.col("pos").alias("offset"), F.lit(0).alias("side"), "fact", none.alias("text")
    )
    both = facts.unionByName(
        dialogue.utterances.select(
            "speaker_id", F.expr("pos div 2").alias("offset"), F.expr("cast(pos % 2 as int)").alias("side"),
            none.alias("fact"), "text",
        )
    )
    return (
        both.groupBy("speaker_id", F.expr(f"offset div {settings.record_lines}").alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("offset", "side", "fact", "text"))).alias("run"))
        .select(
            "speaker_id", "part",
            F.lower(F.array_join(F.array_compact("run.fact"), " ")).alias("persona_text"),
            F.array_compact("run.text").alias("utterances"),
        )
    )


def first_fact_personas(lines: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Variant that closes a persona at every line starting `1 `.

    A line `1 your persona: ...` yields its own fact alone; any other line
    starting `1 ` yields the facts met since the previous such line, if any.
    """
    closes = F.col("line").startswith("1 ")
    facts = number_islands(lines, closes, closes | mentions_persona(), including_current=False).select(
        "source", "island", "offset", closes.alias("closes"),
        F.col("line").startswith(f"{FIRST_LINE_NUMBER} {PERSONA_MARKER}").alias("alone"),
        F.when(mentions_persona(), persona_fact_between()).alias("fact"),
    )
    facts = materialize(facts, "first-facts")
    own = facts.where("alone").select("source", "island", F.lit(0).cast("bigint").alias("part"), F.lower("fact").alias("persona_text"))
    # A run's closing line is unique, so this join has one match at most per fact.
    closing = facts.where(F.col("closes") & ~F.col("alone")).select("source", "island")
    gathered = (
        facts.where(F.col("fact").isNotNull() & ~F.col("alone"))
        .join(closing, ["source", "island"])
        .groupBy("source", "island", F.expr(f"offset div {settings.record_lines}").alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("offset", "fact"))).alias("run"))
        .select("source", "island", "part", F.lower(F.array_join("run.fact", " ")).alias("persona_text"))
    )
    return own.unionByName(gathered)
