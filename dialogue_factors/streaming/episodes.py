"""Episodes from streams: the open episode of each source is kept as state.

Lines are numbered and parsed where they are read; only persona and dialogue lines reach
the state. A source's lines come in order of its part files, so a micro-batch holds whole
part files, later ones in later batches; a line from before what a source has passed
raises. `maxFilesPerTrigger` bounds what one source can bring at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from dialogue_factors.config import Settings
from dialogue_factors.operators.lines import classify_lines, number_lines

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RECORDS = "source string, episode long, part long, persona_text string, utterances array<string>"
PLACE = ("part", "file", "start", "n")
HEAD = "episode long, done long, held long, has_fact boolean, has_dialogue boolean, part long, file string, start long, n long, timer long"
HELD = "fact string, said string, reply string"


def number_streamed(lines: DataFrame) -> DataFrame:
    """Add `n`, the place of a row in its file split: `(source, part, file, start, n, line)`.
    Rows must come as they are read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for rows in batches:
            files, starts = rows.column("file").to_pylist(), rows.column("start").to_pylist()
            n = np.empty(rows.num_rows, np.int64)
            for i, split in enumerate(zip(files, starts)):
                if split != last:
                    last, seen = split, 0
                n[i] = seen
                seen += 1
            yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(n), rows.column("line")], [*rows.schema.names[:4], "n", "line"])

    ordered = lines.select("source", "part", "file", "start", "line")
    return ordered.mapInArrow(count, "source string, part long, file string, start long, n long, line string")


def stream_lines(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Lines of `<folder>/<source>/<part file>` as the files arrive, numbered."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    path = F.split("file", "/")
    named = reader.text(folder).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line")
    )
    number = F.regexp_extract(F.element_at(path, -1), r"(\d+)", 1).try_cast("bigint")
    return number_streamed(named.select(
        F.element_at(path, -2).alias("source"), F.coalesce(number, F.lit(0)).alias("part"), "file", "start", "line"
    ))


class OpenEpisodes(StatefulProcessor):
    """State of a source: counts of the open episode, and its lines that are not out yet.

    Lines of an episode wait in a list until it has both persona and dialogue; then every
    `record_lines` of them leave as a part of its record, and the rest when the next
    episode begins, when the source ends, or when it has been idle for `idle_ms`. A timer
    lets out what is complete and keeps the counts, so lines that come later are further
    parts of the same episode: timing never decides what is in the result.
    """

    def __init__(self, record_lines: int, idle_ms: int | None = None):
        self.record_lines, self.idle_ms = record_lines, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)
        self.lines = handle.getListState("lines", HELD)

    def _out(self, source: str, head: dict) -> Iterator[Row]:
        """The held lines as one or several parts, if the episode is complete."""
        if not head["held"] or not (head["has_fact"] and head["has_dialogue"]):
            return
        held = self.lines.get()
        while part := list(islice(held, self.record_lines)):
            facts = " ".join(fact for fact, _, _ in part if fact is not None)
            texts = [text for fact, *sides in part if fact is None for text in sides if text is not None]
            yield Row(source=source, episode=head["episode"], part=head["done"], persona_text=facts.lower(), utterances=texts)
            head["done"] += 1
        self.lines.clear()
        head["held"] = 0

    def _close(self, source: str, head: dict) -> Iterator[Row]:
        yield from self._out(source, head)
        self.lines.clear()  # an episode without persona or without dialogue is none
        head.update(held=0, done=0, has_fact=False, has_dialogue=False)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        source = key[0]
        names = [c.split()[0] for c in HEAD.split(", ")]
        head = dict(zip(names, self.head.get() if self.head.exists() else (0, 0, 0, False, False, -1, "", -1, -1, None)))
        waiting: list[tuple] = []
        for row in sorted(rows, key=lambda r: tuple(r[c] for c in PLACE)):
            place = tuple(row[c] for c in PLACE)
            if place <= tuple(head[c] for c in PLACE):
                raise ValueError(f"a line of {source} at {place} comes after later ones")
            head.update(zip(PLACE, place))
            if row["ended"] or row["is_start"]:
                self._keep(waiting, head)
                yield from self._close(source, head)
                head["episode"] += row["is_start"]
            if row["is_persona"] or row["is_dialogue"]:
                waiting.append((row["fact"], row["said"], row["reply"]))
                head["has_fact"] |= row["is_persona"]
                head["has_dialogue"] |= row["is_dialogue"]
                if head["held"] + len(waiting) >= self.record_lines:
                    self._keep(waiting, head)
                    yield from self._out(source, head)
        self._keep(waiting, head)
        if self.idle_ms is not None:
            if head["timer"] is not None:
                self.handle.deleteTimer(head["timer"])
            head["timer"] = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(head["timer"])
        self.head.update(tuple(head[c] for c in names))

    def _keep(self, waiting: list[tuple], head: dict) -> None:
        if waiting:
            self.lines.appendList(waiting)
            head["held"] += len(waiting)
            waiting.clear()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        names = [c.split()[0] for c in HEAD.split(", ")]
        head = dict(zip(names, self.head.get()))
        yield from self._out(key[0], head)
        head["timer"] = None
        self.head.update(tuple(head[c] for c in names))

    def close(self) -> None:
        pass


def stream_episodes(lines: DataFrame, idle_ms: int | None = None, exactly_two: bool = False, settings: Settings = Settings()) -> DataFrame:
    """Records `(source, episode, part, persona_text, utterances)` as episodes close.

    `lines` is a stream of `source, part, file, start, n, line` as `stream_lines` gives
    it. A null line ends its source: its last episode closes. With `idle_ms` a source
    that brings nothing for so long lets out what it holds. Episodes are numbered as in
    the batch parser: 1, 2, ... by persona lines numbered 1, and 0 before the first.
    """
    ends = lines.where("line is null").select(
        *lines.columns[:5], F.lit(True).alias("ended"), *(F.lit(False).alias(c) for c in ("is_start", "is_persona", "is_dialogue")),
        *(F.lit(None).cast("string").alias(c) for c in ("fact", "said", "reply")),
    )
    kinds = classify_lines(number_lines(lines.where("line is not null")), exactly_two).where("is_persona or is_dialogue")
    parsed = kinds.select(*lines.columns[:5], F.lit(False).alias("ended"), "is_start", "is_persona", "is_dialogue", "fact", "said", "reply")
    return parsed.unionByName(ends).groupBy("source").transformWithState(
        statefulProcessor=OpenEpisodes(settings.record_lines, idle_ms), outputStructType=RECORDS, outputMode="Append",
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )


def write_episodes(records: DataFrame, path: str, checkpoint: str, available_now: bool = True, every: str = "10 seconds") -> StreamingQuery:
    """Append records to Parquet. State is kept by RocksDB below `checkpoint`, from which a
    stopped or lost query goes on; every record is written once."""
    records.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    writer = records.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
