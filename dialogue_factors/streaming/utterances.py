"""Row-wise steps on streams of dialogue lines.

Parsing, cleaning, nearest-centre assignment and linear heads keep no state, so
the batch functions accept a streaming DataFrame as it is. Segmentation into
episodes depends on line order and keeps state: see `streaming/episodes.py`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dialogue_factors.config import Settings
from dialogue_factors.operators.examples import keep_utterances
from dialogue_factors.operators.lines import classify_lines, number_lines


def stream_utterances(spark: SparkSession, folder: str, settings: Settings = Settings()) -> DataFrame:
    """Cleaned utterances `(number, side, text)` of text files as they arrive."""
    lines = spark.readStream.text(folder).withColumnRenamed("value", "line")
    turns = classify_lines(number_lines(lines)).where("is_dialogue")
    sides = turns.select("number", F.posexplode(F.array("said", "reply")).alias("side", "text"))
    return keep_utterances(sides, settings)


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet until the files present at the start are processed."""
    return (
        rows.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
