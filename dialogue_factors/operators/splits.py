"""Train, validation and test parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dialogue_factors.config import Settings
from dialogue_factors.functions.text import hash_number, seeded_hash
from dialogue_factors.operators.order import rank_by_hash

SPLITS = ("train", "val", "test")


def split_exact(speakers: DataFrame, key: str = "speaker_id", settings: Settings = Settings()) -> DataFrame:
    """80/10/10 with exact sizes: a fifth of the speakers (rounded up) is held out,
    half of it (rounded up) is the test part."""
    ranked = rank_by_hash(speakers, settings.seed, key, total="total")
    held_out = F.expr("(total + 4) div 5")
    test = F.expr("((total + 4) div 5 + 1) div 2")
    split = F.when(F.col("rank") <= test, "test").when(F.col("rank") <= held_out, "val").otherwise("train")
    return ranked.withColumn("split", split).drop("rank", "total")


def hash_split(key: str, settings: Settings = Settings()) -> Column:
    """80/10/10 by hash: no shuffle, sizes approximate, a speaker never moves."""
    draw = hash_number(seeded_hash(settings.seed, key)) % 100
    return F.when(draw < 80, "train").when(draw < 90, "val").otherwise("test")


def hash_holdout(*keys: str, settings: Settings = Settings()) -> Column:
    """True for the fifth of the rows held out to test a probe."""
    return hash_number(seeded_hash(settings.seed, *keys)) % 5 == 0


def split_overlap(rows: DataFrame, key: str = "speaker_id") -> DataFrame:
    """Number of keys shared by each pair of splits; all zero when split by speaker."""
    where = {s: F.max((F.col("split") == s).cast("int")).alias(s) for s in SPLITS}
    per_key = rows.groupBy(key).agg(*where.values())
    both = lambda a, b: F.struct(F.lit(f"{a}-{b}").alias("pair"), F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).cast("bigint").alias("n"))
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    return per_key.agg(F.array(*(both(a, b) for a, b in pairs)).alias("pairs")).select(F.inline("pairs"))
