"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

SLOTS = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def fill_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The shard number of every slot.

    Each shard prefers the slots in the order (offset + j * skip) mod `slots`, both drawn
    from its name, a permutation as `slots` is prime. Shards claim in turn the first slot
    they prefer that is free, so all hold as many slots (but for one), and a shard that
    leaves or joins moves few others.
    """
    if not _is_prime(slots) or not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("needs a prime number of slots, and as many different shards at most")
    digests = [hashlib.md5(name.encode()).digest() for name in shards]
    place = [int.from_bytes(d[:8], "big") % slots for d in digests]
    skip = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digests]
    table = np.full(slots, -1, np.int32)
    claimed = 0
    while claimed < slots:
        for k in range(len(shards)):
            while table[place[k]] >= 0:
                place[k] = (place[k] + skip[k]) % slots
            table[place[k]] = k
            claimed += 1
            if claimed == slots:
                break
    return table


def slot_table(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    return spark.createDataFrame([(i, shards[k]) for i, k in enumerate(fill_table(shards, slots).tolist())], "slot int, shard string")


def assign_shards(rows: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """Add `slot` and `shard` (a name of `shards`) to each row, by the hash of its key.

    The table has `slots` rows whatever the data, so it is broadcast; placement is one
    look-up and moves no row. Null keys share the slot of the empty string. Equal keys go
    to one shard, however many: use a key that tells rows apart. An existing `slot` or
    `shard` column is replaced.
    """
    table = slot_table(rows.sparkSession, shards, slots)
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    slot = (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots).cast("int")
    return rows.drop("slot", "shard").withColumn("slot", slot).join(F.broadcast(table), "slot")


def moved_rows(rows: DataFrame, before: list[str], after: list[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """`key, slot, shard, shard_after`: each row's shard under two lists of shards."""
    again = slot_table(rows.sparkSession, after, slots).withColumnRenamed("shard", "shard_after")
    placed = assign_shards(rows.select(key), before, key, slots)
    return placed.join(F.broadcast(again), "slot").select(key, "slot", "shard", "shard_after")
