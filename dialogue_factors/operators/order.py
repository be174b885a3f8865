"""Global order without a single-task sort: positions, row numbers, hash ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dialogue_factors.functions.text import seeded_hash
from dialogue_factors.session import materialize
from dialogue_factors.sources.dialogue_lines import scan_block

_LOCAL_BITS = 33  # monotonically_increasing_id(): partition above, position below


def place_in_order(df: DataFrame, *order: Column | str, partitions: int | None = None) -> DataFrame:
    """Store rows in the given order and read them back with `ln`, which increases in
    it, and the file split of each row.

    One range shuffle. The order key should be unique, so that slices stay even
    when one source or speaker holds much of the data. Stored before use: the
    slice bounds are sampled and must not be drawn twice.
    """
    args = ([partitions] if partitions else []) + list(order)
    placed = df.repartitionByRange(*args).sortWithinPartitions(*order).withColumn("ln", F.monotonically_increasing_id())
    return materialize(placed, "placed").select("*", *scan_block())


def with_row_index(df: DataFrame, *order: Column | str, name: str = "row_index", partitions: int | None = None) -> DataFrame:
    """Dense 0-based row number in the given order."""
    placed = place_in_order(df, *order, partitions=partitions).withColumn("slice", F.shiftright("ln", _LOCAL_BITS))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shuffle partition, so both the window and the broadcast are small.
    offsets = (
        placed.groupBy("slice").agg(F.count(F.lit(1)).alias("rows"))
        .select("slice", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    )
    local = F.col("ln") - F.shiftleft("slice", _LOCAL_BITS)
    return (
        placed.join(F.broadcast(offsets), "slice")
        .withColumn(name, F.col("rows_before") + local)
        .drop("slice", "ln", "rows_before", "file", "start")
    )


def rank_in_buckets(
    df: DataFrame, buckets: list[str], order: list[str], rank: str = "rank", total: str | None = None, bounded: bool = False,
    within: Sequence[str] = (),
) -> DataFrame:
    """1-based rank by `(buckets, order)`: ranks inside each bucket, shifted by the
    counts of the earlier buckets. Buckets must rise with the order and stay small.

    `bounded` says that the number of buckets has a fixed limit, so that their
    counts may be broadcast; otherwise they are joined by key. Each value of the `within`
    columns is ranked by itself.
    """
    buckets = [*within, *buckets]
    through = Window.partitionBy(*within).orderBy(*buckets)
    everything = through.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = df.groupBy(*buckets).agg(F.count(F.lit(1)).alias("_rows"))
    columns = [(F.sum("_rows").over(through) - F.col("_rows")).alias("_before")]
    if total:
        columns.append(F.sum("_rows").over(everything).alias(total))
    offsets = counts.select(*buckets, *columns)
    return (
        df.withColumn("_inside", F.row_number().over(Window.partitionBy(*buckets).orderBy(*order)))
        .join(F.broadcast(offsets) if bounded else offsets, buckets)
        .withColumn(rank, F.col("_before") + F.col("_inside"))
        .drop("_before", "_inside")
    )


def rank_by_hash(df: DataFrame, seed: int | str, *keys: str, rank: str = "rank", total: str | None = None) -> DataFrame:
    """1-based rank of each row in the order of md5(seed:keys), and the row count.

    The buckets are the 65,536 digest prefixes, which an md5 of a unique key fills evenly.
    """
    hashed = df.withColumn("_digest", seeded_hash(seed, *keys)).withColumn("_bucket", F.substring("_digest", 1, 4))
    return rank_in_buckets(hashed, ["_bucket"], ["_digest", *keys], rank, total, bounded=True).drop("_digest", "_bucket")
