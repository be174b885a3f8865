"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dialogue_factors.llm.common import bounded
from dialogue_factors.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """`node, root` for the nodes of `edges` (`u, v`); the root is the least node.

    Large-star and small-star steps in turn: a logarithmic number of rounds for any
    shape, each a join and a distinct, with the edges stored between rounds.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Stored, so that the join is a broadcast, or one that the optimizer may split.
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = both.join(bounded(least, 160), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "edges")
        lowest = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(bounded(lowest, 160), "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        edges = materialize(small.distinct(), "edges")
        new = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if new == state:
            break
        state = new
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
