"""Mean silhouette: exact with Euclidean distance, or linear with squared distance.

The two differ in value. The Euclidean form needs the distance of all pairs of
rows, so its work grows with the square of the table; use the squared form, two
passes however many rows, on large tables. A lone member of a cluster scores 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from dialogue_factors.functions.matrices import as_lists, as_matrix
from dialogue_factors.operators.kmeans import Clustering


def _scores(own: np.ndarray, per_cluster: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Silhouette of each row from its summed distances to the members of each cluster."""
    rows = np.arange(len(own))
    size = counts[own]
    inner = per_cluster[rows, own] / np.maximum(size - 1, 1)
    outer = per_cluster / np.where(counts > 0, counts, np.nan)
    outer[rows, own] = np.nan
    if (counts > 0).sum() < 2:
        return np.zeros(len(own))
    near = np.nanmin(outer, axis=1)
    widest = np.maximum(inner, near)
    return np.where((size > 1) & (widest > 0), (near - inner) / np.where(widest > 0, widest, 1.0), 0.0)


def _mean_per_labelling(partials: DataFrame) -> DataFrame:
    return partials.groupBy("labelling").agg((F.sum("s") / F.sum("n")).alias("silhouette"))


def silhouette_of_models(vectors: DataFrame, vector: str, models: Sequence[Clustering]) -> DataFrame:
    """`(labelling, silhouette)` with squared distance for fitted models, in one pass."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, n = np.zeros(len(models)), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = as_matrix(batch.column(0))
            n += len(rows)
            for i, m in enumerate(models):
                x, centres = rows - m.origin, m.centres - m.origin
                norms = np.einsum("ij,ij->i", x, x)
                half = 0.5 * np.einsum("ij,ij->i", centres, centres)
                own = (half - x @ centres.T).argmin(axis=1)
                summed = norms[:, None] * m.counts + m.squares - 2 * (x @ m.sums.T)
                s[i] += _scores(own, np.maximum(summed, 0.0), m.counts).sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(models)), pa.int32()), pa.array(s), pa.array(np.full(len(models), n), pa.int64())],
            ["labelling", "s", "n"],
        )

    return _mean_per_labelling(vectors.select(vector).mapInArrow(partial, "labelling int, s double, n bigint"))


def _cluster_totals(rows: DataFrame, vector: str, label: str) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels, rows, and sums and squared norms around the last of these, the overall mean."""
    packed = array_to_vector(vector)
    found = (
        rows.groupBy(label).agg(
            F.count(F.lit(1)).alias("n"),
            vector_to_array(Summarizer.mean(packed)).alias("mean"),
            vector_to_array(Summarizer.variance(packed)).alias("variance"),
        ).orderBy(label).collect()  # one row per cluster
    )
    counts = np.array([float(r.n) for r in found])
    means, variances = (np.array([r[c] for r in found]).reshape(len(found), -1) for c in ("mean", "variance"))
    origin = counts @ means / max(counts.sum(), 1.0)
    means = means - origin
    squares = (counts - 1) * variances.sum(axis=1) + counts * (means**2).sum(axis=1)
    return [r[label] for r in found], counts, means * counts[:, None], squares, origin


def silhouette_squared(rows: DataFrame, vector: str, label: str) -> DataFrame:
    """`(label, n, silhouette)` per cluster, squared distance, for labels at hand."""
    names, counts, sums, squares, origin = _cluster_totals(rows, vector, label)
    lookup = pa.array(names)

    @F.arrow_udf("double")
    def score(vectors: pa.Array, labels: pa.Array) -> pa.Array:
        x = as_matrix(vectors)
        x = x - origin if len(x) else x.reshape(0, len(origin))
        own = pc.index_in(labels, value_set=lookup.cast(labels.type)).to_numpy(zero_copy_only=False)
        summed = np.einsum("ij,ij->i", x, x)[:, None] * counts + squares - 2 * (x @ sums.T)
        return pa.array(_scores(own, np.maximum(summed, 0.0), counts))

    return (
        rows.select(label, score(vector, label).alias("s")).groupBy(label)
        .agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("silhouette"))
    )


# Rows of a block, at most about; rows of two blocks whose distances a task holds at once.
BLOCK_ROWS, TILE_ROWS = 32_768, 2048
# Blocks that smaller tables are cut into, so that all tasks have work.
BLOCKS = 16


def count_blocks(n: int, block_rows: int | None = None) -> int:
    """Blocks of a table of n rows, which is also how often each row is shuffled: their
    number stays the same until blocks reach `BLOCK_ROWS`, the bound of a task's memory."""
    if block_rows:
        return max(1, -(-n // block_rows))
    return max(1, -(-n // BLOCK_ROWS), min(BLOCKS, -(-n // TILE_ROWS)))


def row_silhouettes(rows: DataFrame, key: str, vector: str, labels: Sequence[str], block_rows: int | None = None) -> DataFrame:
    """`(key, labels, s)`: exact Euclidean silhouette of each row under each label column.

    Rows fall into even blocks by key hash, whatever the cluster sizes. A task
    meets two blocks at a time, multiplies them as matrices, tile by tile, and passes on
    one vector per row, its summed distance to each cluster; pairs are never emitted.
    """
    sizes = (
        rows.select(F.posexplode(F.array(*labels)).alias("at", "name")).groupBy("at", "name")
        .agg(F.count(F.lit(1)).alias("n")).orderBy("at", "name").collect()  # one row per cluster
    )
    spaces = [[r.name for r in sizes if r["at"] == i] for i in range(len(labels))]
    counts = np.array([float(r.n) for r in sizes])
    edges = np.cumsum([0] + [len(s) for s in spaces])
    code = lambda c, s: (F.array_position(F.array(*map(F.lit, s)), F.col(c)) - 1).cast("int")
    coded = rows.select(
        F.col(key).alias("key"), F.col(vector).alias("x"), F.array(*map(code, labels, spaces)).alias("codes")
    )
    n = int(counts[: edges[1]].sum())
    blocks = count_blocks(n, block_rows)

    def members(codes_: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes_), edges[-1]))
        for i, low in enumerate(edges[:-1]):
            out[np.arange(len(codes_)), low + codes_[:, i]] = 1.0
        return out

    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * (a @ b.T)
        return np.sqrt(np.maximum(square, 0.0))

    def meet(table: pa.Table) -> pa.Table:
        x = as_matrix(table.column("x"))
        x = x - x.mean(axis=0)
        c = as_matrix(table.column("codes")).astype(int)
        h, low, high = (table.column(name).to_numpy() for name in ("h", "low", "high"))
        first, second = np.flatnonzero(h == low), np.flatnonzero(h == high)
        own, summed = low[0] == high[0], np.zeros((len(x), edges[-1]))
        for i in range(0, len(first), TILE_ROWS):
            a = first[i : i + TILE_ROWS]
            for j in range(0, len(second), TILE_ROWS):
                b = second[j : j + TILE_ROWS]
                d = distances(x[a], x[b])
                if own and i == j:
                    np.fill_diagonal(d, 0.0)
                summed[a] += d @ members(c[b])
                if not own:
                    summed[b] += d.T @ members(c[a])
        if not len(first) or not len(second):
            table, summed = table.slice(0, 0), summed[:0]
        return pa.table({"key": table.column("key"), "codes": table.column("codes"), "summed": as_lists(summed)})

    pairs = (
        coded.withColumn("h", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .withColumn("low", F.least("h", "other")).withColumn("high", F.greatest("h", "other")).drop("other")
    )
    key_type = coded.schema["key"].dataType.simpleString()
    summed = (
        pairs.groupBy("low", "high").applyInArrow(meet, f"key {key_type}, codes array<int>, summed array<double>")
        .groupBy("key").agg(F.any_value("codes").alias("codes"), vector_to_array(Summarizer.sum(array_to_vector("summed"))).alias("summed"))
    )

    @F.arrow_udf("array<double>")
    def score(codes_: pa.Array, totals: pa.Array) -> pa.Array:
        c, t = as_matrix(codes_).astype(int), as_matrix(totals)
        columns = [_scores(c[:, i], t[:, low:high], counts[low:high]) for i, (low, high) in enumerate(zip(edges[:-1], edges[1:]))]
        return as_lists(np.column_stack(columns))

    return summed.select(F.col("key").alias(key), "codes", score("codes", "summed").alias("s"))


def silhouette_exact(rows: DataFrame, key: str, vector: str, labels: Sequence[str], block_rows: int | None = None) -> DataFrame:
    """`(labelling, silhouette)` for each label column by position."""
    scored = row_silhouettes(rows, key, vector, labels, block_rows)
    return (
        scored.select(F.posexplode("s").alias("labelling", "s"))
        .groupBy("labelling").agg(F.avg("s").alias("silhouette"))
    )
