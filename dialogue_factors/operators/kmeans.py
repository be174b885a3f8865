"""K-means for many (k, start) pairs at once.

Choosing k needs a fit per k and start. Fitting them one by one reads the data
models x iterations times; here one pass moves every model one step: tasks turn
each batch into per-cluster counts and sums for all models, and only those sums
(clusters x dims, independent of the rows) are shuffled and reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from dialogue_factors import schema
from dialogue_factors.config import Settings
from dialogue_factors.functions.matrices import as_matrix, nearest, nearest_square
from dialogue_factors.functions.text import hash_number, seeded_hash


@dataclass(frozen=True)
class Clustering:
    """Centres of one model and, once scored, its cost and cluster statistics, which are
    taken around `origin` so that data far from zero lose no digits."""

    seed: int
    centres: np.ndarray  # (k, dims)
    counts: np.ndarray | None = None  # (k,)
    sums: np.ndarray | None = None  # (k, dims)
    squares: np.ndarray | None = None  # (k,) sum of squared norms
    origin: np.ndarray | float = 0.0  # (dims,)
    cost: float = float("inf")

    @property
    def k(self) -> int:
        return len(self.centres)


def seeded_rows(vectors: DataFrame, key: str, vector: str, seed: int, n: int, total: int) -> np.ndarray:
    """The n first of `total` rows in hash order, identical on every run and partitioning.

    A cut on the hash leaves a few times n rows to be sorted; should it leave too
    few, the rows are drawn again without it.
    """
    drawn = vectors.select(seeded_hash(seed, key).alias("h"), F.col(key).alias("key"), vector)
    rows, share = [], 4 * n / max(total, 1)
    if share < 1:
        rows = drawn.where(hash_number(F.col("h")) < int(share * 2**32)).orderBy("h", "key").limit(n).collect()
    if len(rows) < n:
        rows = drawn.orderBy("h", "key").limit(n).collect()
    if not rows:
        raise ValueError("no vectors to cluster")
    return np.array([r[vector] for r in rows], dtype=float)


def candidate_pool(
    vectors: DataFrame, key: str, vector: str, k: int, settings: Settings, total: int
) -> tuple[np.ndarray, np.ndarray]:
    """Rows that may become centres, drawn from all rows, and the rows nearest to each.

    In each of `seeding_rounds` rounds a row joins with odds 2k x its squared distance to
    the pool over the sum of all such distances; the draw is a hash of its key. The pool
    holds about 2k rows for each round, whatever the number of rows.
    """
    pool = seeded_rows(vectors, key, vector, settings.seed, 1, total)
    for turn in range(settings.seeding_rounds):
        far = vectors.select(key, vector, nearest_square(vector, pool).alias("_d"))
        cost = far.agg(F.sum("_d").alias("cost")).first().cost
        if not cost > 0:
            break
        draw = hash_number(seeded_hash(f"{settings.seed}:{turn}", key))
        joined = far.where(draw < F.lit(2.0**32 * 2 * k / cost) * F.col("_d")).orderBy(key).select(vector).collect()
        if joined:
            pool = np.vstack([pool, np.array([r[vector] for r in joined], dtype=float)])
    if len(pool) < k:  # few rows, or few distinct ones
        pool = np.vstack([pool, seeded_rows(vectors, key, vector, settings.seed, k, total)])
    near = vectors.groupBy(nearest(vector, pool).alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()
    weights = np.zeros(len(pool))
    weights[[r["at"] for r in near]] = [r.n for r in near]
    return pool, weights


def spread_starts(pool: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows of a pool, each drawn with odds by weight and squared distance to those before."""
    rng = np.random.default_rng(seed)
    chosen = [pool[rng.choice(len(pool), p=weights / weights.sum())]]
    closest = ((pool - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k:
        odds = closest * weights
        pick = rng.choice(len(pool), p=odds / odds.sum()) if odds.sum() > 0 else rng.integers(len(pool))
        chosen.append(pool[pick])
        closest = np.minimum(closest, ((pool - pool[pick]) ** 2).sum(axis=1))
    return np.array(chosen)


def starts(
    vectors: DataFrame, key: str, vector: str, ks: Sequence[int], settings: Settings = Settings(), spread: bool = True
) -> list[Clustering]:
    """Starting centres for every k and seed.

    `spread` draws them from a pool that all rows could enter, the far ones with better
    odds; otherwise they are the k first rows in the seed's hash order.
    """
    seeds = range(settings.seed, settings.seed + settings.kmeans_starts)
    total = vectors.count()
    if spread:
        pool, weights = candidate_pool(vectors, key, vector, max(ks), settings, total)
        return [Clustering(s, spread_starts(pool, weights, k, s)) for k in ks for s in seeds]
    drawn = {s: seeded_rows(vectors, key, vector, s, max(ks), total) for s in seeds}
    return [Clustering(s, drawn[s][:k]) for k in ks for s in seeds]


def assignment_totals(vectors: DataFrame, vector: str, models: Sequence[Clustering]) -> list[Clustering]:
    """Assign every row under each model and return the models with their totals.

    The least index wins among equally near centres.
    """
    centres = np.vstack([m.centres for m in models])
    origin = centres.mean(axis=0)
    centres = centres - origin
    half = 0.5 * np.einsum("ij,ij->i", centres, centres)
    edges = np.cumsum([0] + [m.k for m in models])
    slots, dims = centres.shape

    def memberships(gap: np.ndarray) -> np.ndarray:
        """(slots, rows) ones where a row's nearest centre of a model is."""
        member = np.zeros(gap.shape)
        for low, high in zip(edges[:-1], edges[1:]):
            np.equal(gap[low:high], gap[low:high].min(axis=0), out=member[low:high], casting="unsafe")
        tied = np.flatnonzero(member.sum(axis=0) != len(models))
        if len(tied):
            member[:, tied] = 0.0
            for low, high in zip(edges[:-1], edges[1:]):
                member[low + gap[low:high, tied].argmin(axis=0), tied] = 1.0
        return member

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, square, cost = np.zeros(slots), np.zeros(slots), np.zeros(slots)
        total = np.zeros((slots, dims))
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = as_matrix(batch.column(0)) - origin
            for first in range(0, len(rows), 2048):  # keeps the (slots, rows) blocks in cache
                x = rows[first : first + 2048]
                norms = np.einsum("ij,ij->i", x, x)
                gap = half[:, None] - centres @ x.T
                member = memberships(gap)
                squared = member @ norms
                count += member.sum(axis=1)
                total += member @ x
                square += squared
                cost += np.maximum(squared + 2 * np.einsum("ij,ij->i", gap, member), 0.0)
        stats = np.column_stack([count, square, cost, total])
        per_model = pa.ListArray.from_arrays(pa.array(edges * (dims + 3), pa.int32()), pa.array(stats.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models)), pa.int32()), per_model], ["model", "stats"])

    summed = (
        vectors.select(vector).mapInArrow(totals, "model int, stats array<double>")
        .groupBy("model").agg(vector_to_array(Summarizer.sum(array_to_vector("stats"))).alias("stats"))
        .toArrow()  # one row per model
    )
    stats = {m: s.values.to_numpy().reshape(-1, dims + 3) for m, s in zip(summed["model"].to_pylist(), summed["stats"])}
    none = np.zeros((slots, dims + 3))
    scored = [(m, stats.get(i, none[: m.k])) for i, m in enumerate(models)]
    return [
        replace(m, counts=s[:, 0], squares=s[:, 1], cost=float(s[:, 2].sum()), sums=s[:, 3:], origin=origin) for m, s in scored
    ]


def fit(
    vectors: DataFrame, vector: str, models: Sequence[Clustering], max_iter: int, tol: float = 0.0
) -> list[Clustering]:
    """Move all models until they settle; finished models leave the pass.

    A model is settled when its centres move by no more than `tol` times the mean
    variance of the dimensions (summed squares). A centre without rows stays put.
    The result carries totals under the final centres. Keep `vectors` stored or
    persisted: it is read once per iteration.
    """
    current, active, limit = list(models), list(range(len(models))), None
    for _ in range(max_iter):
        for i, scored in zip(active, assignment_totals(vectors, vector, [current[i] for i in active])):
            if limit is None:
                n, mean = scored.counts.sum(), scored.sums.sum(axis=0) / scored.counts.sum()
                limit = tol * max(scored.squares.sum() / n - mean @ mean, 0.0) / len(mean)
            filled = scored.counts > 0
            moved = scored.centres.copy()
            moved[filled] = scored.origin + scored.sums[filled] / scored.counts[filled, None]
            settled = ((moved - scored.centres) ** 2).sum() <= limit
            current[i] = Clustering(scored.seed, moved)
            if settled:
                active = [a for a in active if a != i]
        if not active:
            break
    return assignment_totals(vectors, vector, current)


def best_of_starts(models: Sequence[Clustering]) -> dict[int, Clustering]:
    """For each k the model of least cost; the first seed wins a tie."""
    best: dict[int, Clustering] = {}
    for m in sorted(models, key=lambda m: (m.k, m.cost, m.seed)):
        best.setdefault(m.k, m)
    return best


def assign(rows: DataFrame, vector: str, model: Clustering, output: str = "cluster_id") -> DataFrame:
    return rows.withColumn(output, nearest(vector, model.centres))


def centres_table(spark: SparkSession, model: Clustering) -> DataFrame:
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(model.centres)]
    return spark.createDataFrame(rows, schema.CENTRES)


def read_centres(table: DataFrame, seed: int = 0) -> Clustering:
    return Clustering(seed, np.array([r.centre for r in table.orderBy("cluster").collect()]))
