"""Centroid clustering over blocks of vectors in Hilbert order with min/max boxes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from dialogue_factors.llm.common import batch, mix
from dialogue_factors.session import materialize

# Principal axes that the curve runs through, and bits of each; the order only decides how
# tight boxes are.
CURVE_DIMS = 3
CURVE_BITS = 8
# |component| below this: 64 squares of differences of such numbers fit a long.
LARGEST = 1 << 26
# Up to this size products of 64 components are exact in doubles.
EXACT = 1 << 22
# Vectors a task of the sorted table should hold, and vectors of a block.
TASK_ROWS = 200_000
BLOCK_ROWS = 128


def hilbert_keys(cells: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Places on the Hilbert curve of cells (rows x dimensions, `bits` bits each), as
    rows of bytes that sort like them."""
    x = cells.astype(np.uint32).T.copy()
    dims, rows = x.shape
    q = np.uint32(1 << (bits - 1))
    while q > 1:  # undo the rotations of every level
        low = np.uint32(q - 1)
        for i in range(dims):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(turned, low, swap).astype(np.uint32)
            if i:
                x[i] ^= swap
        q >>= np.uint32(1)
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    last = np.zeros(rows, np.uint32)
    for level in range(bits - 1, 0, -1):
        last ^= np.where(x[-1] & np.uint32(1 << level), np.uint32((1 << level) - 1), np.uint32(0))
    x ^= last
    planes = [((x >> np.uint32(level)) & np.uint32(1)).T for level in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)


def box_candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Centroids that may be nearest to a vector of the box, ascending. The difference of
    the squared distances to two centroids is linear in the vector, so its greatest value
    in the box is that of a corner; a centroid goes when another one is nearer in all of
    the box. Box and centroids are rotated, so a part in a billion is left for rounding."""
    apart = centroids[:, None] - centroids[None]
    length = (centroids ** 2).sum(1)
    gap = np.maximum(-2 * low * apart, -2 * high * apart).sum(-1) + length[:, None] - length[None]
    slack = 1e-9 * (1 + length.max() + (np.maximum(np.abs(low), np.abs(high)) ** 2).sum())
    return np.flatnonzero(~(gap < -slack).any(0))


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and the exact squared distance."""
    if len(centroids) > 1:
        if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
            points, centres = vectors.astype(np.float64), centroids.astype(np.float64)
            at = ((centres ** 2).sum(1) - 2 * (points @ centres.T)).argmin(1)
        else:
            at = np.stack([((vectors - c) ** 2).sum(1) for c in centroids], 1).argmin(1)
    else:
        at = np.zeros(len(vectors), np.int64)
    return at, ((vectors - centroids[at]) ** 2).sum(1)


def kept_vectors(embeddings: DataFrame, dims: int) -> DataFrame:
    """`vec_id, vector` (array of long) of the rows with `dims` finite components."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    sound = (F.size("embedding") == dims) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x))
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, values).alias("values")).where("values is not null")
    whole = F.transform("values", lambda x: F.floor(x * 1024.0))
    small = F.forall("values", lambda x: F.abs(x) < LARGEST / 1024.0)
    refuse = F.raise_error(F.lit(f"a component reaches {LARGEST // 1024}: its distances do not fit a long"))
    return kept.select("vec_id", F.when(small, whole).otherwise(refuse.cast("array<bigint>")).alias("vector"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def principal_axes(kept: DataFrame, dims: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """How many vectors there are, their mean, the axes of their covariance (columns, the
    widest first) and the spread along each; tasks add up their batches first."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + dims + dims * dims)
        for rows in batches:
            vectors = _matrix(rows.column("vector"), dims).astype(np.float64)
            total += np.concatenate([[len(vectors)], vectors.sum(0), (vectors.T @ vectors).ravel()])
        if total[0]:
            yield batch(place=pa.array(np.arange(len(total))), total=pa.array(total))

    sums = kept.select("vector").mapInArrow(moments, "place long, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()
    total = np.zeros(1 + dims + dims * dims)
    for r in sums:
        total[r.place] = r.total
    n, mean = max(total[0], 1), total[1:dims + 1] / max(total[0], 1)
    spread, axes = np.linalg.eigh(total[dims + 1:].reshape(dims, dims) / n - np.outer(mean, mean))
    return int(total[0]), mean, axes[:, ::-1], np.sqrt(np.maximum(spread[::-1], 0))


def block_table(kept: DataFrame, dims: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, np.ndarray]:
    """Blocks of vectors along the curve, and the rotation of their boxes: `ids, vectors`
    (little-endian integers as bytes, row after row), `low, high` (the box of the rotated
    vectors). The curve runs through the widest principal axes, where clusters lie apart.
    Equal vectors are dealt out by a number of their row, so that a vector which is a
    third of the table is spread over many tasks."""
    rows, mean, axes, spread = principal_axes(kept, dims)
    seen_dims = min(CURVE_DIMS, dims)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), 0
        for part in batches:
            vectors = _matrix(part.column("vector"), dims)
            along = (vectors - mean) @ axes[:, :seen_dims] / np.maximum(4 * spread[:seen_dims], 1e-9)
            cells = np.clip((along + 1) * (1 << CURVE_BITS - 1), 0, (1 << CURVE_BITS) - 1)
            numbers = (np.int64(task) << 40) + seen + np.arange(len(vectors))
            seen += len(vectors)
            yield batch(
                key=pa.array([k.tobytes() for k in hilbert_keys(cells)], pa.binary()), spread=pa.array(mix(numbers).view(np.int64)),
                vec_id=part.column("vec_id"), vector=pa.array([v.tobytes() for v in vectors.astype("<i4")], pa.binary()),
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for many in batches:
            for start in range(0, many.num_rows, block_rows):
                part = many.slice(start, block_rows)
                vectors = np.frombuffer(b"".join(part.column("vector").to_pylist()), "<i4").reshape(-1, dims)
                turned = vectors @ axes
                yield batch(
                    ids=pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())), vectors=pa.array([vectors.tobytes()], pa.binary()),
                    low=pa.array([turned.min(0)], pa.list_(pa.float64())), high=pa.array([turned.max(0)], pa.list_(pa.float64())),
                )

    placed = materialize(kept.mapInArrow(place, "key binary, spread long, vec_id long, vector binary"), "curve")
    tasks = max(-(-rows // TASK_ROWS), kept.sparkSession.sparkContext.defaultParallelism)
    ordered = placed.repartitionByRange(tasks, "key", "spread").sortWithinPartitions("key", "spread")
    return materialize(ordered.mapInArrow(cut, "ids array<long>, vectors binary, low array<double>, high array<double>"), "blocks"), axes


def _blocks(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, axes: np.ndarray) -> Iterator[tuple]:
    """`ids, vectors, numbers, distances, compared centroids` of each block; centroids that
    its box rules out are not compared."""
    dims, turned = centroids.shape[1], centroids @ axes
    for rows in batches:
        lows, highs = (rows.column(n).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) for n in ("low", "high"))
        for i in range(rows.num_rows):
            vectors = np.frombuffer(rows.column("vectors")[i].as_py(), "<i4").reshape(-1, dims).astype(np.int64)
            chosen = box_candidates(lows[i], highs[i], turned)
            at, distances = nearest(vectors, centroids[chosen])
            yield rows.column("ids")[i].values, vectors, chosen[at], distances, len(chosen)


def _sums(blocks: DataFrame, centroids: np.ndarray, axes: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Rows and componentwise sums of every cluster; tasks add up their blocks first."""
    k, dims = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, vectors, numbers, _, _ in _blocks(batches, centroids, axes):
            counts += np.bincount(numbers, minlength=k)
            for c in np.unique(numbers):
                sums[c] += vectors[numbers == c].sum(0)
        table = np.concatenate([counts[:, None], sums], 1)
        used = np.flatnonzero(counts)
        yield batch(
            cluster=pa.array(np.repeat(used, dims + 1)), place=pa.array(np.tile(np.arange(dims + 1), len(used))), total=pa.array(table[used].ravel()),
        )

    narrow = blocks.select("ids", "vectors", "low", "high").mapInArrow(add, "cluster long, place long, total long")
    rows = narrow.groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect()  # clusters x dimensions
    found: dict[int, list[int]] = {}
    for r in rows:
        found.setdefault(r.cluster, [0] * (dims + 1))[r.place] = r.total
    return {c: (v[0], v[1:]) for c, v in found.items()}


def cluster_vectors(
    embeddings: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Lloyd's algorithm in whole numbers over vectors of exactly `dims` finite components,
    each taken as floor(1024 x).

    Starts are the `k` vectors of least sha256 of `<seed>:<vec_id>`, in that order; each of
    `rounds` rounds assigns all vectors (ties: the smaller centroid) and moves each
    non-empty centroid to floor(sum / count). Vectors lie in blocks along a Hilbert curve;
    a block's box bounds its distance to each centroid, and only centroids that can be
    nearest are compared. The result is that of comparing all.

    Returns a row per kept vector: `vec_id, cluster, distance` (squared), `cluster_inertia,
    inertia, centroid_sha256`. Vectors that are null, of another length, or with null, NaN
    or infinite components are left out; a repeated row counts as often as it occurs; rows
    of one id, or without one (hashed last), are started from in the order of their
    vectors. With fewer than `k` vectors there are as many centroids as vectors. A
    component of 65,536 or more raises an error, as its distances need not fit a long.
    Other columns than `vec_id` and `embedding` are not read. No rows give no rows.

    The driver holds k centroids and k x (dims + 1) sums a round, whatever the table.
    """
    kept = kept_vectors(embeddings, dims)
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = kept.withColumn("hash", first).orderBy(F.col("hash").asc_nulls_last(), "vector").limit(k).collect()
    schema = "vec_id long, cluster int, distance long"
    if not start:
        return kept.select("vec_id").selectExpr(
            "vec_id", "cast(null as int) as cluster", "cast(null as long) as distance", "cast(null as long) as cluster_inertia",
            "cast(null as long) as inertia", "cast(null as string) as centroid_sha256",
        )
    centroids = np.array([r.vector for r in start], np.int64)
    blocks, axes = block_table(kept, dims, block_rows)
    for _ in range(rounds):
        moved = centroids.copy()
        for c, (count, sums) in _sums(blocks, centroids, axes).items():
            moved[c] = [s // count for s in sums]
        if (moved == centroids).all():
            break  # every later round would repeat this one
        centroids = moved

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, numbers, distances, _ in _blocks(batches, centroids, axes):
            yield batch(vec_id=ids, cluster=pa.array(numbers.astype(np.int32)), distance=pa.array(distances))

    assigned = materialize(blocks.mapInArrow(assign, schema), "assigned")
    inertia = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    digests = {c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest() for c in inertia}
    per_cluster = pd.DataFrame({"cluster": list(inertia), "cluster_inertia": list(inertia.values()), "centroid_sha256": [digests[c] for c in inertia]})
    small = assigned.sparkSession.createDataFrame(per_cluster, "cluster int, cluster_inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(small), "cluster").select(  # at most k rows
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(inertia.values())).cast("long").alias("inertia"), "centroid_sha256",
    )


def compared_centroids(blocks: DataFrame, centroids: np.ndarray, axes: np.ndarray) -> DataFrame:
    """`rows, compared` per block: how many vectors it holds, and with how many centroids
    they are compared."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, _, _, chosen in _blocks(batches, centroids, axes):
            yield batch(rows=pa.array([len(ids)]), compared=pa.array([chosen]))

    return blocks.mapInArrow(count, "rows long, compared long")


def cluster_sql(k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> str:
    """The same in SQL that DuckDB runs: all distances, one step of the chain per round."""
    steps = [
        f"""kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = {dims}
            AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {dims})""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v AS m
            FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {k}))""",
    ]
    squared = "CAST(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d
            FROM (SELECT r.*, c, {squared} AS d FROM (SELECT row_number() OVER () AS r, vec_id, v FROM kept) r, c{i})
            GROUP BY r, vec_id, v)"""
        )
        if i < rounds:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.m, o.m) AS m FROM c{i} o LEFT JOIN (
                SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS m FROM (
                SELECT c, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
                FROM (SELECT c, unnest(v) AS x, unnest(range({dims})) AS p FROM a{i}) GROUP BY c, p) GROUP BY c) n ON n.c = o.c)"""
            )
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
        CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} k ON a.c = k.c"""
