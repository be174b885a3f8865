"""Exact Jaccard self-join on word shingles, as a metric-space join, and its components.

In Jaccard space nearly all documents are at distance 1 from one another, so pivots alone
cannot part a corpus. It is first cut by shared rare shingles: two sets of similarity t
share k shingles among the first n - ceil(t n) + k of a fixed order (rare words first). Sets that share one
form a region around the least of them. Inside a region pivots make Voronoi regions,
triangle-inequality windows replicate the boundary, and regions are joined recursively.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from dialogue_factors.llm.common import batch, bounded, chunks, keyed, utf8
from dialogue_factors.llm.components import components
from dialogue_factors.llm.shingles import shingle_sets, word_hashes
from dialogue_factors.session import materialize

# Similarity as a ratio of whole numbers, so that ties are exact.
NUMERATOR, DENOMINATOR = 75, 100
RADIUS = 1 - NUMERATOR / DENOMINATOR
TEXT_BYTES = 1 << 21
# Shingles of a bucket of prefixes, and of a region that one task joins.
BUCKET_TOKENS, REGION_SHINGLES = 2_000_000, 3_000_000
# A shingle in one of so many documents or more comes last in the order.
FREQUENT_SHARE = 500
# A word that is one in so many or more is frequent.
WORD_SHARE = 2000
# Prefixes are longer by one in so many of a set's shingles, and linked sets share as many.
SHARED_PART = 16
# Sizes of linked sets are in one class or in neighbouring ones.
SIZE_CLASS = 1.5
LEAF, PIVOTS, ROUNDS = 256, 16, 4

SETS = "kind int, doc_id long, key_id long, key_text long, n long, s1 long, s2 long"


def shared_least(n: int) -> int:
    """How many shingles two linked sets of `n` or more share in their prefixes."""
    return 1 + n // SHARED_PART


def prefix_size(n: int) -> int:
    """Linked sets have ceil(t n) shingles in common, so the rest and k more hold k of them."""
    return n - -(-NUMERATOR * n // DENOMINATOR) + shared_least(n)


def linked(common: np.ndarray, n: int, sizes: np.ndarray) -> np.ndarray:
    return DENOMINATOR * common >= NUMERATOR * (n + sizes - common)


def set_hash(shingles: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for rows in batches:
        data, offsets = utf8(rows.column(column))
        for low, high in chunks(offsets, TEXT_BYTES):
            yield rows.slice(low, high - low), data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]


def _sets(batches: Iterator[pa.RecordBatch], column: int, words: Broadcast) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part, data, offsets in _texts(batches, column):
        yield part, shingle_sets(data, offsets, words.value)


def frequent_words(rows: DataFrame) -> Broadcast:
    """Hashes of the words that are one in `WORD_SHARE` of all or more; so many at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in _texts(batches, 0):
            words, counts = np.unique(word_hashes(data, offsets)[0], return_counts=True)
            often = counts >= max(2, counts.sum() // WORD_SHARE)
            # word 0 stands for all words of the chunk
            yield batch(word=pa.array([0, *words[often].view(np.int64).tolist()], pa.int64()), n=pa.array([int(counts.sum()), *counts[often].tolist()], pa.int64()))

    counted = materialize(rows.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counted.where("word = 0").select("n").first()
    common = counted.where((F.col("word") != 0) & (F.col("n") * WORD_SHARE >= (total.n if total else 0))).select("word").toArrow()
    return rows.sparkSession.sparkContext.broadcast(np.sort(common["word"].to_numpy().astype(np.int64).view(np.uint64)))


def describe_sets(rows: DataFrame, words: Broadcast) -> DataFrame:
    """Kind 0: a row's number of shingles and 128-bit hash of its set. Kind 1: shingles
    (`s1`) that are frequent in a chunk of text, with their documents there (`n`)."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, 3, words):
            hashes = [set_hash(s) for s in sets]
            tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
            often = counts >= max(4, len(sets) // FREQUENT_SHARE)
            blank = pa.nulls(int(often.sum()), pa.int64())
            yield batch(
                kind=pa.array([0] * len(sets), pa.int32()), doc_id=part.column(0), key_id=part.column(1), key_text=part.column(2),
                n=pa.array([len(s) for s in sets], pa.int64()), s1=pa.array([h[0] for h in hashes], pa.int64()), s2=pa.array([h[1] for h in hashes], pa.int64()),
            )
            yield batch(
                kind=pa.array([1] * int(often.sum()), pa.int32()), doc_id=blank, key_id=blank, key_text=blank,
                n=pa.array(counts[often].astype(np.int64)), s1=pa.array(tokens[often].view(np.int64)), s2=blank,
            )

    chosen = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "key_id", "key_text", "text")
    return materialize(chosen.mapInArrow(describe, SETS), "sets")


def _frequent(described: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles in ascending order, and their rank from rare to frequent. The
    documents' mean number of shingles times `FREQUENT_SHARE` bounds how many there are."""
    counted = described.where("kind = 1").groupBy("s1").agg(F.sum("n").alias("n")).where(F.col("n") >= max(8, rows // FREQUENT_SHARE))
    table = counted.toArrow().to_pandas()
    tokens = table.s1.to_numpy(np.int64).view(np.uint64)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, table.n.to_numpy(np.int64)))] = np.arange(len(tokens))
    order = np.argsort(tokens)
    return tokens[order], rank[order]


def _prefix(shingles: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles in the order (rare by hash, then frequent by rank), and which of
    them are frequent."""
    size = prefix_size(len(shingles))
    if not len(frequent):
        return shingles[:size], np.zeros(size, bool)
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    often = frequent[at] == shingles
    rare = shingles[~often][:size]
    if len(rare) == size:
        return rare, np.zeros(size, bool)
    late = shingles[often][np.argsort(rank[at[often]])][:size - len(rare)]
    return np.concatenate([rare, late]), np.arange(size) >= len(rare)


PREFIXES = "kind int, bucket long, base long, tokens binary, refs binary, token long, ref long, s1 long, s2 long, n long"


def emit_prefixes(rows: DataFrame, frequent: np.ndarray, rank: np.ndarray, buckets: int, words: Broadcast) -> DataFrame:
    """Kind 0: packed rare prefix shingles of a bucket, each with the number of its set in
    the task. Kind 1: a frequent one. Kind 2: the set of a number (`ref`). A task passes
    on a set once, however many documents have it."""
    shared = rows.sparkSession.sparkContext.broadcast((frequent, rank))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = shared.value
        base = TaskContext.get().partitionId() << 32
        seen: set[tuple[int, int]] = set()
        held: list[tuple[np.ndarray, int]] = []

        def rows_of(rows: int, kind: int, **columns: pa.Array) -> pa.RecordBatch:
            types = {"kind": pa.int32(), "tokens": pa.binary(), "refs": pa.binary()}
            names = [c.split()[0] for c in PREFIXES.split(", ")]
            columns["kind"] = pa.array([kind] * rows, pa.int32())
            return batch(**{c: columns.get(c, pa.nulls(rows, types.get(c, pa.int64()))) for c in names})

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate([t for t, _ in held])
            refs = np.repeat(np.array([r for _, r in held], np.uint32), [len(t) for t, _ in held])
            bucket = ((tokens & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            present, first = np.unique(bucket[order], return_index=True)
            parts = list(zip(first, [*first[1:], len(order)]))
            return rows_of(
                len(present), 0, bucket=pa.array(present), base=pa.array([base] * len(present), pa.int64()),
                tokens=pa.array([tokens[order[a:b]].tobytes() for a, b in parts], pa.binary()),
                refs=pa.array([refs[order[a:b]].tobytes() for a, b in parts], pa.binary()),
            )

        for _, sets in _sets(batches, 0, words):
            refs, ones, twos, sizes, often = [], [], [], [], []
            for s in sets:
                key = set_hash(s)
                if not len(s) or key in seen:
                    continue
                ref = len(seen)
                seen.add(key)
                prefix, late = _prefix(s, frequent, rank)
                held.append((prefix[~late], ref))
                refs.append(base + ref)
                ones.append(key[0])
                twos.append(key[1])
                sizes.append(len(s))
                often += [(t, base + ref) for t in prefix[late].view(np.int64).tolist()]
            yield rows_of(len(refs), 2, ref=pa.array(refs, pa.int64()), s1=pa.array(ones, pa.int64()), s2=pa.array(twos, pa.int64()), n=pa.array(sizes, pa.int64()))
            if often:
                yield rows_of(len(often), 1, token=pa.array([t for t, _ in often], pa.int64()), ref=pa.array([r for _, r in often], pa.int64()))
            if sum(len(t) for t, _ in held) > BUCKET_TOKENS // 2:
                yield flush()
                held = []
        if held:
            yield flush()

    return materialize(rows.select("text").mapInArrow(emit, PREFIXES), "prefixes")


def _regions_of_bucket(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    tokens = np.concatenate([np.frombuffer(t, np.uint64) for t in rows.tokens])
    refs = np.concatenate([np.frombuffer(r, np.uint32).astype(np.int64) + b for r, b in zip(rows.refs, rows.base)])
    order = np.lexsort((refs, tokens))
    tokens, refs = tokens[order], refs[order]
    heads = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    sizes = np.diff(np.append(heads, len(tokens)))
    several = np.repeat(sizes > 1, sizes)
    pairs = np.stack([np.repeat(refs[heads], sizes)[several], refs[several]], axis=1)
    pairs, shared = np.unique(pairs, axis=0, return_counts=True)
    return pd.DataFrame({"pivot": pairs[:, 0], "ref": pairs[:, 1], "shared": shared})


def share_regions(prefixes: DataFrame) -> DataFrame:
    """`b1, b2, s1, s2, n`: the sets of each region, named by its least set, and their
    sizes. Any two sets that may be linked are in one region.

    Left out are sets that share fewer shingles of their prefix with all others together
    than they must with one, members of a region with no other of like size, and regions
    within other regions.
    """
    rare = prefixes.where("kind = 0").select("bucket", "base", "tokens", "refs").groupBy("bucket")
    rare = rare.applyInPandas(_regions_of_bucket, "pivot long, ref long, shared long")
    often = prefixes.where("kind = 1").select("token", "ref")
    least = often.groupBy("token").agg(F.min("ref").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    often = often.join(least, "token").select("pivot", "ref", F.lit(1).cast("long").alias("shared"))
    pairs = materialize(rare.unionByName(often).groupBy("pivot", "ref").agg(F.sum("shared").alias("shared")), "pairs")
    named = prefixes.where("kind = 2").select("ref", "s1", "s2", "n")
    partner = F.floor(F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) / SHARED_PART) + 1
    # Two linked sets share `partner` shingles or more. If each leaves the regions where it
    # shares least, below half as many in all, some region still holds both.
    own = Window.partitionBy("ref")
    upto = own.orderBy("shared", "pivot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = pairs.join(named, "ref").select(
        "pivot", "s1", "s2", "n", partner.alias("partner"), F.sum("shared").over(own).alias("total"), F.sum("shared").over(upto).alias("sofar")
    )
    strong = placed.where((F.col("total") >= F.col("partner")) & (F.col("sofar") * 2 > F.col("partner") - 1))
    pivots = named.select(F.col("ref").alias("pivot"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
    members = strong.join(pivots, "pivot").select("b1", "b2", "s1", "s2", "n").distinct()
    members = materialize(members.withColumn("class", F.floor(F.log("n") / F.log(F.lit(SIZE_CLASS)))), "members")
    near = members.groupBy("b1", "b2", "class").count().select("b1", "b2", "count", F.explode(F.array([F.col("class") + d for d in (-1, 0, 1)])).alias("class"))
    several = near.groupBy("b1", "b2", "class").agg(F.sum("count").alias("like")).where("like > 1").drop("like")
    return without_contained(materialize(members.join(several, ["b1", "b2", "class"]).drop("class"), "members"))


def without_contained(members: DataFrame) -> DataFrame:
    """Members without the regions all of whose sets are together in another region.

    A region that holds another one holds its least set too, so it is looked for among the
    regions of that set: the largest one (ties by name), unless it is the region itself.
    """
    sized = members.groupBy("b1", "b2").agg(F.count("*").alias("size"), F.min(F.struct("s1", "s2")).alias("anchor"))
    sized = materialize(sized, "regions")
    largest = members.join(sized.select("b1", "b2", "size"), ["b1", "b2"]).groupBy("s1", "s2").agg(F.max(F.struct("size", "b1", "b2")).alias("top"))
    inside = sized.select("b1", "b2", "size", F.col("anchor.s1").alias("s1"), F.col("anchor.s2").alias("s2")).join(largest, ["s1", "s2"])
    inside = inside.where("b1 <> top.b1 or b2 <> top.b2").select("b1", "b2", "size", F.col("top.b1").alias("t1"), F.col("top.b2").alias("t2"))
    inside = materialize(inside, "inside")
    others = members.select(F.col("b1").alias("t1"), F.col("b2").alias("t2"), "s1", "s2")
    held = members.select("b1", "b2", "s1", "s2").join(inside, ["b1", "b2"]).join(others, ["t1", "t2", "s1", "s2"])
    contained = held.groupBy("b1", "b2", "size").agg(F.count("*").alias("held")).where("held = size").select("b1", "b2")
    return materialize(members.join(bounded(materialize(contained, "contained"), 16), ["b1", "b2"], "left_anti"), "members")


# ---- joins inside a task ---------------------------------------------------------


class Region:
    """Sets of a region with postings of their shingles."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat, self.codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.ends = np.cumsum(self.sizes)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.posting = owner[np.argsort(self.codes, kind="stable")]
        self.posting_ends = np.cumsum(np.bincount(self.codes, minlength=len(flat)))
        self.parent = np.arange(len(sets))
        self.edges: list[tuple[int, int]] = []

    def common(self, i: int) -> np.ndarray:
        """Shingles that each set shares with set i."""
        codes = self.codes[self.ends[i] - self.sizes[i]:self.ends[i]]
        high = self.posting_ends[codes]
        low = np.where(codes > 0, self.posting_ends[codes - 1], 0)
        many = high - low
        at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return np.bincount(self.posting[at], minlength=len(self.sizes))

    def distances(self, i: int) -> np.ndarray:
        common = self.common(i)
        return 1 - common / (self.sizes + self.sizes[i] - common)

    def link(self, i: int, others: np.ndarray, common: np.ndarray) -> None:
        """Union set i with those of `others` that it is linked to."""
        others = others[linked(common[others], self.sizes[i], self.sizes[others])]
        for root in np.unique(self.parent[others]):
            own = self.parent[i]
            if root != own:
                self.edges.append((i, int(others[self.parent[others] == root][0])))
                self.parent[self.parent == root] = own

    def leaf(self, group: np.ndarray) -> None:
        """All links between components of the group. Every pair of sets in different
        components has one outside the largest, so only those are compared with all."""
        left = set(group.tolist())
        while left:
            roots, counts = np.unique(self.parent[group], return_counts=True)
            if len(roots) == 1:
                return
            main = roots[counts.argmax()]
            i = next((j for j in left if self.parent[j] != main), None)
            if i is None:
                return
            left.discard(i)
            self.link(i, group, self.common(i))

    def join(self, group: np.ndarray) -> None:
        """Recursive metric join of a group."""
        stack = [group]
        while stack:
            group = stack.pop()
            if len(np.unique(self.parent[group])) == 1:
                continue
            if len(group) <= LEAF:
                self.leaf(group)
                continue
            pivots = group[np.linspace(0, len(group) - 1, PIVOTS).astype(int)]
            away = np.empty((PIVOTS, len(group)))
            for k, p in enumerate(pivots):
                common = self.common(p)
                self.link(p, group, common)
                away[k] = 1 - (common / (self.sizes + self.sizes[p] - common))[group]
            home, near = away.argmin(axis=0), away.min(axis=0)
            home[near >= 1] = -1
            # Links leave a region only from its window; sets far from all pivots meet those
            # at least 1 - RADIUS from theirs.
            rooms = [group[(home < 0) | (near >= 1 - RADIUS - 1e-9)]] if (home < 0).any() else []
            for k in range(PIVOTS):
                own = home == k
                if own.any():
                    window = (home > k) & (away[k] - near <= 2 * RADIUS + 1e-9) & (away[k] <= near[own].max() + RADIUS + 1e-9)
                    rooms.append(group[own | window])
            if max(map(len, rooms)) > 0.9 * len(group) or sum(map(len, rooms)) > 4 * len(group):
                self.leaf(group)
            else:
                stack += rooms


EDGES = "u1 long, u2 long, v1 long, v2 long"


def _join_task(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Links of one region (`side` 0), or between its sides 1 (already connected) and 2."""
    rows = rows.drop_duplicates(["side", "s1", "s2"]).sort_values(["s1", "s2", "side"]).reset_index(drop=True)
    if len(rows) < 2:
        return pd.DataFrame([], columns=["u1", "u2", "v1", "v2"], dtype="int64")
    region = Region([np.frombuffer(s, np.uint64) for s in rows.shingles])
    side = rows.side.to_numpy()
    if side.any():
        first = np.flatnonzero(side == 1)
        region.parent[first] = first[0] if len(first) else 0  # a core is one component
        for i in np.flatnonzero(side == 2):
            region.link(i, first, region.common(i))
    else:
        region.join(np.arange(len(rows)))
    s1, s2 = rows.s1.to_numpy(), rows.s2.to_numpy()
    i, j = (np.array(x, np.int64) for x in (zip(*region.edges) if region.edges else ([], [])))
    return pd.DataFrame({"u1": s1[i], "u2": s2[i], "v1": s1[j], "v2": s2[j]})


SHIPPED = "b1 long, b2 long, s1 long, s2 long, shingles binary"


def ship_sets(rows: DataFrame, described: DataFrame, members: DataFrame, words: Broadcast) -> DataFrame:
    """Shingles of a set, for every region it is in; one document stands for a set."""
    stands = described.where("kind = 0").groupBy("s1", "s2").agg(F.min(F.struct("key_id", "key_text")).alias("k"))
    wanted = members.groupBy("s1", "s2").agg(F.collect_set(F.struct("b1", "b2")).alias("regions"))
    wanted = materialize(wanted.join(stands, ["s1", "s2"]).select("k.key_id", "k.key_text", "s1", "s2", "regions"), "wanted")

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, 0, words):
            out = [(r["b1"], r["b2"], s1, s2, s.tobytes()) for s, s1, s2, regions in zip(sets, *(part.column(i).to_pylist() for i in (1, 2, 3))) for r in regions]
            if out:
                b1, b2, s1, s2, shingles = zip(*out)
                ints = {n: pa.array(v, pa.int64()) for n, v in zip(("b1", "b2", "s1", "s2"), (b1, b2, s1, s2))}
                yield batch(**ints, shingles=pa.array(shingles, pa.binary()))

    joined = rows.select("key_id", "key_text", "text").join(bounded(wanted, 120), ["key_id", "key_text"])
    return joined.select("text", "s1", "s2", "regions").mapInArrow(ship, SHIPPED)


def _tile(rows: DataFrame, side: int, own: Column, other: Column) -> DataFrame:
    """Copies of a side for each piece of the other side."""
    piece = F.pmod(F.xxhash64("s1", "s2"), own)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), other - 1)).alias("copy")
    rows = rows.select("*", piece.alias("piece"), copies)
    a, b = ("piece", "copy") if side == 1 else ("copy", "piece")
    return rows.withColumn("sub", F.concat_ws("/", "sub", a, b)).withColumn("side", F.lit(side)).drop("piece", "copy")


def split_large(rows: DataFrame) -> tuple[DataFrame | None, list[DataFrame]]:
    """Tasks for regions over `REGION_SHINGLES`, and links found on the way.

    Pivots of a region: its sets of least hash. Sets linked to their nearest pivot are
    its core, one component. A link from a core leads to sets within twice the radius of
    the pivot, so the core meets that window, in tiles; the rest is a smaller region,
    taken up again. What does not shrink is joined in tiles of all its pairs.
    """
    tasks, links = None, []
    shape = ["b1", "b2", "sub", "side", "s1", "s2", "shingles"]
    rows = materialize(rows.withColumn("sub", F.lit("")).withColumn("side", F.lit(0)), "large")
    weight = (F.sum(F.length("shingles")) / 8).cast("long")
    add = lambda more: more.select(*shape) if tasks is None else tasks.unionByName(more.select(*shape))
    before = None
    for turn in range(ROUNDS + 1):
        sizes = rows.groupBy("b1", "b2").agg(weight.alias("w"))
        small = sizes.where(F.col("w") <= REGION_SHINGLES).drop("w")
        tasks = add(rows.join(small, ["b1", "b2"], "left_semi").withColumn("sub", F.lit(f"{turn}")))
        rows = materialize(rows.join(small, ["b1", "b2"], "left_anti"), "large")
        total = rows.agg(weight.alias("w")).first().w or 0
        if not total:
            return tasks, links
        if turn == ROUNDS or before is not None and total > 0.9 * before:
            pieces = sizes.select("b1", "b2", (F.col("w") / (REGION_SHINGLES // 2) + 1).cast("long").alias("m"))
            both = rows.join(pieces, ["b1", "b2"]).withColumn("piece", F.pmod(F.xxhash64("s1", "s2"), "m"))
            # A tile joins two pieces; a piece meets itself in each of its tiles.
            other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("other")
            both = both.select("*", other).where("m = 1 or piece <> other")
            name = F.concat_ws("/", F.lit("all"), F.least("piece", "other"), F.greatest("piece", "other"))
            return add(both.withColumn("sub", name)), links
        before = total
        pivots = _least_by_hash(rows.withColumn("h", F.xxhash64("s1", "s2", F.lit(turn))))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                near, away = [], []
                for s, ps in zip(part.column(4).to_pylist(), part.column(5).to_pylist()):
                    own = np.frombuffer(s, np.uint64)
                    ds = []
                    for p in ps:
                        other = np.frombuffer(p["shingles"], np.uint64)
                        common = len(np.intersect1d(own, other, assume_unique=True))
                        union = len(own) + len(other) - common
                        ds.append((1 - common / union, DENOMINATOR * common >= NUMERATOR * union))
                    k = min(range(len(ds)), key=lambda j: ds[j][0])
                    near.append(k if ds[k][1] else -1)
                    away.append([d for d, _ in ds])
                yield batch(
                    **{n: part.column(i) for i, n in enumerate(("b1", "b2", "s1", "s2", "shingles"))},
                    core=pa.array(near, pa.int32()), away=pa.array(away, pa.list_(pa.float64())),
                )

        measured = rows.join(bounded(pivots, PIVOTS * 4096), ["b1", "b2"]).select("b1", "b2", "s1", "s2", "shingles", "pivots")
        measured = materialize(measured.mapInArrow(measure, SHIPPED + ", core int, away array<double>"), "measured")
        heads = pivots.select("b1", "b2", F.posexplode("pivots").alias("core", "p")).select("b1", "b2", "core", F.col("p.s1").alias("v1"), F.col("p.s2").alias("v2"))
        links.append(measured.where("core >= 0").join(heads, ["b1", "b2", "core"]).select(F.col("s1").alias("u1"), F.col("s2").alias("u2"), "v1", "v2"))
        window = measured.select("*", F.posexplode("away").alias("k", "d")).where(
            (F.col("k") != F.col("core")) & (F.col("d") <= 2 * RADIUS + 1e-9)
        ).withColumn("sub", F.concat_ws("/", F.lit(f"{turn}"), "k"))
        reach = window.groupBy("b1", "b2", "k").agg(F.min("d").alias("closest"), weight.alias("ww"))
        core = measured.where("core >= 0").withColumn("k", F.col("core")).withColumn("d", F.expr("away[core]"))
        core = core.join(reach, ["b1", "b2", "k"]).where(F.col("d") >= F.col("closest") - RADIUS - 1e-9)
        cores = core.groupBy("b1", "b2", "k").agg(weight.alias("cw"))
        half = REGION_SHINGLES // 2
        pieces = cores.join(reach, ["b1", "b2", "k"]).select("b1", "b2", "k", (F.col("cw") / half + 1).cast("long").alias("cn"), (F.col("ww") / half + 1).cast("long").alias("wn"))
        core = core.withColumn("sub", F.concat_ws("/", F.lit(f"{turn}"), "k")).join(pieces, ["b1", "b2", "k"])
        window = window.join(pieces, ["b1", "b2", "k"])
        tasks = add(_tile(core, 1, F.col("cn"), F.col("wn")))
        tasks = add(_tile(window, 2, F.col("wn"), F.col("cn")))
        rows = measured.where("core < 0").select("b1", "b2", F.lit("").alias("sub"), F.lit(0).alias("side"), "s1", "s2", "shingles")
    return tasks, links


def _least_by_hash(rows: DataFrame) -> DataFrame:
    """`b1, b2, pivots`: the `PIVOTS` sets of least hash of each region. Every partition
    offers its own least first, so no region is gathered."""
    offered = rows.select("b1", "b2", "h", "s1", "s2")
    salted = offered.groupBy("b1", "b2", F.pmod("h", F.lit(4096)).alias("salt")).agg(F.min(F.struct("h", "s1", "s2")).alias("low"))
    low = salted.groupBy("b1", "b2").agg(F.slice(F.array_sort(F.collect_list("low")), 1, PIVOTS).alias("low")).select("b1", "b2", F.explode("low").alias("low"))
    named = low.select("b1", "b2", "low.s1", "low.s2")
    full = rows.join(bounded(materialize(named, "low"), 32), ["b1", "b2", "s1", "s2"]).dropDuplicates(["b1", "b2", "s1", "s2"])
    return materialize(full.groupBy("b1", "b2").agg(F.array_sort(F.collect_list(F.struct("s1", "s2", "shingles"))).alias("pivots")), "pivots")


def link_sets(rows: DataFrame, described: DataFrame, words: Broadcast) -> DataFrame:
    """`u, v`: links between different sets that join up all components."""
    sets = described.where("kind = 0")
    total = sets.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    frequent, rank = _frequent(described, total.rows)
    buckets = max(1, -(-(total.n or 0) // (4 * BUCKET_TOKENS)))
    members = share_regions(emit_prefixes(rows, frequent, rank, buckets, words))
    heavy = members.groupBy("b1", "b2").agg(F.sum("n").alias("w")).where(F.col("w") > REGION_SHINGLES)
    heavy = bounded(materialize(heavy.select("b1", "b2"), "heavy"), 16)
    if heavy.isEmpty():
        tasks, links = ship_sets(rows, described, members, words).select("b1", "b2", F.lit("").alias("sub"), F.lit(0).alias("side"), "s1", "s2", "shingles"), []
    else:
        shipped = materialize(ship_sets(rows, described, members, words), "shipped")
        light = shipped.join(heavy, ["b1", "b2"], "left_anti").withColumn("sub", F.lit("")).withColumn("side", F.lit(0))
        tasks, links = split_large(shipped.join(heavy, ["b1", "b2"], "left_semi"))
        tasks = light.unionByName(tasks)
    edges = tasks.groupBy("b1", "b2", "sub").applyInPandas(_join_task, EDGES)
    for more in links:
        edges = edges.unionByName(more)
    name = lambda a, b: F.concat(F.hex(a), F.lit(":"), F.hex(b))
    return edges.select(name("u1", "u2").alias("u"), name("v1", "v2").alias("v"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """`doc_id, key_id, key_text, n_shingles, component_id, root` of every row.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. A document's
    set is its distinct five-word shingles (64-bit hashes), or its whole sequence as one if
    it has fewer words. Two rows are linked if their sets' Jaccard similarity is 0.75 or
    more, which is tested on the whole sets; `component_id` is the least `doc_id` that links
    lead to. Rows without words (null, empty or blank text) are linked with nothing and are
    their own component. Rows of equal sets are one class, compared once. `root` names the
    component whatever its ids (null without words): rows of one id may lie in several, and
    a component of null ids only has a null `component_id`.
    """
    rows = keyed(docs)
    words = frequent_words(rows)
    described = describe_sets(rows, words)
    roots = materialize(components(link_sets(rows, described, words)), "roots")
    name = F.concat(F.hex("s1"), F.lit(":"), F.hex("s2"))
    sets = described.where("kind = 0").withColumn("node", F.when(F.col("n") > 0, name))
    # One row per distinct set first: copies, however many, meet nobody in the joins below.
    classes = sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("own"), F.count("*").alias("rows"))
    classes = materialize(classes.join(roots, "node", "left"), "classes")
    least = classes.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("own").alias("least"), F.sum("rows").alias("rows")).where("rows > 1")
    linked_to = classes.withColumn("root", F.coalesce("root", "node")).join(bounded(materialize(least.drop("rows"), "least"), 48), "root")
    linked_to = materialize(linked_to.select("node", "root", "least"), "linked")
    full = sets.where("n > 0").join(bounded(linked_to, 80), "node", "left").select(
        "doc_id", "key_id", "key_text", F.col("n").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), F.coalesce("root", "node").alias("root"),
    )
    return full.unionByName(sets.where("n = 0").select(
        "doc_id", "key_id", "key_text", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("string").alias("root"),
    ))
