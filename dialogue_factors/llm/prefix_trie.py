"""Prefix trie of conversations: double arrays per shard, shared upper nodes merged."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dialogue_factors.llm.common import batch, bounded
from dialogue_factors.session import materialize

# Turns of a path that one trie holds; longer conversations go on in a trie below.
SEGMENT = 128
# Distinct paths of a trie, and of a task.
SHARD_ROWS = 20_000
TASK_ROWS = 100_000
# Conversation ids joined into one string on their way to a digest.
CHUNK_IDS = 4096
DIGEST = 16
# Fixed values of the rebuilt conversations: they share the opening of every 20th one.
FAMILY, OPENINGS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
ROOT = hashlib.md5(b"").digest()
EMPTY = hashlib.sha256(b"").hexdigest()

PATHS = "conv long, seg int, prefix binary, digests binary, words binary, last boolean, end_key binary"
NODES = (
    "shared boolean, key binary, parent_key binary, depth long, words long, n long, conv long, parent_conv long, "
    "children long, leaves long, saved long, ancestors array<binary>"
)


class DoubleArray:
    """BASE and CHECK over dense ids: state `s` has a child by `code` where
    `check[base[s] + code] == s`; the child's state is that slot. State 0 is the start.

    `paths` has a row per path of codes (0 or more, -1 behind its end). All nodes of one
    depth are placed together: those with many children first, where their codes fit
    among the taken slots, and those with one child into any free slots.
    """

    FREE = -1

    def __init__(self, paths: np.ndarray):
        self.base, self.check = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.taken, self.first_free = 1, 1
        span, states = int(paths.max(initial=0)) + 1, np.zeros(len(paths), np.int64)
        for codes in paths.T:
            live = np.flatnonzero(codes >= 0)
            if not len(live):
                break
            pairs = np.unique(states[live] * span + codes[live])
            self._place(pairs // span, pairs % span)
            states[live] = self.base[states[live]] + codes[live]

    def _grow(self, size: int) -> None:
        more = max(size, 2 * len(self.base)) - len(self.base)
        if size > len(self.base):
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, self.FREE)])

    def _place(self, parents: np.ndarray, codes: np.ndarray) -> None:
        firsts = np.flatnonzero(np.diff(parents, prepend=-1))
        counts = np.diff(np.append(firsts, len(parents)))
        for g in np.argsort(-counts, kind="stable")[:int((counts > 1).sum())].tolist():
            self._fit(int(parents[firsts[g]]), codes[firsts[g]:firsts[g] + counts[g]])
        single = firsts[counts == 1]
        self._grow(self.taken + len(single))
        free = np.flatnonzero(self.check[self.first_free:self.taken] == self.FREE)[:len(single)] + self.first_free
        slots = np.concatenate([free, np.arange(self.taken, self.taken + len(single) - len(free))])
        self.base[parents[single]] = slots - codes[single]
        self.check[slots] = parents[single]
        self._settle(slots)

    def _fit(self, parent: int, codes: np.ndarray) -> None:
        window = self.check[self.first_free:self.first_free + 4096]
        for slot in (np.flatnonzero(window == self.FREE)[:32] + self.first_free).tolist() + [max(self.taken, self.first_free)]:
            slots = codes + (slot - codes[0])
            self._grow(int(slots[-1]) + 1)
            if (self.check[slots] == self.FREE).all():
                break
        self.base[parent] = slot - codes[0]
        self.check[slots] = parent
        self._settle(slots)

    def _settle(self, slots: np.ndarray) -> None:
        if len(slots):
            self.taken = max(self.taken, int(slots[-1]) + 1)
        while self.first_free < self.taken and self.check[self.first_free] != self.FREE:
            self.first_free += 1

    def walk(self, paths: np.ndarray) -> np.ndarray:
        """States along each path, -1 behind its end or where the trie has no such node."""
        found, states = np.full(paths.shape, -1), np.zeros(len(paths), np.int64)
        for d, codes in enumerate(paths.T):
            live = np.flatnonzero((codes >= 0) & (states >= 0))
            if not len(live):
                break
            slots = self.base[states[live]] + codes[live]
            inside = (slots > 0) & (slots < len(self.check))
            known = np.zeros(len(live), bool)
            known[inside] = self.check[slots[inside]] == states[live][inside]
            states[live] = np.where(known, slots, -1)
            found[live[known], d] = slots[known]
        return found


def below(key: bytes, digest: bytes) -> bytes:
    """Key of the node that a turn leads to."""
    return hashlib.md5(key + digest).digest()


def rebuilt_paths(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The rebuilt conversations as segments of turn digests, each with the key of the node
    it hangs below. A conversation whose length is a multiple of `segment` ends with an
    empty one. Turns are hashed and their words counted before the shuffle; the twenty
    conversations of one opening come to one task in turn, which holds a segment at a time.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    conv = F.col("conv_id").cast("long")
    turns = conversations.where("conv_id is not null").select(
        conv.alias("conv"), (conv - conv % FAMILY).alias("family"), "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).alias("words"),
    )
    ordered = turns.repartition("family").sortWithinPartitions(
        "family", F.col("conv") != F.col("family"), "conv", F.col("turn").asc_nulls_first(), "digest",
    ).select("conv", "family", "digest", "words")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PATHS.split(", ")]
        out: list[tuple] = []
        opening: list[tuple[bytes, int]] = []
        conv = family = None
        own = keep = seg = 0
        key = prefix = ROOT
        held: list[tuple[bytes, int]] = []

        def emit(last: bool) -> None:
            words = np.array([w for _, w in held], "<i4").tobytes()
            out.append((conv, seg, prefix, b"".join(d for d, _ in held), words, last, key))

        def push(turn: tuple[bytes, int]) -> None:
            nonlocal key, prefix, seg, held
            held.append(turn)
            key = below(key, turn[0])
            if len(held) == segment:
                emit(False)
                held, prefix, seg = [], key, seg + 1

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * len(names)
            types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.binary()]
            made = batch(**{n: pa.array(c, t) for n, c, t in zip(names, columns, types)})
            out.clear()
            return made

        for rows in batches:
            for c, f, digest, words in zip(*(rows.column(i).to_pylist() for i in range(4))):
                if c != conv:
                    if conv is not None:
                        emit(True)
                    if f != family:
                        family, opening = f, []
                    conv, own, seg, held, key, prefix = c, 0, 0, [], ROOT, ROOT
                    keep = 0 if c == f else zlib.crc32(str(c).encode()) % OPENINGS
                    for turn in opening[:keep]:
                        push(turn)
                if c == f and len(opening) < OPENINGS:
                    opening.append((digest, words))
                if own >= keep:
                    push((digest, words))
                own += 1
            yield flushed()
        if conv is not None:
            emit(True)
        yield flushed()

    return materialize(ordered.mapInArrow(rebuild, PATHS), "paths")


def ends_digests(paths: DataFrame) -> DataFrame:
    """`key, ends_sha256`: digest of the ids of the conversations that end at a node, in
    ascending order. Ids are joined into strings by a range sort that parts the ends of
    one node, and one task streams the strings of a node: a digest has to be made in turn,
    but it is the only thing held."""
    ends = paths.where("last").select(F.col("end_key").alias("key"), "conv")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        for rows in batches:
            done: list[tuple] = []
            for k, c in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                if k != key or len(ids) == CHUNK_IDS:
                    if ids:
                        done.append((key, ids[0], ",".join(map(str, ids))))
                    key, ids = k, []
                ids.append(c)
            yield _columns(done, "key", "first", "ids")
        yield _columns([(key, ids[0], ",".join(map(str, ids)))] if ids else [], "key", "first", "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for rows in batches:
            done = []
            for k, ids in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                if k != key:
                    if state is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _columns(done, "key", "ends_sha256")
        yield _columns([(key, state.hexdigest())] if state is not None else [], "key", "ends_sha256")

    joined = ends.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(join, "key binary, first long, ids string")
    sorted_ = joined.repartition("key").sortWithinPartitions("key", "first").select("key", "ids")
    return sorted_.mapInArrow(digest, "key binary, ends_sha256 string")


def _columns(rows: list[tuple], *names: str) -> pa.RecordBatch:
    types = {"key": pa.binary(), "first": pa.int64(), "ids": pa.string(), "ends_sha256": pa.string()}
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return batch(**{n: pa.array(c, types[n]) for n, c in zip(names, columns)})


def shard_nodes(rows: dict[str, list], level: int, segment: int) -> dict[str, list]:
    """Nodes of one shard, given its distinct paths in sorted order.

    Nodes on the first or last path may lie in neighbouring shards too: they are `shared`,
    and only carry what their unshared descendants add. All others are complete.
    """
    count = len(rows["prefix"])
    lengths = np.array([len(d) // DIGEST for d in rows["digests"]])
    dense: dict[bytes, int] = {}
    codes = np.full((count, 1 + int(lengths.max())), -1, np.int64)
    words = np.zeros(codes.shape, np.int64)
    for i, (prefix, digests) in enumerate(zip(rows["prefix"], rows["digests"])):
        codes[i, 0] = dense.setdefault(prefix, len(dense))
        for d in range(lengths[i]):
            codes[i, d + 1] = dense.setdefault(digests[d * DIGEST:(d + 1) * DIGEST], len(dense))
        words[i, 1:lengths[i] + 1] = np.frombuffer(rows["words"][i], "<i4")
    trie = DoubleArray(codes)
    states = trie.walk(codes)
    size = len(trie.check)
    n, depth, own_words = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.zeros(size, np.int64)
    conv = np.full(size, np.iinfo(np.int64).max)
    row_n, row_conv = np.array(rows["n"], np.int64), np.array(rows["conv"], np.int64)
    for d in range(codes.shape[1]):
        live = np.flatnonzero(states[:, d] >= 0)
        at = states[live, d]
        np.add.at(n, at, row_n[live])
        np.minimum.at(conv, at, row_conv[live])
        depth[at], own_words[at] = d, words[live, d]
    children, leaves, saved, seen = (np.zeros(size, np.int64) for _ in range(4))
    ends = states[np.arange(count), lengths]
    for column, target in (("hang_children", children), ("hang_leaves", leaves), ("hang_saved", saved)):
        target[ends] = [v or 0 for v in rows[column]]
    keys: dict[int, bytes] = {s: k for s, k, m, e in zip(ends.tolist(), rows["end_key"], lengths.tolist(), rows["ended"]) if e or m == segment}
    shared = depth == 0
    lines: dict[int, list[bytes]] = {}
    for i in (0, count - 1):
        key, line = rows["prefix"][i], []
        for d in range(lengths[i] + 1):
            if d:
                key = below(key, rows["digests"][i][(d - 1) * DIGEST:d * DIGEST])
            line = line + [key]
            state = int(states[i, d])
            keys[state], lines[state], shared[state] = key, line, True
    for i in np.flatnonzero(np.diff(codes[:, 0], prepend=-1)):
        keys[int(states[i, 0])] = rows["prefix"][i]
        lines[int(states[i, 0])] = [rows["prefix"][i]]
    nodes = np.flatnonzero(depth >= 0)
    nodes = nodes[np.argsort(depth[nodes], kind="stable")]
    cuts = np.searchsorted(depth[nodes], np.arange(codes.shape[1] + 1))
    for d in reversed(range(1, codes.shape[1])):
        own = nodes[cuts[d]:cuts[d + 1]]
        own = own[~shared[own]]
        above = trie.check[own]
        leaves[own] += leaves[own] == 0  # neither children nor a path that goes on below
        saved[own] += (n[own] - 1) * own_words[own]
        np.add.at(children, above, 1)
        np.add.at(leaves, above, leaves[own])
        np.add.at(saved, above, saved[own])
    above = trie.check[nodes]
    top = depth[nodes] == 0
    of_shared = shared[above] & ~top
    return {
        "shared": shared[nodes].tolist(), "key": [keys.get(s) for s in nodes.tolist()],
        "parent_key": [keys[s] if is_shared else None for s, is_shared in zip(above.tolist(), of_shared.tolist())],
        "depth": (level * segment + depth[nodes]).tolist(), "words": own_words[nodes].tolist(), "n": n[nodes].tolist(),
        "conv": conv[nodes].tolist(), "parent_conv": [None if s or t else c for c, s, t in zip(conv[above].tolist(), of_shared.tolist(), top.tolist())],
        "children": children[nodes].tolist(), "leaves": leaves[nodes].tolist(), "saved": saved[nodes].tolist(),
        "ancestors": [lines.get(s) if is_shared else None for s, is_shared in zip(nodes.tolist(), shared[nodes].tolist())],
    }


def _tries(rows: DataFrame, level: int, segment: int, shard_rows: int) -> DataFrame:
    names = rows.columns
    types = [pa.bool_(), pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.list_(pa.binary())]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in names}
        size = 0

        def shard() -> pa.RecordBatch:
            nodes = shard_nodes(held, level, segment)
            for c in names:
                held[c] = []
            return batch(**{name: pa.array(v, t) for (name, v), t in zip(nodes.items(), types)})

        for part in batches:
            columns = {c: part.column(c).to_pylist() for c in names}
            for start in range(0, part.num_rows, 1000):
                for c in names:
                    held[c] += columns[c][start:start + 1000]
                size += sum(map(len, columns["digests"][start:start + 1000]))
                if len(held["conv"]) >= shard_rows or size >= 64 * DIGEST * shard_rows:
                    yield shard()
                    size = 0
        if held["conv"]:
            yield shard()

    return rows.mapInArrow(build, NODES)


def _merged(shared: DataFrame) -> DataFrame:
    """Shared nodes with the sums over all shards and their shared descendants."""
    parts = shared.groupBy("key", "parent_key", "depth", "words").agg(
        F.sum("n").alias("n"), F.min("conv").alias("conv"), F.sum("children").alias("own_children"),
        F.sum("leaves").alias("own_leaves"), F.sum("saved").alias("own_saved"),
    )
    parts = materialize(parts, "shared")
    under = parts.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("below"))
    known = parts.join(under, "key", "left").withColumn("children", F.col("own_children") + F.coalesce("below", F.lit(0)))
    known = known.withColumn("own_leaves", F.col("own_leaves") + ((F.col("children") == 0) & (F.col("own_leaves") == 0)).cast("long"))
    known = materialize(known.withColumn("own_saved", F.col("own_saved") + (F.col("n") - 1) * F.col("words")), "shared")
    lines = shared.select("key", F.explode("ancestors").alias("ancestor")).distinct()
    sums = lines.join(known.select("key", "own_leaves", "own_saved"), "key").groupBy(F.col("ancestor").alias("key")).agg(
        F.sum("own_leaves").alias("leaves"), F.sum("own_saved").alias("saved"),
    )
    return materialize(known.select("key", "parent_key", "depth", "n", "conv", "children").join(sums, "key"), "shared")


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Trie of the rebuilt conversations, a row per node.

    Turns are ordered by `turn` (null first; equal ones by the digest of role and text).
    Conversation c is rebuilt from the first h turns of conversation c - c % 20 and its own
    turns after its first h, h being crc32(c) % 4. Distinct paths are counted first, so
    copies are one row however many there are. They are sorted and cut into shards; each
    shard packs a double array over dense ids of its turns and walks it for its nodes.
    Nodes that neighbouring shards may share, those on a shard's first and last path, are
    merged over all shards. Paths longer than `segment` turns hang, segment by segment,
    below the nodes where they go on, the deepest first, with a Spark job for each level.

    Returns `conv_id` (smallest member), `depth, parent_conv_id` (null at the root),
    `n_convs, n_children, n_leaves, saved_tokens, ends_sha256`. Null roles and texts are
    empty; rows without `conv_id` belong to no conversation and are left out; repeated
    rows are turns as often as they occur. Other columns than `conv_id, turn, role, text`
    are not read. No rows give no rows. One conversation's turns pass through one task, a
    segment of them in memory; so do the ids of conversations that end at one node.
    """
    paths = rebuilt_paths(conversations, segment)
    levels = paths.agg(F.max("seg")).first()[0]
    out, hang = [], None
    for level in reversed(range((levels if levels is not None else -1) + 1)):
        rows = paths.where(F.col("seg") == level).groupBy("prefix", "digests", "words", "end_key").agg(
            F.count("*").alias("n"), F.sum(F.col("last").cast("long")).alias("ended"), F.min("conv").alias("conv"),
        )
        if hang is None:
            rows = rows.selectExpr("*", "cast(null as long) hang_children", "cast(null as long) hang_leaves", "cast(null as long) hang_saved")
        else:
            rows = rows.join(hang, "end_key", "left")
        rows = materialize(rows, "rows")
        tasks = max(-(-rows.count() // TASK_ROWS), rows.sparkSession.sparkContext.defaultParallelism)
        ordered = rows.repartitionByRange(tasks, "prefix", "digests").sortWithinPartitions("prefix", "digests")
        nodes = materialize(_tries(ordered, level, segment, shard_rows), "nodes")
        shared = _merged(nodes.where("shared"))
        parents = bounded(shared.select(F.col("key").alias("up"), F.col("conv").alias("up_conv")), 80)
        private = nodes.where("not shared")
        columns = ["key", "conv", "depth", "n", "children", "leaves", "saved"]
        out.append(private.where("parent_key is null").select(*columns, F.col("parent_conv").alias("parent")))
        out.append(private.where("parent_key is not null").join(parents, F.col("parent_key") == F.col("up")).select(*columns, F.col("up_conv").alias("parent")))
        upper = shared if not level else shared.where(F.col("depth") > level * segment)
        out.append(upper.join(parents, F.col("parent_key") == F.col("up"), "left").select(*columns, F.col("up_conv").alias("parent")))
        hang = shared.where(F.col("depth") == level * segment).selectExpr(
            "key as end_key", "children as hang_children", "leaves as hang_leaves", "saved as hang_saved",
        )
    if not out:
        return conversations.sparkSession.createDataFrame(
            [], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string",
        )
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    # Nodes without a key are no conversation's end; they stay out of the join.
    ended = found.where("key is not null").join(ends_digests(paths), "key", "left")
    return ended.unionByName(found.where("key is null").withColumn("ends_sha256", F.lit(None).cast("string"))).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def trie_sql() -> str:
    """The same in SQL that DuckDB runs: paths as lists, a row per conversation and depth."""
    crc = """xor(4294967295, list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
        lambda a, b: list_reduce(range(8), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)), xor(a, b)), CAST(4294967295 AS BIGINT)))"""
    digest = "md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))"
    return rf"""WITH own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {digest}) AS p,
            {digest} AS t, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS w FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (SELECT c, c - c % {FAMILY} AS b, {crc} % {OPENINGS} AS h FROM (SELECT DISTINCT c FROM own)),
        rebuilt AS (SELECT v.c, 0 AS part, p, t, w FROM convs v JOIN own o ON o.c = v.b AND o.p <= v.h
            UNION ALL SELECT v.c, 1, p, t, w FROM convs v JOIN own o ON o.c = v.c AND o.p > v.h),
        paths AS (SELECT c, coalesce(path, []) AS path, ws FROM convs LEFT JOIN (
            SELECT c, list(t ORDER BY part, p) AS path, list(w ORDER BY part, p) AS ws FROM rebuilt GROUP BY c) USING (c)),
        members AS (SELECT c, d, path[1:d] AS node, len(path) = d AS ends, coalesce(ws[d], 0) AS w
            FROM (SELECT c, path, ws, unnest(range(len(path) + 1)) AS d FROM paths)),
        nodes AS (SELECT d, CASE WHEN d = 0 THEN [] ELSE node END AS node, min(c) AS conv_id, count(*) AS n, max(CASE WHEN d = 0 THEN 0 ELSE w END) AS w,
            sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY ALL),
        kids AS (SELECT d - 1 AS d, CASE WHEN d = 1 THEN [] ELSE node[1:d - 1] END AS node, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
        whole AS (SELECT n.*, coalesce(k, 0) AS k FROM nodes n LEFT JOIN kids USING (d, node)),
        sums AS (SELECT d, CASE WHEN d = 0 THEN [] ELSE node[1:d] END AS node, sum(CAST(k = 0 AS BIGINT)) AS leaves, sum((n - 1) * w) AS saved
            FROM (SELECT node, k, n, w, unnest(range(d + 1)) AS d FROM whole) GROUP BY ALL)
        SELECT a.conv_id, a.d AS depth, u.conv_id AS parent_conv_id, a.n AS n_convs, a.k AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
            CAST(saved AS BIGINT) AS saved_tokens, a.ends_sha256
        FROM whole a JOIN sums USING (d, node)
        LEFT JOIN nodes u ON u.d = a.d - 1 AND u.node = CASE WHEN a.d = 1 THEN [] ELSE a.node[1:a.d - 1] END"""
