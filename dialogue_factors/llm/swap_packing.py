"""Packing into few sequences by swaps between underfull bins."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from dialogue_factors.llm.common import batch, chunks, utf8
from dialogue_factors.llm.tokens import CHUNK_BYTES, SpacedEncoder
from dialogue_factors.session import materialize

# Pieces packed together by one task at a time.
GROUP_PIECES = 20_000
# Bins with at least this share of a sequence free are packed again with those of other groups.
OPEN_SHARE = 1 / 64
LEVELS = 4
# The search of pairs looks at this many of the roomiest bins, and at this many documents of each.
NEAR_BINS, NEAR_PIECES = 64, 24
# Bins in turn that no exchange can empty before the search of a group ends.
FAILURES = 256
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, key long"


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Piece numbers of each bin: the largest piece first, into the fullest bin it fits."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        by_room[room - size].append(b)
        rooms |= 1 << (room - size)
    return bins


class Search:
    """Bins and the exchanges that raise the sum of their squared fills."""

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], capacity: int):
        self.sizes, self.capacity = sizes.astype(np.int64), capacity
        self.bins = [list(b) for b in bins]
        self.fill = np.array([int(self.sizes[b].sum()) for b in self.bins], np.int64)
        self.of = np.zeros(len(sizes), np.int64)
        for b, members in enumerate(self.bins):
            self.of[members] = b

    def _put(self, pieces: list[int], target: int) -> None:
        for i in pieces:
            source = self.of[i]
            self.bins[source].remove(i)
            self.bins[target].append(i)
            self.fill[source] -= self.sizes[i]
            self.fill[target] += self.sizes[i]
            self.of[i] = target

    def _move(self, a: int) -> tuple | None:
        """A document of bin `a` into the bin that it fills most."""
        open_bins = self.open_bins(a)
        room = self.capacity - self.fill[open_bins]
        best = None
        for x in set_of(self.bins[a], self.sizes):
            size = self.sizes[x]
            gain = np.where(room >= size, 2 * size * (self.fill[open_bins] - self.fill[a] + size), 0)
            if len(gain) and gain.max() > (best[0] if best else 0):
                best = (gain.max(), [x], [], open_bins[gain.argmax()])
        return best

    def _one_for_one(self, a: int) -> tuple | None:
        """A document of `a` for a smaller one of another bin."""
        full = self.fill[self.of]
        others = np.flatnonzero((full < self.capacity) & (self.of != a))
        if not len(others):
            return None
        fill, small, best = full[others], self.sizes[others], None
        for x in set_of(self.bins[a], self.sizes):
            more = self.sizes[x] - small
            gain = np.where((more > 0) & (more <= self.capacity - fill), 2 * more * (fill - self.fill[a] + more), 0)
            if gain.max() > (best[0] if best else 0):
                y = others[gain.argmax()]
                best = (gain.max(), [x], [y], self.of[y])
        return best

    def _two_for_one(self, a: int) -> tuple | None:
        """Two documents of `a` for one of another bin, or one for two."""
        near = self.open_bins(a)
        near = near[np.argsort(self.fill[near], kind="stable")[:NEAR_BINS]]
        mine = set_of(self.bins[a], self.sizes)[:NEAR_PIECES]
        members = [(b, set_of(self.bins[b], self.sizes)[:NEAR_PIECES]) for b in near]
        ones = lambda pieces: [[i] for i in pieces]
        twos = lambda pieces: [[i, j] for n, i in enumerate(pieces) for j in pieces[n + 1:]]
        best = None
        for give, take in ((twos, ones), (ones, twos)):
            given = give(mine)
            taken = [(b, t) for b, pieces in members for t in take(pieces)]
            if not given or not taken:
                continue
            out = np.array([self.sizes[g].sum() for g in given])
            back = np.array([self.sizes[t].sum() for _, t in taken])
            fill = self.fill[np.array([b for b, _ in taken])]
            more = out[:, None] - back
            gain = np.where((more > 0) & (more <= self.capacity - fill), 2 * more * (fill - self.fill[a] + more), 0)
            if gain.max() > (best[0] if best else 0):
                g, t = np.unravel_index(gain.argmax(), gain.shape)
                best = (gain.max(), given[g], taken[t][1], taken[t][0])
        return best

    def open_bins(self, a: int) -> np.ndarray:
        found = np.flatnonzero((self.fill < self.capacity) & (self.fill > 0))
        return found[found != a]

    def run(self) -> list[list[int]]:
        """Empty the least filled bin by exchanges, then the next; a bin without one rests.
        Ends when the bins are as few as the tokens allow, when all rest, or when many in
        turn had to rest: fuller bins are harder to empty. Each exchange raises the sum of
        the squared fills, so the search ends."""
        fewest = -(-int(self.sizes.sum()) // self.capacity)
        resting, failed = np.zeros(len(self.bins), bool), 0
        alike: dict[tuple, list[int]] = {}
        for b, members in enumerate(self.bins):
            alike.setdefault(tuple(self.sizes[members].tolist()), []).append(b)
        while int((self.fill > 0).sum()) > fewest and failed < FAILURES:
            waiting = np.flatnonzero((self.fill < self.capacity) & (self.fill > 0) & ~resting)
            if not len(waiting):
                break
            a = int(waiting[self.fill[waiting].argmin()])
            change = self._move(a) or self._one_for_one(a) or self._two_for_one(a)
            if change is None:  # nor is there one for bins of the same sizes
                failed += 1
                resting[a] = True
                resting[alike.get(tuple(self.sizes[self.bins[a]].tolist()), [])] = True
                continue
            _, given, taken, target = change
            self._put(taken, a)
            self._put(given, target)
            if not self.fill[a]:
                failed = 0
        return [b for b in self.bins if b]


def set_of(pieces: list[int], sizes: np.ndarray) -> list[int]:
    """One piece of each size, the largest first."""
    return [i for _, i in sorted({int(sizes[i]): i for i in pieces}.items(), reverse=True)]


def pack(sizes: np.ndarray, capacity: int, given: list[list[int]] | None = None) -> list[list[int]]:
    """Bins of piece numbers, at most `capacity` each; never more bins than `given`."""
    found = Search(sizes, best_fit(sizes, capacity), capacity).run()
    return given if given is not None and len(given) <= len(found) else found


def pack_by_swaps(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pack documents into few sequences of at most `capacity` tokens.

    A document is its ids and `end_id`. Only longer ones than a sequence are cut, from
    behind into full pieces; the first piece holds the rest. Pieces of `capacity` are
    sequences by themselves. Others are dealt by hash into groups of some `GROUP_PIECES`,
    packed best fit first, and improved by moves and exchanges of one for one, two for one
    and one for two documents between underfull bins, each of which raises the sum of the
    squared fills, until bins empty. Bins that keep room are packed again with those of
    other groups, in up to `LEVELS` rounds. Limits of the search bound its time, not what
    is packed: every piece is in exactly one sequence.

    Returns a row per piece: `doc_id, piece, start, length, ids_crc32, sequence_id, offset`,
    and `ids` (array) with `keep_ids`. `sequence_id` is the number of one of the pieces,
    unique but with gaps. Null or empty texts are `end_id` alone; null ids stay null; a
    repeated row is packed as often as it occurs. Other columns than `doc_id` and `text`
    are not read. No rows give no rows.
    """
    path = tokenizer or byte_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = SpacedEncoder(path), TaskContext.get().partitionId() << 36
        for rows in batches:
            _, sizes = utf8(rows.column(1))
            for low, high in chunks(sizes, CHUNK_BYTES):
                part = rows.slice(low, high - low)
                flat, offsets = encoder.encode(part.column(1))
                total = np.diff(offsets) + 1
                pieces = -(-total // capacity)
                of = np.repeat(np.arange(len(total)), pieces)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                short = (total - (pieces - 1) * capacity)[of]
                start = np.where(piece == 0, 0, short + (piece - 1) * capacity)
                length = np.where(piece == 0, short, capacity)
                ids = np.insert(flat.astype("<u4"), offsets[1:], np.uint32(end_id))
                begins = (offsets[:-1] + np.arange(len(total)))[of] + start
                slices = [ids[b:b + n] for b, n in zip(begins.tolist(), length.tolist())]
                columns = {
                    "doc_id": part.column(0).take(pa.array(of)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start),
                    "length": pa.array(length), "ids_crc32": pa.array([zlib.crc32(s) for s in slices], pa.int64()),
                    "key": pa.array(number + np.arange(len(of))),
                }
                if keep_ids:
                    columns["ids"] = pa.array([s.astype(np.int64) for s in slices], pa.list_(pa.int64()))
                number += len(of)
                yield batch(**columns)

    schema = PIECES + (", ids array<long>" if keep_ids else "")
    pieces = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema), "pieces")
    plain = pieces.select([c.split()[0] for c in PIECES.split(", ")])
    placed = plain.where(F.col("length") == capacity).select("*", F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    waiting = plain.where(F.col("length") < capacity).withColumn("sequence_id", F.lit(None).cast("long"))
    out = PIECES + ", sequence_id long, offset long, room long"

    def groups_of(rows: DataFrame, groups: int, level: int) -> DataFrame:
        # At the first level each piece goes where its key says, later all of a bin together.
        dealt = rows.withColumn("group", F.pmod(F.xxhash64(F.coalesce("sequence_id", "key"), F.lit(level)), F.lit(groups)))

        def group(rows: pd.DataFrame) -> pd.DataFrame:
            sizes = rows["length"].to_numpy(np.int64)
            given = None if rows["sequence_id"].isna().any() else list(rows.reset_index(drop=True).groupby("sequence_id").indices.values())
            bins = pack(sizes, capacity, [b.tolist() for b in given] if given is not None else None)
            order = np.concatenate([np.array(b, np.int64) for b in bins])
            counts = np.array([len(b) for b in bins])
            firsts = np.cumsum(counts) - counts
            inside = np.cumsum(sizes[order]) - sizes[order]
            fills = np.add.reduceat(sizes[order], firsts)
            rows = rows.iloc[order].copy()
            rows["offset"] = inside - np.repeat(inside[firsts], counts)
            rows["room"] = np.repeat(capacity - fills, counts)
            rows["sequence_id"] = np.repeat(np.minimum.reduceat(rows["key"].to_numpy(np.int64), firsts), counts)
            return rows[[c.split()[0] for c in out.split(", ")]]

        return dealt.groupBy("group").applyInPandas(group, out)

    for level in range(LEVELS):
        count = waiting.count()
        if not count:
            break
        groups = -(-count // GROUP_PIECES)
        done = materialize(groups_of(waiting, groups, level), "bins")
        last = groups == 1 or level == LEVELS - 1
        closed = done if last else done.where(F.col("room") < OPEN_SHARE * capacity)
        placed = placed.unionByName(closed.drop("room"))
        if last:
            break
        waiting = done.where(F.col("room") >= OPEN_SHARE * capacity).drop("room", "offset")
    if keep_ids:
        placed = placed.join(pieces.select("key", "ids"), "key")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else []))
