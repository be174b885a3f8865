"""Exact substring deduplication over a distributed, sparse suffix array.

Suffixes are range-partitioned by their leading bytes with sampled splitters, sorted in
their bucket by multikey quicksort and compared with their neighbours, also across
buckets. Only suffixes that can matter are made: every string of `LENGTH` bytes has an
anchor (its least hashed `GRAM` bytes), equal strings have equal anchors, and the
strings of one anchor are a run, so a run is one suffix of the first round. Runs that
occur again as a whole are settled there. Runs that share an anchor's bytes with a
different run go on to the next round, cut into shorter runs, and at last into strings.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from dialogue_factors.llm.common import batch, chunks, keyed, mix, utf8
from dialogue_factors.session import materialize, scratch_path

LENGTH, GRAM = 200, 32
# Starts of a run in the rounds after the first.
GRAINS = (16, 1)
# Bytes of one document looked at together; longer ones go in overlapping pieces.
PIECE = 8 << 20
CHUNK = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


# ---- suffixes --------------------------------------------------------------------


def rolling_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each place, in time that does not grow
    with `size` (doubling, as h(a b) = h(a) * base**|b| + h(b))."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    table = mix(np.arange(1, 257, dtype=np.uint64))
    power, block, width = _BASE, table[data], 1
    out, done = None, 0
    rest = size
    while rest:
        if rest & 1:
            out = block[:len(block)].copy() if out is None else _joined(out, done, block, power)
            done += width
        rest >>= 1
        if rest:
            block = _joined(block, width, block, power)
            with np.errstate(over="ignore"):
                power = power * power
            width *= 2
    return mix(out[:len(data) - size + 1])


def _joined(left: np.ndarray, width: int, right: np.ndarray, power: np.uint64) -> np.ndarray:
    n = min(len(left), len(right) - width)
    return left[:n] * power + right[width:width + n]


def anchored_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts whose strings share an anchor: first start, starts, anchor, and the
    anchor's hash. Starts whose string would leave its text are no starts."""
    empty = np.zeros(0, np.int64)
    hashes = rolling_hashes(data, GRAM)
    width, n = LENGTH - GRAM + 1, len(data) - LENGTH + 1
    if n <= 0:
        return empty, empty, empty, np.zeros(0, np.uint64)
    keyed_by = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    rows = -(-len(keyed_by) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max)
    padded[:len(keyed_by)] = keyed_by
    padded = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    anchor = (np.minimum(back[:n], ahead[width - 1:width - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(n), "right") - 1
    valid = np.flatnonzero(np.arange(n) + LENGTH <= offsets[text + 1])
    if not len(valid):
        return empty, empty, empty, np.zeros(0, np.uint64)
    new = np.concatenate([[True], (np.diff(valid) > 1) | (np.diff(anchor[valid]) != 0) | (np.diff(text[valid]) != 0)])
    first = valid[new]
    starts = np.diff(np.append(np.flatnonzero(new), len(valid)))
    return first, starts, anchor[first], hashes[anchor[first]]


def _pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """Chunks of rows with their bytes and offsets; a long document in overlapping pieces,
    with the place where a piece begins."""
    for rows in batches:
        data, offsets = utf8(rows.column(column))
        for low, high in chunks(offsets, CHUNK):
            part, own = rows.slice(low, high - low), data[offsets[low]:offsets[high]]
            if high - low > 1 or len(own) <= PIECE:
                yield part, own, offsets[low:high + 1] - offsets[low], 0
                continue
            for at in range(0, len(own) - LENGTH + 1, PIECE):
                piece = own[at:at + PIECE + LENGTH - 1]
                yield part, piece, np.array([0, len(piece)]), at


def _signed(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers as signed ones of the same order."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def _leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    lead = np.zeros(len(at), np.uint64)
    for j in range(4):
        lead = lead << np.uint64(8) | data[at + j].astype(np.uint64)
    return lead << np.uint64(32)


SUFFIXES = "lead long, d1 long, d2 long, key_id long, key_text long, place long"


def run_suffixes(rows: DataFrame) -> DataFrame:
    """First round: `lead` (first bytes of the anchor, then its hash), a 128-bit digest of
    the run's bytes, and `place` (see `pack`)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets, shift in _pieces(batches, 2):
            first, starts, anchor, hashes = anchored_runs(data, offsets)
            if not len(first):
                continue
            view = memoryview(np.ascontiguousarray(data))
            digests = b"".join(xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(first.tolist(), (first + starts + LENGTH - 1).tolist()))
            halves = np.frombuffer(digests, ">i8").astype(np.int64).reshape(-1, 2)
            text = np.searchsorted(offsets, first, "right") - 1
            at = pa.array(text)
            yield batch(
                lead=pa.array(_signed(_leading(data, anchor) | hashes >> np.uint64(32))), d1=pa.array(halves[:, 0]), d2=pa.array(halves[:, 1]),
                key_id=part.column(0).take(at), key_text=part.column(1).take(at),
                place=pa.array((first - offsets[text] + shift) << 16 | starts - 1 << 8 | anchor - first),
            )

    return rows.select("key_id", "key_text", "text").mapInArrow(emit, SUFFIXES)


def finer_suffixes(rows: DataFrame, wanted: DataFrame, grain: int) -> DataFrame:
    """Later rounds: the wanted runs cut into runs of `grain` starts, on a grid that counts
    from the anchor, so that equal strings are cut alike.

    `lead` is made of the bytes that all strings of a grid cell share, its first bytes in
    front: a run whose lead no other has holds no repeated string.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            data, offsets = utf8(part.column(2))
            for i, places in enumerate(part.column(3).to_pylist()):
                view = memoryview(np.ascontiguousarray(data[offsets[i]:offsets[i + 1]]))
                for block in range(0, len(places), 4096):
                    leads, digests, out = [], [], []
                    for packed in places[block:block + 4096]:
                        asked, anchor, count, start = packed & 1, packed >> 1 & 255, (packed >> 9 & 255) + 1, packed >> 17
                        grid = start + anchor - (LENGTH - GRAM)  # where the grid begins
                        low, end = start, start + count
                        while low < end:
                            cell = low - (low - grid) % grain
                            high = min(end, cell + grain)
                            core = view[cell + grain - 1:cell + LENGTH]
                            leads.append(bytes(core[:4]) + xxhash.xxh32_digest(core))
                            digests.append(xxhash.xxh3_128_digest(view[low:high - 1 + LENGTH]))
                            out.append(pack(low, high - low, 0) * 2 + asked)
                            low = high
                    halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                    n = len(out)
                    yield batch(
                        lead=pa.array(_signed(np.frombuffer(b"".join(leads), ">u8").astype(np.uint64))), d1=pa.array(halves[:, 0]), d2=pa.array(halves[:, 1]),
                        key_id=pa.array([part.column(0)[i].as_py()] * n, pa.int64()), key_text=pa.array([part.column(1)[i].as_py()] * n, pa.int64()),
                        place=pa.array(out, pa.int64()),
                    )

    joined = rows.select("key_id", "key_text", "text").join(wanted, ["key_id", "key_text"])
    return joined.select("key_id", "key_text", "text", "places").mapInArrow(emit, SUFFIXES)


def pack(start: int, count: int, anchor: int) -> int:
    """A run as one number: first start, starts, and the anchor's distance from the first."""
    return start << 16 | count - 1 << 8 | anchor


# ---- buckets ---------------------------------------------------------------------


def multikey_quicksort(words: np.ndarray, small: int = 4096) -> np.ndarray:
    """The order of rows of words: a range is parted by a pivot of one word into less,
    equal and greater; the equal part goes on with the next word."""
    order = np.arange(len(words))
    stack = [(0, len(words), 0)]
    while stack:
        low, high, depth = stack.pop()
        if high - low < 2 or depth == words.shape[1]:
            continue
        own = order[low:high]
        if high - low <= small:
            order[low:high] = own[np.lexsort(words[own, depth:].T[::-1])]
            continue
        values = words[own, depth]
        pivot = np.sort(values[np.linspace(0, len(values) - 1, 9).astype(int)])[4]
        less, more = own[values < pivot], own[values > pivot]
        equal = own[values == pivot]
        order[low:high] = np.concatenate([less, equal, more])
        a, b = low + len(less), low + len(less) + len(equal)
        stack += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    return order


SORTED = SUFFIXES + ", again boolean, others boolean, edge boolean, copies long"


def sort_and_compare(suffixes: DataFrame) -> DataFrame:
    """`again`: an equal suffix stands beside it; `others`: a different one has its lead.

    Splitters are sampled by the range shuffle; equal suffixes are told apart by place, so
    that many copies of one string spread over buckets. Suffixes with a lead that no other
    has are left out. Of what shares the first or last lead of its bucket, one suffix for
    each string is compared again with those of other buckets; its copies are settled.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        words = np.stack([table.column(i).to_numpy() for i in range(3)], axis=1)
        order = multikey_quicksort(words)
        words = words[order]
        lead = words[:, 0]
        new_lead = np.concatenate([[True], lead[1:] != lead[:-1]])
        new = new_lead | np.concatenate([[True], (words[1:, 1] != words[:-1, 1]) | (words[1:, 2] != words[:-1, 2])])
        again = ~new | np.append(~new[1:], False)
        run = np.cumsum(new_lead) - 1
        others = np.bincount(run, new)[run] > 1
        edge = new & ((lead == lead[0]) | (lead == lead[-1]))
        string = np.cumsum(new) - 1
        copies = np.bincount(string)[string]
        keep = np.flatnonzero(again | others | edge)
        out = table.take(pa.array(order[keep]))
        for name, flags in (("again", again), ("others", others), ("edge", edge), ("copies", copies)):
            out = out.append_column(name, pa.array(flags[keep]))
        yield from out.to_batches(max_chunksize=100_000)

    ranged = suffixes.repartitionByRange("lead", "d1", "d2", "key_id", "key_text", "place")
    found = materialize(ranged.mapInArrow(compare, SORTED), "suffixes")
    edges = found.where("edge")
    each = edges.groupBy("lead", "d1", "d2").agg(F.sum("copies").alias("copies"))
    leads = each.groupBy("lead").agg(F.count("*").alias("different"))
    known = materialize(each.join(leads, "lead").where("copies > 1 or different > 1"), "edges")
    mended = edges.drop("again", "others", "copies").join(known, ["lead", "d1", "d2"]).select(
        *[c.split()[0] for c in SUFFIXES.split(", ")], (F.col("copies") > 1).alias("again"), (F.col("different") > 1).alias("others")
    )
    return found.where("not edge").drop("edge", "copies").unionByName(mended)


# ---- the operator ----------------------------------------------------------------


def repeated_spans(rows: DataFrame) -> DataFrame:
    """`key_id, key_text, spans`: stretches (start * 2^31 + bytes) to remove, unmerged."""
    runs = materialize(sort_and_compare(run_suffixes(rows)).withColumn("place", F.col("place") * 2 + 1), "runs")
    settled = _settled(runs)
    for grain in GRAINS:
        # Of a run that occurs again, one occurrence stands for all in the next round.
        open_runs = runs.where("others and not again and place % 2 = 1").select("key_id", "key_text", "place")
        stands = runs.where("others and (again or place % 2 = 0)").groupBy("lead", "d1", "d2").agg(F.min(F.struct("key_id", "key_text", "place")).alias("s"))
        stands = stands.select("s.key_id", "s.key_text", F.col("s.place").bitwiseAND(F.lit(-2)).alias("place"))
        wanted = open_runs.unionByName(stands).groupBy("key_id", "key_text").agg(F.collect_list("place").alias("places"))
        runs = materialize(sort_and_compare(finer_suffixes(rows, materialize(wanted, "wanted"), grain)), "runs")
        settled = settled.unionByName(_settled(runs))
    spans = settled.groupBy("key_id", "key_text").agg(F.collect_set(F.shiftleft("start", 31) + F.col("size")).alias("spans"))
    return materialize(spans, "spans")


def _settled(runs: DataFrame) -> DataFrame:
    size = F.shiftright("place", 9).bitwiseAND(F.lit(255)) + LENGTH
    return runs.where("again and place % 2 = 1").select("key_id", "key_text", F.shiftright("place", 17).alias("start"), size.cast("long").alias("size"))


def bucketed(rows: DataFrame) -> DataFrame:
    """The texts stored in buckets by key: shuffled once, and joined three times with small
    tables that come to them."""
    spark = rows.sparkSession
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"texts_{uuid.uuid4().hex}"
    keys = ["key_id", "key_text"]
    dealt = rows.repartition(buckets, *keys)
    dealt.write.format("parquet").option("path", scratch_path(spark, "texts")).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Remove each byte that lies in a string of `LENGTH` bytes which starts anywhere else.

    Texts are UTF-8 bytes, matches never cross documents and may overlap or lie in one
    document; what counts is the input, so all occurrences go. Returns a row per row:
    `doc_id, n_bytes, n_removed, n_spans` (maximal removed runs), `kept_sha256`, and
    `kept` (the bytes) with `keep_text`. Null and empty texts have no bytes; repeated rows
    lose all they share. Strings are compared by 128-bit digests.
    """
    rows = bucketed(keyed(docs.withColumn("doc_id", F.col("doc_id").cast("long"))))
    spans = repeated_spans(rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            data, offsets = utf8(part.column(1))
            out = []
            for i, packed in enumerate(part.column(2).to_pylist()):
                text = data[offsets[i]:offsets[i + 1]]
                removed = runs = 0
                if packed:
                    values = np.sort(np.array(packed, np.int64))
                    start, end = values >> 31, (values >> 31) + (values & (1 << 31) - 1)
                    reach = np.maximum.accumulate(end)
                    new = np.concatenate([[True], start[1:] > reach[:-1]])
                    low, high = start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]
                    removed, runs = int((high - low).sum()), len(low)
                    kept = np.concatenate([text[a:b] for a, b in zip([0, *high], [*low, len(text)])]).tobytes()
                else:
                    kept = text.tobytes()
                out.append((len(text), removed, runs, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            size, removed, runs, digest, kept = zip(*out) if out else ((),) * 5
            yield batch(
                doc_id=part.column(0), n_bytes=pa.array(size, pa.int64()), n_removed=pa.array(removed, pa.int64()),
                n_spans=pa.array(runs, pa.int64()), kept_sha256=pa.array(digest, pa.string()), kept=pa.array(kept, pa.binary()),
            )

    joined = rows.join(spans, ["key_id", "key_text"], "left").select("doc_id", "text", "spans")
    result = joined.mapInArrow(cut, RESULT)
    return result if keep_text else result.drop("kept")
