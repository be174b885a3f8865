"""Benchmark decontamination by q-gram lemma filtering and banded alignment."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from dialogue_factors.llm.common import batch, chunks, mix, utf8

MATCHES = "doc_id long, key_id long, key_text long, item_id long, item_start long, item_end long, doc_start long, doc_end long, edits int"


@dataclass(frozen=True)
class Filter:
    """q: characters of a q-gram; window: characters of an item, from any place on, that
    must be found; edit_share: allowed edits by window length; band: diagonals between
    bands; block_chars: characters of benchmark text searched for in one pass."""

    q: int = 10
    window: int = 100
    edit_share: float = 0.08
    band: int = 16
    block_chars: int = 1 << 20


def normal(text: str) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join(text.lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """A hash for the q-gram at each position."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(q):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += points[j:j + n]
    return mix(out)


class Items:
    """Benchmark items end to end, and where each of their q-grams occurs."""

    def __init__(self, items: list[tuple[int, str]], rule: Filter):
        self.rule = rule
        texts = [(item_id, code_points(normal(raw))) for item_id, raw in items]
        texts = [(item_id, points) for item_id, points in texts if len(points) >= rule.q]
        self.ids = np.array([item_id for item_id, _ in texts], np.int64)
        self.length = np.array([len(points) for _, points in texts], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.points = np.concatenate([*(points for _, points in texts), np.zeros(0, np.uint32)])
        self.size = np.minimum(self.length, rule.window)  # of the item's windows
        # Each edit destroys q q-grams at most: the rest must lie in a band of diagonals.
        self.edits = np.minimum((self.size * rule.edit_share).astype(np.int64), (self.size - rule.q) // rule.q)
        self.needed = self.size - rule.q + 1 - rule.q * self.edits
        grams = [qgram_hashes(points, rule.q) for _, points in texts]
        hashes = np.concatenate([*grams, np.zeros(0, np.uint64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])[order]
        self.place = np.concatenate([*(np.arange(len(g), dtype=np.int32) for g in grams), np.zeros(0, np.int32)])[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def shared_grams(self, points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
        """Rows `doc, item, band, place, position` of the q-grams that documents share with
        items, in this order; a repeated q-gram of a document counts once for each place
        of the item.

        `points`: documents end to end, each starting at `doc_starts` and followed by
        separators, so that no q-gram of an item crosses documents.
        """
        rule = self.rule
        hashes = qgram_hashes(points, rule.q)
        at = np.flatnonzero(self.seen[(hashes >> np.uint64(42)).astype(np.int64)])
        low = np.searchsorted(self.hashes, hashes[at], "left")
        many = np.searchsorted(self.hashes, hashes[at], "right") - low
        at, low, many = at[many > 0], low[many > 0], many[many > 0]
        if not len(at):
            return np.zeros((0, 5), np.int64)
        entry = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        position = np.repeat(at, many)
        doc = np.searchsorted(doc_starts, position, "right") - 1
        item, place, position = self.item[entry].astype(np.int64), self.place[entry].astype(np.int64), position - doc_starts[doc]
        diagonal = position - place + self.length[item]  # never negative
        # A band covers its `band` diagonals and as many more as a window may have edits,
        # so all q-grams of one match, whose diagonals differ by the edits at most, share one.
        home = diagonal // rule.band
        found = []
        for back in range(-(-int(self.edits.max()) // rule.band) + 1):
            band = home - back
            ok = (band >= 0) & (diagonal < (band + 1) * rule.band + self.edits[item])
            found.append(np.stack([doc[ok], item[ok], band[ok], place[ok], position[ok]], axis=1))
        rows = np.concatenate(found)
        rows = rows[np.lexsort(rows.T[::-1])]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :4] != rows[:-1, :4]).any(axis=1)
        return rows[new]

    def runs(self, rows: np.ndarray) -> list[np.ndarray]:
        """Where windows hold as many q-grams of a band as the lemma asks for: `doc, item,
        band`, the first and last start of such windows, that of the fullest one, and the
        stretches of item and document that their q-grams cover, a run of overlapping
        windows each."""
        if not len(rows):
            return [np.zeros(0, np.int64)] * 10
        rule, (doc, item, band, place, position) = self.rule, rows.T
        group = np.cumsum(np.concatenate([[0], (np.diff(rows[:, :3], axis=0) != 0).any(axis=1)]))
        span = self.size[item] - rule.q
        last = np.arange(len(rows)) + self.needed[item] - 1  # with so many q-grams from here
        inside = np.minimum(last, len(rows) - 1)
        i = np.flatnonzero((last < len(rows)) & (group[inside] == group) & (place[inside] - place <= span))
        if not len(i):
            return [np.zeros(0, np.int64)] * 10
        j = last[i]
        key = group * (int(self.length.max()) + rule.window + 1) + place
        held = np.searchsorted(key, key[i] + span[i], "right")
        limit = (self.length - self.size)[item[i]]
        starts = np.ones(len(i), bool)
        starts[1:] = (group[i][1:] != group[i][:-1]) | (place[i][1:] > place[j][:-1])
        heads = np.flatnonzero(starts)
        tails = np.append(heads[1:], len(i)) - 1
        run = np.cumsum(starts) - 1
        by_count = np.lexsort((held - i, run))  # the fullest window of each run comes last
        best = i[by_count[tails]]
        low = np.clip(place[j[heads]] - span[i[heads]], 0, limit[heads])
        high = np.minimum(place[i[tails]], limit[tails])
        end = held[tails] - 1
        return [
            doc[i[heads]], item[i[heads]], band[i[heads]], low, np.maximum(high, low), np.clip(place[best], low, np.maximum(high, low)),
            place[i[heads]], place[end] + rule.q, position[i[heads]], position[end] + rule.q,
        ]

    def align(self, points: np.ndarray, doc_starts: np.ndarray, doc_sizes: np.ndarray, doc: np.ndarray, item: np.ndarray, start: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Least edits between each window and a stretch of its document whose diagonals
        lie in the band. One row of the band at a time, all windows of equal length
        together."""
        edits, diagonal = np.full(len(doc), 1 << 20), band * self.rule.band - self.length[item] + start
        sizes = self.size[item]
        for size in np.unique(sizes):
            for some in np.array_split(np.flatnonzero(sizes == size), max(1, int((sizes == size).sum()) // 20_000)):
                allowed = int(self.edits[item[some]].max())
                width = self.rule.band + 2 * allowed + 1
                begins = (self.first[item[some]] + start[some])[:, None]
                first = diagonal[some] - allowed  # document position of column 0 in row 0
                columns = np.arange(width)
                best = np.zeros((len(some), width), np.int32)  # the stretch may begin anywhere
                best[first[:, None] + columns < 0] = 1 << 20
                for i in range(size):
                    place = first[:, None] + columns + i
                    inside = (place >= 0) & (place < doc_sizes[doc[some]][:, None])
                    here = points[np.where(inside, place, 0) + doc_starts[doc[some]][:, None]]
                    same = inside & (here == self.points[begins + i])
                    step = best + ~same  # both move: same diagonal
                    step[~inside] = 1 << 20
                    step[:, :-1] = np.minimum(step[:, :-1], best[:, 1:] + 1)  # item character missing in the document
                    # document characters that the item lacks: a running minimum along the row
                    best = np.minimum.accumulate(step - columns, axis=1) + columns
                edits[some] = best.min(axis=1)
        return edits

    def search(self, points: np.ndarray, doc_starts: np.ndarray, doc_sizes: np.ndarray) -> list[np.ndarray]:
        """`doc, item, item_start, item_end, doc_start, doc_end, edits` of the runs with a
        window that matches: the fullest one is aligned first, and where it does not match,
        those from every other place of the run."""
        doc, item, band, low, high, best, *stretch = self.runs(self.shared_grams(points, doc_starts))
        edits = self.align(points, doc_starts, doc_sizes, doc, item, best, band)
        open_ = np.flatnonzero(edits > self.edits[item])
        if len(open_):
            many = high[open_] - low[open_] + 1
            of = np.repeat(open_, many)
            start = np.repeat(low[open_] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            np.minimum.at(edits, of, self.align(points, doc_starts, doc_sizes, doc[of], item[of], start, band[of]))
        keep = np.flatnonzero(edits <= self.edits[item])
        rows = np.stack([c[keep] for c in (doc, item, *stretch, edits)], axis=1)
        return list(np.unique(rows, axis=0).T)  # neighbouring bands may hold one run


_BUILT: dict[str, Items] = {}


def built(name: str, items: list[tuple[int, str]], rule: Filter) -> Items:
    """The index of a block, made once by a worker for all its tasks."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Items(items, rule)
    return _BUILT[name]


def _item_blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded text; items arrive partition by partition."""
    block, chars = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        if block and chars + len(row.text) > limit:
            yield block
            block, chars = [], 0
        block.append((row.item_id, row.text))
        chars += len(row.text)
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, rule: Filter = Filter()) -> DataFrame:
    """Stretches of documents that match a window of a benchmark item within the edits.

    Texts are compared in lower case with runs of white space as one space. A window is
    any `rule.window` characters of an item in turn, or a whole shorter item. Q-grams
    shared with a document are counted in overlapping bands of diagonals; where no window
    of a band holds as many as the q-gram lemma asks for there is no match, and elsewhere
    windows are verified by banded alignment, so no match is lost, wherever it begins.

    Returns a row per run of overlapping windows of a document: `doc_id, item_id,
    item_start, item_end, doc_start, doc_end, edits`: the stretches that the shared q-grams
    cover, in normalised texts, and the edits of the window that was verified. Null and
    empty texts, and items under `rule.q` characters, match nothing. Repeated rows give
    equal rows once. The benchmark is a query set: it is searched for in blocks of
    `rule.block_chars`, a pass of the documents for each; documents are not shuffled.
    """
    found = None
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("key_text"), "text",
    )
    for items in _item_blocks(benchmark, rule.block_chars):
        shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def search(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            index = built(name, shared.value, rule)
            for rows in batches:
                _, sizes = utf8(rows.column(3))
                for low, high in chunks(sizes) if len(index.ids) else ():
                    part = rows.slice(low, high - low)
                    texts = [code_points(normal(t or "")) for t in part.column(3).to_pylist()]
                    gap = np.full(rule.q, 0x110000, np.uint32)  # no character
                    points = np.concatenate([x for t in texts for x in (t, gap)])
                    lengths = np.array([len(t) for t in texts], np.int64)
                    starts = np.cumsum(lengths + rule.q) - lengths - rule.q
                    doc, item, *stretch, edits = index.search(points, starts, lengths)
                    if not len(doc):
                        continue
                    d, places = pa.array(doc), [pa.array(c) for c in stretch]
                    yield batch(
                        doc_id=pc.take(part.column(0), d), key_id=pc.take(part.column(1), d), key_text=pc.take(part.column(2), d),
                        item_id=pa.array(index.ids[item]), item_start=places[0], item_end=places[1], doc_start=places[2], doc_end=places[3],
                        edits=pa.array(edits.astype(np.int32)),
                    )

        part = base.mapInArrow(search, MATCHES)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], MATCHES)
    return found.distinct()
