"""Swap packing and zone-map clustering against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from dialogue_factors.llm import swap_packing, tokens, zone_maps
from dialogue_factors.llm.queries import ORACLES, QUERIES

ODD = [
    (1000001, None), (1000002, ""), (1000003, " \n\t "), (1000004, "a"), (1000004, "a"), (None, "no id here, but some words to read."), (1000005, "Ünïcödé — “quotes” 中文 🙂 it's 42 <|endoftext|>"),
    (1000006, "same words again " * 4000), (1000007, "x" * 70_000), (1000008, "tie"), (1000009, "tie"), (-3, "two  blanks\n\nand breaks \x00"),
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(swap_packing.byte_tokenizer())


@pytest.mark.parametrize("remembered", [300_000, 20])
def test_spaced_encoder(tokenizer, monkeypatch, remembered):
    monkeypatch.setattr(tokens, "REMEMBERED", remembered)
    draw = random.Random(1)
    parts = [*"ab'sd19.,!é中🙂", *" " * 5, "\n", "\t", "\r\n", " ", "　", " ", "\x85", "\x0b", "'s", "don't", "\x1c", "é", "<|endoftext|>"]
    encoder = tokens.SpacedEncoder(swap_packing.byte_tokenizer())
    for turn in range(30):
        some = parts[:-1] if turn % 2 else parts
        rows = ["".join(draw.choices(some, k=draw.randint(0, 30))) for _ in range(60)] + [None, "", " ", "  ", "a ", "\x00 a" if turn % 5 == 0 else "a\nb c"]
        flat, offsets = encoder.encode(pa.array(rows, pa.string()))
        assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [tokenizer.encode(r or "", add_special_tokens=False).ids for r in rows]


def placed_soundly(rows, capacity):
    """Every piece once, gapless sequences within the capacity; how many sequences."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_swap_packing(spark, data, tokenizer, monkeypatch):
    monkeypatch.setattr(swap_packing, "GROUP_PIECES", 60)
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()] + ODD
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in texts], "doc_id long, text string, piece int, key long, room long")
    got = swap_packing.pack_by_swaps(docs, keep_ids=True).collect()
    expected, total = [], 0
    for doc_id, text in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        expected += [(doc_id, n, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].tolist()) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in got), key=repr) == sorted(expected, key=repr)
    assert placed_soundly(got, 2048) <= 1.03 * -(-total // 2048)
    assert swap_packing.pack_by_swaps(docs.limit(0)).count() == 0


def test_exchanges_beat_best_fit():
    draw = np.random.default_rng(2)
    sizes = draw.integers(500, 1500, 4000)
    first = swap_packing.best_fit(sizes, 2048)
    search = swap_packing.Search(sizes, first, 2048)
    before = int((search.fill ** 2).sum())
    found = search.run()
    assert sorted(i for b in found for i in b) == list(range(len(sizes)))
    assert max(sizes[b].sum() for b in found) <= 2048 and len(found) < len(first)
    assert int((search.fill ** 2).sum()) > before
    for sizes, bins in (([6, 4, 5, 5], [[0], [1], [2, 3]]), ([6, 3, 4, 7], [[0, 1], [2], [3]])):  # a move, an exchange
        assert len(swap_packing.Search(np.array(sizes), bins, 10).run()) == 2


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if c in groups else m for c, m in enumerate(centres)]
    found = [(i, *near(v)) for i, v in kept]
    part = {c: sum(d for _, d, e in found if e == c) for c in range(k)}
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in centres]
    return sorted(((i, c, d, part[c], sum(part.values()), digest[c]) for i, d, c in found), key=repr)


def test_zone_map_clustering(spark, data):
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    draw = np.random.default_rng(4)
    vectors = [(int(i), [float(x) for x in v]) for i, v in enumerate(np.repeat(draw.normal(size=(5, 64)), 12, 0) + 0.01 * draw.normal(size=(60, 64)))]
    same, extreme = [0.5] * 64, [60000.0, *[-0.25] * 63]
    odd = [(100, None), (101, [1.0] * 63), (102, [1.0] * 63 + [None]), (103, [float("nan")] * 64), (104, [float("inf")] * 64), (None, same), (105, same), (105, same), (106, same), (107, extreme), (108, [])]
    for rows in (vectors + odd, odd, vectors[:3]):
        df = spark.createDataFrame([(i, v, 1, "x", 9) for i, v in rows], "vec_id long, embedding array<double>, cluster int, key string, distance long")
        got = zone_maps.cluster_vectors(df).select(columns).collect()
        assert sorted((tuple(r) for r in got), key=repr) == plain_clusters(rows)
    assert zone_maps.cluster_vectors(df.limit(0)).collect() == []
    with pytest.raises(Exception, match="65536"):
        zone_maps.cluster_vectors(spark.createDataFrame([(1, [70000.0] * 64)], "vec_id long, embedding array<double>")).collect()
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    expected = connection.sql(ORACLES["op13_zone_map_clustering"]).project(", ".join(columns)).fetchall()
    got = QUERIES["op13_zone_map_clustering"](spark, data).select(columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(expected)


def test_boxes_rule_out_far_centroids(spark):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(8, 64))
    rows = [(int(i), [float(x) for x in centres[i % 8] + 0.02 * draw.normal(size=64)]) for i in range(2000)]
    kept = zone_maps.kept_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 64)
    blocks, axes = zone_maps.block_table(kept, 64, 64)
    seen = zone_maps.compared_centroids(blocks, np.floor(1024 * centres).astype(np.int64), axes).collect()
    assert sum(r.rows for r in seen) == 2000
    assert sum(r.rows * r.compared for r in seen) < 0.4 * 8 * 2000


def test_hilbert_neighbours_are_one_step_apart():
    cells = np.stack(np.meshgrid(*[range(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = zone_maps.hilbert_keys(cells, 3)
    along = cells[np.lexsort(keys.T[::-1])]
    assert set(np.abs(np.diff(along, axis=0)).sum(1)) == {1}
