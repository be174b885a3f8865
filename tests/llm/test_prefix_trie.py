"""The conversation trie against a plain dictionary and against SQL."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from dialogue_factors.llm.prefix_trie import DoubleArray, prefix_trie
from dialogue_factors.llm.queries import ORACLES, QUERIES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    own = {}
    digest = lambda role, text: hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    turns = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(turns.get(c - int(np.fmod(c, 20)), [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append((c, d == len(path)))
    out = []
    for path, members in nodes.items():
        under = [p for p in nodes if p[:len(path)] == path]
        children = sum(len(p) == len(path) + 1 for p in under)
        leaves = sum(not any(len(q) == len(p) + 1 and q[:-1] == p for q in under) for p in under)
        saved = sum((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in under if p)
        ends = ",".join(str(c) for c, e in sorted(members) if e)
        parent = min(nodes[path[:-1]])[0] if path else None
        out.append((min(members)[0], len(path), parent, len(members), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed):
    draw = random.Random(seed)
    rows = []
    for c in [*range(90), 400, 401, 999, -1, -20, -25, 1_000_001]:
        if draw.random() < 0.15:
            continue
        length = draw.choice([0, 1, 2, 3, 4, 6, 12])
        rows += [(c, draw.choice([t, t, t, None, 0]), draw.choice(["u", "a", None, ""]), draw.choice(["x y", "x y z", "", None, "long \n text"])) for t in range(length)]
    same = [("u", "hello there"), ("a", "hi"), ("u", "again the same"), ("a", "yes"), ("u", "bye")]
    rows += [(c, t, *x) for c in range(2000, 2060) for t, x in enumerate(same[:4 + c % 2])]
    return rows + rows[:5] + [(None, 1, "u", "nobody")]


@pytest.mark.parametrize("segment, shard_rows", [(128, 20_000), (128, 7), (3, 5), (1, 4)])
def test_prefix_trie(spark, segment, shard_rows):
    rows = conversations(shard_rows)
    df = spark.createDataFrame([(*r, 1, b"k") for r in rows], "conv_id long, turn long, role string, text string, depth int, key binary")
    got = prefix_trie(df, segment, shard_rows).select(COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_trie(rows)
    if segment == 128:
        assert prefix_trie(df.limit(0)).collect() == []
        connection = duckdb.connect()
        connection.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
        sql = connection.sql(ORACLES["op12_prefix_trie"]).project(", ".join(COLUMNS)).fetchall()
        assert sorted(sql, key=repr) == plain_trie(rows)


def test_registered_trie(spark, data):
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    expected = connection.sql(ORACLES["op12_prefix_trie"]).project(", ".join(COLUMNS)).fetchall()
    got = QUERIES["op12_prefix_trie"](spark, data).select(COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(expected, key=repr)


def test_double_array_holds_every_path_and_no_other():
    draw = np.random.default_rng(3)
    lengths = draw.integers(1, 7, 500)
    paths = np.where(np.arange(6) < lengths[:, None], draw.integers(0, 9, (500, 6)) * draw.integers(1, 40, 6), -1)
    trie = DoubleArray(paths)
    known = {tuple(p[:d + 1]) for p in paths.tolist() for d in range(6) if p[d] >= 0}
    assert int((trie.check[1:] >= 0).sum()) == len(known)
    states = trie.walk(paths)
    assert ((states >= 0) == (paths >= 0)).all()
    other = np.where(np.arange(6) < lengths[:, None], draw.integers(0, 350, (500, 6)), -1)
    for path, line in zip(other.tolist(), trie.walk(other).tolist()):
        for d, state in enumerate(line):
            if path[d] >= 0:
                assert (state >= 0) == (tuple(path[:d + 1]) in known)
