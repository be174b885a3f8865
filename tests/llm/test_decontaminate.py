"""Q-gram filtering against plain dynamic programming, at every offset."""

from __future__ import annotations

import random

import numpy as np

from dialogue_factors.llm.decontaminate import Filter, Items, code_points, find_leaks, normal

from test_operators import documents

RULE = Filter()


def least_edits(window, text):
    """Edits between a window and the nearest stretch of a text."""
    best = np.zeros(len(text) + 1, int)
    for a in window:
        step = np.minimum(best[:-1] + (np.frombuffer(text.encode("utf-32-le"), np.uint32) != ord(a)), best[1:] + 1)
        best = np.concatenate([[best[0] + 1], step])
        best = np.minimum.accumulate(best - np.arange(len(best))) + np.arange(len(best))
    return best.min()


def holds(item, text):
    size = min(len(item), RULE.window)
    allowed = min(int(size * RULE.edit_share), (size - RULE.q) // RULE.q)
    return any(least_edits(item[s:s + size], text) <= allowed for s in range(len(item) - size + 1))


def edited(draw, text, edits):
    places = sorted(draw.sample(range(len(text)), edits), reverse=True)
    out = list(text)
    for p in places:
        kind = draw.choice("sid")
        out[p:p + 1] = {"s": ["#"], "i": ["#", out[p]], "d": []}[kind]
    return "".join(out)


def items_of(spark, data):
    return sorted({normal(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}, key=len)


def test_spread_edits_at_every_offset(spark, data):
    """Excerpts of a window's length with up to eight spread substitutions are all found."""
    item = items_of(spark, data)[-1]
    index = Items([(7, item)], RULE)
    for k in range(9):
        places = [int((i + 0.5) * 100 / k) for i in range(k)]
        for start in range(len(item) - 99):
            excerpt = list(item[start:start + 100])
            for p in places:
                excerpt[p] = "#"
            points = code_points("zq xj " + "".join(excerpt) + " vk jx")
            found = index.search(np.concatenate([points, np.full(RULE.q, 0x110000, np.uint32)]), np.array([0]), np.array([len(points)]))
            assert len(found[0]), (k, start)


def test_against_dynamic_programming(spark, data):
    draw = random.Random(6)
    items = items_of(spark, data)
    chosen = [items[0][:60], items[len(items) // 2][:130], items[-1][:170]]
    rows = []
    for i in range(90):
        item = draw.choice(chosen)
        size = draw.choice([min(len(item), n) for n in (50, 96, 100, 104, 130)])
        start = draw.randrange(len(item) - size + 1)
        piece = edited(draw, item[start:start + size], draw.randint(0, 11))
        rows.append((i, " ".join([draw.choice(["qx vj", "the of"]), piece, "jx qz"] + [piece[:30]] * draw.randint(0, 2))))
    bench = spark.createDataFrame(list(enumerate(chosen)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(documents(spark, rows), bench).collect()}
    expected = {(d, i) for d, text in rows for i, item in enumerate(chosen) if holds(item, normal(text))}
    assert got == expected and 20 < len(expected) < 90


def test_one_row_for_a_stretch(spark, data):
    item = items_of(spark, data)[-1]
    docs = documents(spark, [(1, f"Before it {item.upper()} and after"), (2, f"{item} xx {item}"), (3, None), (3, None)])
    bench = spark.createDataFrame([(5, item), (5, item), (6, "short"), (None, None)], "item_id long, text string")
    rows = sorted((r.doc_id, r.item_id, r.item_start, r.item_end, r.doc_start, r.doc_end, r.edits) for r in find_leaks(docs, bench).collect())
    n = len(item)
    assert rows == [(1, 5, 0, n, 10, 10 + n, 0), (2, 5, 0, n, 0, n, 0), (2, 5, 0, n, n + 4, 2 * n + 4, 0)]


def test_a_full_block_is_small():
    draw = random.Random(1)
    words = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(400)]
    index = Items([(i, " ".join(draw.choices(words, k=170))) for i in range(1000)], RULE)
    assert sum(len(i) for i in [index.points]) > 900_000
    assert sum(a.nbytes for a in (index.hashes, index.item, index.place, index.seen, index.points)) < 40 << 20
