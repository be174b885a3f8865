"""Word vectors: counts, factorisation and what they tell apart."""

from __future__ import annotations

import math
import random
from collections import Counter
from dataclasses import replace

import numpy as np

from dialogue_factors.config import Settings
from dialogue_factors.operators import word_vectors
from dialogue_factors.operators.embed import hashed_tfidf

SMALL = replace(Settings(), word_vocabulary=30, word_window=2, word_dims=4, word_rounds=6)


def test_pairs_and_pmi_against_loops(spark, monkeypatch):
    monkeypatch.setattr(word_vectors, "CHUNK_BYTES", 40)
    draw = random.Random(1)
    texts = [" ".join(draw.choices(["Aa", "b", "c.", "dé", "E", "f", "rare%d" % i], [9, 7, 5, 3, 3, 2, 1], k=draw.randint(0, 25))) for i in range(60)] + [None, "", " . "]
    settings = replace(SMALL, word_vocabulary=5)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    words = word_vectors.word_table(df, settings=settings)
    token = {r.word: r.token for r in words.collect()}
    split = [[w.strip(".").lower() for w in (t or "").split() if w.strip(".")] for t in texts]
    count = Counter(w for t in split for w in t)
    assert [token[i] for i in range(5)] == sorted(count, key=lambda w: (-count[w], w))[:5]
    pairs = Counter((a, b) for t in split for i, a in enumerate(t) for j, b in enumerate(t) if 0 < abs(i - j) <= 2 and {a, b} <= set(token.values()))
    counted = word_vectors.count_pairs(df, words, settings=settings)
    assert {(token[r.word], token[r.context]): r.n for r in counted.collect()} == pairs
    margin, total = Counter(), sum(pairs.values())
    for (a, _), n in pairs.items():
        margin[a] += n
    expected = {k: math.log(n * total / margin[k[0]] / margin[k[1]]) for k, n in pairs.items()}
    got = {(token[r.word], token[r.context]): r.pmi for r in word_vectors.positive_pmi(counted).collect()}
    assert got.keys() == {k for k, v in expected.items() if v > 0}
    assert all(abs(got[k] - expected[k]) < 1e-12 for k in got)


def test_factors_are_the_largest_ones(spark):
    draw = np.random.default_rng(2)
    basis, _ = np.linalg.qr(draw.standard_normal((30, 30)))
    matrix = basis * np.r_[9.0, 7, 5, 4, 0.3 * draw.random(26)] @ basis.T
    df = spark.createDataFrame([(i, j, float(matrix[i, j])) for i in range(30) for j in range(30)], "word int, context int, pmi double")
    vectors = word_vectors.factorise(df, 30, SMALL)
    best = basis[:, :4] * [9, 7, 5, 4] @ basis[:, :4].T
    assert np.abs(vectors @ vectors.T - best).max() < 1e-3


def test_topics_lie_further_apart_than_by_hashed_words(spark):
    draw = random.Random(3)
    topics = [[f"w{t}x{i}" for i in range(60)] for t in range(3)]
    rows = [(d, " ".join(draw.choices(topics[d % 3], k=6) + draw.choices(["the", "of", "and"], k=6))) for d in range(600)]
    df = spark.createDataFrame(rows + [(9999, None)], "doc_id long, text string")
    settings = replace(Settings(), word_dims=8)

    def margin(embedded):
        table = {r.doc_id: np.array(r.embedding) for r in embedded.collect()}
        assert not table[9999].any()
        likeness = np.array([table[d] for d in range(600)]) @ np.array([table[d] for d in range(600)]).T
        topic = np.arange(600) % 3
        same = (topic[:, None] == topic) & ~np.eye(600, dtype=bool)
        return likeness[same].mean() - likeness[topic[:, None] != topic].mean()

    learned = margin(word_vectors.encode_with_words(df, "doc_id", word_vectors.fit_word_vectors(df, settings=settings)))
    assert learned > 0.5 and learned > 3 * margin(hashed_tfidf(df, "doc_id"))


def test_no_text_gives_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert word_vectors.fit_word_vectors(empty).collect() == []


def test_a_task_adds_up_pairs_of_all_its_chunks(spark, monkeypatch):
    monkeypatch.setattr(word_vectors, "CHUNK_BYTES", 8)
    df = spark.createDataFrame([("a b a",), ("b a",), ("a a",)] * 4, "text string").coalesce(1)
    words = word_vectors.word_table(df, settings=SMALL)
    known = words.orderBy("word").select("token").toArrow().column(0).combine_chunks()
    assert known.to_pylist() == ["a", "b"]
    rows = word_vectors.pairs_of_tasks(df, known, window=2).collect()
    assert sorted((r.pair, r.n) for r in rows) == [(0, 8), (1, 12)]  # one row a pair, orders together
    counted = word_vectors.count_pairs(df, words, settings=SMALL).collect()
    assert sorted(map(tuple, counted)) == [(0, 0, 16), (0, 1, 12), (1, 0, 12)]
    monkeypatch.setattr(word_vectors, "HELD_PAIRS", 1)  # passes on at once
    assert sorted(map(tuple, word_vectors.count_pairs(df, words, settings=SMALL).collect())) == sorted(map(tuple, counted))
