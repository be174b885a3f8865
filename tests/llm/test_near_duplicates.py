"""Near duplicates: regions that are pruned lose no link, and a stage loses no row."""

from __future__ import annotations

import random

import corpus_pipeline
from dialogue_factors.llm import jaccard_join

from test_operators import brute_components, by_text, documents

ONE, TWO, THREE = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight", "red green blue white black brown pink grey")


def test_passages_and_chains_of_copies(spark):
    draw = random.Random(8)
    word = lambda: f"v{draw.randint(0, 3000)}"
    passages = [[word() for _ in range(60)] for _ in range(6)]
    rows, number = [], 0
    for family in range(25):
        text = [word() for _ in range(draw.choice([20, 80, 300, 900]))]
        for p in draw.sample(passages, draw.randint(0, 4)):
            at = draw.randrange(len(text))
            text[at:at] = p
        for _ in range(draw.choice([1, 2, 5, 14])):
            for _ in range(draw.randint(0, max(1, len(text) // 25))):
                text[draw.randrange(len(text))] = word()  # each copy is made from the one before
            number += 1
            rows.append((number, " ".join(text)))
    rows += [(number + 1 + i, " ".join(p)) for i, p in enumerate(passages)]
    draw.shuffle(rows)
    got = jaccard_join.near_duplicates(documents(spark, rows))
    assert by_text((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == by_text(brute_components(rows))


def test_one_of_each_group_loses_no_row(spark):
    rows = [(1, ONE), (1, TWO), (2, ONE), (3, THREE), (3, THREE), (None, THREE), (None, "a b c d e f"), (None, "a b c d e f"), (None, "g h i j k l"), (4, ""), (4, ""), (5, None), (None, "")]
    kept = corpus_pipeline.one_of_each_group(spark, documents(spark, rows), "").collect()
    expected = [(1, ONE), (1, TWO), (3, THREE), (None, "a b c d e f"), (None, "g h i j k l"), (4, ""), (4, ""), (5, None), (None, "")]
    assert by_text((r.doc_id, r.text) for r in kept) == by_text(expected)
    assert corpus_pipeline.one_of_each_group(spark, documents(spark, []), "").collect() == []
