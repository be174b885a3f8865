"""The store of fitted parameters: versions, epochs, and writes that broke off."""

from __future__ import annotations

import numpy as np
import pytest

from dialogue_factors.config import Settings
from dialogue_factors.operators.embed import hashed_idf, hashed_tfidf
from dialogue_factors.operators.reduce import apply_reducer, fit_reducer, reducer_rows
from dialogue_factors.plans import jobs
from dialogue_factors.sources.models import part, read_model, save_model, versions


def test_versions_and_epochs(spark, tmp_path):
    store = str(tmp_path / "store")
    assert versions(spark, store).count() == 0
    with pytest.raises(ValueError, match="no model"):
        read_model(spark, store, "a")
    for epoch, value in ((0, 1.0), (1, 2.0), (0, 3.0)):
        save_model(spark, store, "a", {"w": part(np.full((3, 2), value), np.arange(3)), "idf": part(np.array([value, -0.5]))}, epoch)
    save_model(spark, store, "b", {"w": part([[9.0]])}, 5)
    current, first, second = (read_model(spark, store, "a", e) for e in (None, 0, 1))
    assert sorted(current) == ["idf", "w"] and (current["w"][0] == 3.0).all() and (current["w"][1] == [0, 1, 2]).all()
    assert (first["w"][0] == 3.0).all() and (second["w"][0] == 2.0).all() and (second["idf"][0] == [[2.0, -0.5]]).all()
    assert read_model(spark, store, "b")["w"][0].tolist() == [[9.0]]
    with pytest.raises(ValueError, match="epoch 7"):
        read_model(spark, store, "a", 7)
    assert sorted((r.run, r.number) for r in versions(spark, store).collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]


def test_unfinished_version_is_not_read(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    save_model(spark, store, "a", {"w": part([[1.0]])})
    monkeypatch.setattr("dialogue_factors.sources.models.versions", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        save_model(spark, store, "a", {"w": part([[2.0]])})
    monkeypatch.undo()
    assert len(list((tmp_path / "store" / "parts").iterdir())) == 2
    assert read_model(spark, store, "a")["w"][0].tolist() == [[1.0]]


def test_parts_need_rows(spark, tmp_path):
    for parts in ({}, {"w": (np.zeros((0, 2)), np.zeros(0))}):
        with pytest.raises(ValueError, match="rows"):
            save_model(spark, str(tmp_path / "store"), "a", parts)


def test_given_weights_and_reducer_rows(spark):
    texts = spark.createDataFrame([(1, "red green"), (2, "red blue blue"), (3, None), (4, "")], "k int, text string")
    idf = hashed_idf(texts, "k", dims=16)
    same = {r.k: r.embedding for r in hashed_tfidf(texts, "k", dims=16).collect()}
    one = texts.where("k = 2")
    assert {r.k: r.embedding for r in hashed_tfidf(texts, "k", idf=idf).collect()} == same
    assert hashed_tfidf(one, "k", idf=idf).first().embedding == same[2]
    draw = np.random.default_rng(3).normal(size=(40, 5)) + 7.0
    rows = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(draw)], "k int, x array<double>")
    model = fit_reducer(rows, "x", 3)
    mean, components = reducer_rows(model)
    for r in apply_reducer(model, rows, "x").collect():
        assert np.allclose(r.reduced, components @ (np.array(r.x) - mean))


def test_settings_from_the_command_line(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(jobs, "build_session", lambda: spark)
    dropped = []
    monkeypatch.setattr(jobs, "drop_scratch", dropped.append)
    monkeypatch.setattr(jobs, "label_sources", lambda *given: seen.append(given[1:]))
    jobs.main(["label", "out", "a.txt", "b.txt", "--k-max", "20", "--seed", "7", "--silhouette-metric", "euclidean"])
    jobs.main(["label", "out"])
    assert dropped == [spark, spark]
    (files, out, settings), (none, _, plain) = seen
    assert (files, out, none) == (["a.txt", "b.txt"], "out", []) and plain == Settings()
    assert settings == Settings(k_max=20, seed=7, silhouette_metric="euclidean")
