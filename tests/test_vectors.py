"""Vectors, clusters, silhouettes, factors, probes, scores: against NumPy and planted data."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from dialogue_factors.config import Settings
from dialogue_factors.functions import vectors as V
from dialogue_factors.functions.matrices import affine, nearest
from dialogue_factors.operators import embed, encode, kmeans, metrics, silhouette
from dialogue_factors.operators.embed import encode_texts, hashed_tfidf
from dialogue_factors.operators.encode import build_vocabulary, encode_tokens
from dialogue_factors.operators.factors import (
    FactorBasis,
    apply_heads,
    class_means,
    fit_factors,
    heads_table,
    read_heads,
    split_factors,
)
from dialogue_factors.operators.ksweep import score_models, sweep
from dialogue_factors.operators.probe import fit_probe, leakage, predict
from dialogue_factors.operators.reduce import apply_reducer, covariance, fit_reducer, map_2d
from dialogue_factors.operators.silhouette import row_silhouettes, silhouette_exact, silhouette_squared
from dialogue_factors.plans.analyse import analyse
from dialogue_factors.plans.catalog import given_heads


def frame(spark, x, labels=None, partitions=4):
    labels = np.zeros(len(x), int) if labels is None else labels
    rows = [(i, [float(v) for v in row], int(y)) for i, (row, y) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, "vec_id bigint, x array<double>, label int").repartition(partitions)


def blobs(n=250, k=5, dims=8, seed=0):
    rng = np.random.default_rng(seed)
    truth = np.arange(n) % k
    return rng.normal(size=(k, dims))[truth] * 20 + rng.normal(size=(n, dims)), truth


def signal(n=3000, dims=32, classes=6, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    return rng.normal(size=(classes, dims))[y] * 0.6 + rng.normal(size=(n, dims)), y


def brute_silhouette(x, y):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = np.zeros(len(x))
    for i in range(len(x)):
        same = (y == y[i]) & (np.arange(len(x)) != i)
        if same.any():
            a, b = d[i, same].mean(), min(d[i, y == c].mean() for c in set(y) if c != y[i])
            out[i] = (b - a) / max(a, b)
    return out


def test_vector_expressions(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(20, 6)), rng.normal(size=(20, 6))
    df = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist(), i % 6) for i in range(20)], "i int, a array<double>, b array<double>, y int")
    got = df.select(V.dot("a", "b").alias("dot"), V.cosine("a", "b").alias("cos"), V.argmax("a").alias("top"), V.cross_entropy("a", "y").alias("ce"), V.normalize("a").alias("u")).collect()
    logits = np.log(np.exp(a).sum(1)) - a[np.arange(20), np.arange(20) % 6]
    np.testing.assert_allclose([r.dot for r in got], (a * b).sum(1))
    np.testing.assert_allclose([r.cos for r in got], (a * b).sum(1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1))
    np.testing.assert_allclose([r.ce for r in got], logits)
    assert [r.top for r in got] == a.argmax(1).tolist()
    np.testing.assert_allclose(np.linalg.norm([r.u for r in got], axis=1), 1.0)


def test_extremes(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0], [1000.0, 1000.0], 1)], "z array<double>, w array<double>, big array<double>, y int")
    row = df.select(V.cosine("z", "w").alias("c"), V.normalize("z").alias("n"), V.cross_entropy("big", "y").alias("ce"), V.argmax("big").alias("m")).first()
    assert row.c == 0.0 and row.n == [0.0, 0.0] and row.ce == pytest.approx(np.log(2)) and row.m == 0


def test_label_without_logit_is_an_error(spark):
    df = spark.createDataFrame([([1.0, 2.0], 2)], "l array<double>, y int")
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        df.select(V.cross_entropy("l", "y")).collect()


def test_matrix_columns(spark):
    x, _ = blobs(40)
    w, b = np.arange(24).reshape(3, 8) / 7.0, np.array([1.0, 2.0, 3.0])
    rows = frame(spark, x).select("vec_id", affine("x", w, b).alias("z"), nearest("x", x[:4]).alias("c")).orderBy("vec_id").collect()
    np.testing.assert_allclose([r.z for r in rows], x @ w.T + b)
    assert [r.c for r in rows] == ((x[:, None] - x[None, :4]) ** 2).sum(-1).argmin(1).tolist()
    ragged = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "x array<double>").coalesce(1)
    with pytest.raises(Exception, match="differ in length"):
        ragged.select(affine("x", np.ones((1, 1)))).collect()


def test_pca_matches_svd_and_reloads(spark, tmp_path):
    x, _ = signal(200, 10)
    df = frame(spark, x + 5)
    model = fit_reducer(df, "x", 4)
    got = np.array([r.reduced for r in apply_reducer(model, df, "x").orderBy("vec_id").collect()])
    centred = x - x.mean(0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    want = centred @ vt[:4].T
    np.testing.assert_allclose(np.abs(got), np.abs(want), atol=1e-9)
    model.write().overwrite().save(str(tmp_path / "pca"))
    again = apply_reducer(PipelineModel.load(str(tmp_path / "pca")), df, "x").orderBy("vec_id").collect()
    np.testing.assert_array_equal(got, np.array([r.reduced for r in again]))


def test_covariance(spark):
    x, _ = signal(300, 5)
    got = np.zeros((5, 5))
    for r in covariance(frame(spark, x + 100), "x").collect():
        got[r.i, r.j] = r.covariance
    np.testing.assert_allclose(got, np.cov(x.T), atol=1e-10)


def test_map_2d_samples_after_fitting(spark):
    x, y = signal(60, 6)
    chart = map_2d(frame(spark, x, y), ["vec_id"], "label", ["x"], 10)
    assert chart.columns == ["vec_id", "space", "x", "y", "label"] and sorted(r.vec_id for r in chart.collect()) == list(range(10))


def test_planted_clusters_are_found(spark):
    x, truth = blobs()
    df = frame(spark, x, truth)
    for metric in ("squared", "euclidean"):
        scores, models = sweep(df, "vec_id", "x", range(3, 8), replace(Settings(), silhouette_metric=metric, kmeans_starts=3))
        assert scores.orderBy(F.desc("silhouette"), "k").first().k == 5
    pairs = kmeans.assign(df, "x", models[5]).select("label", "cluster_id").distinct().count()
    assert pairs == 5
    again = kmeans.read_centres(kmeans.centres_table(spark, models[5]))
    np.testing.assert_array_equal(again.centres, models[5].centres)
    with pytest.raises(ValueError):
        score_models(df, "vec_id", "x", models, replace(Settings(), silhouette_metric="other"))


def test_updates_match_numpy_and_partitions_do_not_matter(spark):
    x, _ = signal(150, 4)
    begun = [kmeans.Clustering(0, x[:3].copy()), kmeans.Clustering(1, x[3:8].copy())]
    for parts in (1, 6):
        fitted = kmeans.fit(frame(spark, x, partitions=parts), "x", begun, 4)
        for start, model in zip(begun, fitted):
            c = start.centres.copy()
            for _ in range(4):
                label = ((x[:, None] - c) ** 2).sum(-1).argmin(1)
                c = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(len(c))])
            np.testing.assert_allclose(model.centres, c, atol=1e-12)
            assert model.cost == pytest.approx(((x[:, None] - c) ** 2).sum(-1).min(1).sum())
            assert model.counts.sum() == len(x)


def test_empty_centre_stays_and_copies_are_counted(spark):
    x = np.vstack([np.zeros((60, 2)), np.ones((30, 2))])  # two points, many copies
    begun = [kmeans.Clustering(0, np.array([[0.0, 0.0], [1.0, 1.0], [9.0, 9.0]]))]
    model = kmeans.fit(frame(spark, x), "x", begun, 5)[0]
    assert model.counts.tolist() == [60, 30, 0] and model.centres[2].tolist() == [9.0, 9.0] and model.cost == 0
    spread = kmeans.starts(frame(spark, x), "vec_id", "x", [4], replace(Settings(), kmeans_starts=2))
    assert all(m.centres.shape == (4, 2) for m in spread)


@pytest.mark.parametrize("block_rows", [7, 40, 4096])
def test_exact_silhouette_in_blocks(spark, block_rows):
    x, truth = blobs(120, 4, 3, seed=5)
    x[:40] = x[0]  # a third of the rows are copies
    truth[0] = 9  # a lone member
    df = frame(spark, x, truth).withColumn("half", F.col("label") % 2)
    rows = row_silhouettes(df, "vec_id", "x", ["label", "half"], block_rows).orderBy("vec_id").collect()
    np.testing.assert_allclose([r.s[0] for r in rows], brute_silhouette(x, truth), atol=1e-6)
    np.testing.assert_allclose([r.s[1] for r in rows], brute_silhouette(x, truth % 2), atol=1e-6)
    means = {r.labelling: r.silhouette for r in silhouette_exact(df, "vec_id", "x", ["label", "half"], block_rows).collect()}
    assert means[0] == pytest.approx(brute_silhouette(x, truth).mean(), abs=1e-6) and len(means) == 2


def test_rows_of_the_exact_silhouette_are_sent_a_bounded_number_of_times():
    # Blocks are copies of each row: their number stays until a block fills a task's memory.
    assert [silhouette.count_blocks(n) for n in (0, 1, 2048, 2049, 51_282, 500_000)] == [1, 1, 1, 2, 16, 16]
    assert silhouette.count_blocks(615_000) == 19  # 151 with blocks of 4,096 rows


def test_exact_silhouette_in_tiles(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(60, 3))
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, x array<double>, label int")
    run = lambda rows: np.array([r.s[0] for r in row_silhouettes(df, "id", "x", ["label"], rows).orderBy("id").collect()])
    whole = run(1000)
    monkeypatch.setattr(silhouette, "TILE_ROWS", 7)
    assert np.allclose(run(1000), whole) and np.allclose(run(20), whole)


def test_squared_silhouette_equals_the_evaluator(spark):
    x, truth = signal(200, 6)
    df = frame(spark, x, truth)
    rows = silhouette_squared(df, "x", "label").collect()
    ours = sum(r.n * r.silhouette for r in rows) / 200
    theirs = ClusteringEvaluator(predictionCol="label", featuresCol="f").evaluate(df.withColumn("f", array_to_vector("x")))
    assert ours == pytest.approx(theirs)


def test_factors_on_planted_signal(spark):
    x, y = signal()
    df = frame(spark, x, y)
    basis = fit_factors(df, "x", "label")
    parts = split_factors(df, "x", basis).persist()
    means = np.array([r["mean"] for r in class_means(parts, "z_c", "label").collect()])
    np.testing.assert_allclose(means, np.tile(x.mean(0), (6, 1)), atol=1e-9)
    some = parts.limit(5).collect()
    for r in some:
        np.testing.assert_allclose(np.array(r.z_c) + basis.basis.T @ np.array(r.z_p), r.x, atol=1e-9)
    accuracy = {r.space: r.accuracy for r in leakage(parts, ["vec_id"], "label", ["x", "z_p", "z_c"]).collect()}
    majority = np.bincount(y).max() / len(y)
    assert accuracy["x"] > 0.85 and accuracy["z_p"] > 0.85 and accuracy["z_c"] < majority + 0.06
    again = FactorBasis.from_table(basis.to_table(spark))
    np.testing.assert_array_equal(again.basis, basis.basis)
    more = fit_factors(df, "x", "label", passes=2)
    np.testing.assert_allclose(more.basis @ more.basis.T, np.eye(len(more.basis)), atol=1e-9)
    grouped = leakage(parts.withColumn("g", F.col("vec_id") % 50), ["vec_id"], "label", ["z_p"], group="g").first()
    assert grouped.n_train + grouped.n_test == 3000
    parts.unpersist()


def test_analysis_end_to_end(spark):
    x, y = signal(1200, 16)
    df = frame(spark, x, y)
    result = analyse(df.where("vec_id < 800"), df.where("vec_id >= 800"), ["vec_id"], "x", "label")
    assert result.accuracy.first().n == 400 and result.accuracy.first().accuracy > 0.6
    assert result.confusion.agg(F.sum("n")).first()[0] == 400
    assert {r.space for r in result.leakage.collect()} == {"x", "z_p", "z_c"}
    assert result.chart.count() == 800 and result.persona_map.count() == 400


def test_heads_are_kept_per_epoch(spark, tmp_path):
    heads = {e: given_heads(6, 4 + e, 3) for e in (0, 1)}
    path = str(tmp_path / "heads")
    for epoch, h in heads.items():
        heads_table(spark, h, epoch).write.mode("append").partitionBy("epoch").parquet(path)
    again = read_heads(spark.read.parquet(path), 1)
    for name in ("persona", "content", "classifier", "adversary"):
        for kept, was in zip(getattr(again, name), getattr(heads[1], name)):
            np.testing.assert_array_equal(kept, was)
    with pytest.raises(ValueError):
        read_heads(spark.read.parquet(path), 7)
    x, y = signal(20, 6)
    scored = apply_heads(frame(spark, x, y), "x", again).orderBy("vec_id").collect()
    z = x @ again.persona[0].T + again.persona[1]
    np.testing.assert_allclose([r.logits for r in scored], z @ again.classifier[0].T + again.classifier[1])


def test_probe_reloads(spark, tmp_path):
    x, y = signal(200, 5, 3)
    df = frame(spark, x, y)
    model = fit_probe(df, "x", "label")
    model.write().overwrite().save(str(tmp_path / "probe"))
    again = LogisticRegressionModel.load(str(tmp_path / "probe"))
    assert predict(again, df, "x").orderBy("vec_id").collect() == predict(model, df, "x").orderBy("vec_id").collect()


def test_scores(spark):
    empty = spark.createDataFrame([], "prediction int, label int")
    assert tuple(metrics.accuracy(empty).first()) == (0, None)
    rows = spark.createDataFrame([(0, 0), (1, 0), (4, 2)], "prediction int, label int")
    grid = {(r.label, r.prediction): r.n for r in metrics.confusion_matrix(rows).collect()}
    assert len(grid) == 16 and grid[0, 1] == 1 and grid[2, 4] == 1 and grid[4, 4] == 0
    rng = np.random.default_rng(2)
    logits, adv, z_p, z_c, y = rng.normal(size=(30, 4)), rng.normal(size=(30, 4)), rng.normal(size=(30, 5)), rng.normal(size=(30, 5)), rng.integers(0, 4, 30)
    df = spark.createDataFrame([(e, logits[i].tolist(), adv[i].tolist(), z_p[i].tolist(), z_c[i].tolist(), int(y[i])) for i in range(30) for e in (4, 5)], "epoch int, logits array<double>, adv_logits array<double>, z_p array<double>, z_c array<double>, label int")
    nll = lambda l: (np.log(np.exp(l).sum(1)) - l[np.arange(30), y]).mean()
    cos2 = (((z_p * z_c).sum(1) / np.linalg.norm(z_p, axis=1) / np.linalg.norm(z_c, axis=1)) ** 2).mean()
    terms = metrics.loss_terms(df).first()
    assert terms.total == pytest.approx(nll(logits) + 0.1 * nll(adv) + 0.005 * cos2)
    history = {r.epoch: r for r in metrics.epoch_history(df).collect()}
    assert history[4].loss == pytest.approx(nll(logits))
    assert history[5].loss == pytest.approx(nll(logits) + 0.1 * 0.5 * nll(adv) + 0.005 * cos2)
    assert history[4].accuracy == pytest.approx((logits.argmax(1) == y).mean())
    assert metrics.history_table(metrics.epoch_history(df)).count() == 4


def test_probe_predicts_and_reports_logits(spark):
    x, y = signal(300, 8, 3)
    df = frame(spark, x, y)
    model = fit_probe(df, "x", "label")
    row = predict(model, df, "x").first()
    assert row.prediction == int(np.argmax(row.logits)) and len(row.logits) == 3


def test_embedding(spark):
    texts = spark.createDataFrame([(0, "Cats cats dogs"), (1, "dogs ski"), (2, None), (3, "")], "k bigint, text string")
    rows = {r.k: np.array(r.embedding) for r in hashed_tfidf(texts, "k").collect()}
    assert rows[0].shape == (384,) and np.linalg.norm(rows[0]) == pytest.approx(1.0)
    assert not rows[2].any() and not rows[3].any() and rows[0].max() > 0.8
    parts = spark.createDataFrame([(0, 2, "Cats cats"), (0, 2, "dogs"), (1, 1, "dogs ski"), (2, 1, ""), (3, 1, "")], "k bigint, parts bigint, text string")
    merged = {r.k: np.array(r.embedding) for r in hashed_tfidf(parts, "k").collect()}
    np.testing.assert_allclose(merged[0], rows[0])
    plugged = encode_texts(texts.na.fill(""), "k", "text", lambda: lambda batch: np.array([[len(t), 1.0] for t in batch]))
    assert {r.k: r.embedding for r in plugged.collect()}[1] == [8.0, 1.0]


@pytest.mark.parametrize("module", [embed, encode])
def test_words_are_laid_out_in_chunks(spark, monkeypatch, module):
    texts = [f"a b{i % 3} " * 20_000 for i in range(60)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    settings = replace(Settings(), text_dims=16, max_tokens=8)
    run = lambda: [r.asDict() for r in (hashed_tfidf(df, "id", settings=settings) if module is embed else encode_tokens(df, settings=settings)).orderBy("id").collect()]
    whole, laid_out = run(), module.token_lists

    def bounded(part):
        assert len(part) == 1 or part.nbytes < 5 << 20
        return laid_out(part)

    monkeypatch.setattr(module, "token_lists", bounded)
    assert run() == whole


def test_token_encoding(spark):
    long = "w" * 100
    texts = spark.createDataFrame([(0, "b a b"), (1, "c " + long), (2, ""), (3, "a " * 90), (4, long)], "k int, text string")
    small = replace(Settings(), vocabulary_size=3)
    words = build_vocabulary(texts, "text", small).orderBy("id").collect()
    assert [(r.token, r.n, r.id) for r in words] == [("a", 91, 4), ("b", 2, 5), (long, 2, 6)]
    rows = {r.k: r for r in encode_tokens(texts, "text", settings=small).collect()}
    assert rows[0].input_ids[:6] == [2, 5, 4, 5, 3, 0] and len(rows[0].input_ids) == 64
    assert rows[1].input_ids[:4] == [2, 1, 6, 3] and rows[2].input_ids[:3] == [2, 3, 0]
    assert sum(rows[3].attention_mask) == 64 and rows[3].input_ids[-1] == 3
    assert sum(rows[4].attention_mask) == 3


def test_far_data_lose_no_digits(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 1.0, (60, 3)) for c in (0.0, 6.0, -7.0)])
    labels = np.repeat([0, 1, 2], 60)
    measured = []
    for shift in (0.0, 1e7):
        rows = frame(spark, x + shift, labels)
        begun = [kmeans.Clustering(0, x[[0, 60, 120]] + shift)]
        model = kmeans.fit(rows, "x", begun, 5)[0]
        squared = {r.label: r.silhouette for r in silhouette_squared(rows, "x", "label").collect()}
        exact = silhouette_exact(rows, "vec_id", "x", ["label"]).first().silhouette
        swept = score_models(rows, "vec_id", "x", {3: model}).first().silhouette
        measured.append([model.cost, exact, swept, *(squared[i] for i in range(3))])
        found = {r.vec_id: r.cluster_id for r in kmeans.assign(rows, "x", model).collect()}
        assert [found[i] for i in range(180)] == labels.tolist()
    np.testing.assert_allclose(measured[1], measured[0], rtol=1e-6)


def test_any_row_may_become_a_centre(spark):
    """A lone far row among many is drawn as a start, and the draw repeats."""
    x = np.zeros((5000, 2))
    x[:, 0] = np.arange(5000) % 7 * 1e-3
    x[4321] = 500.0
    settings = replace(Settings(), kmeans_starts=2)
    one = kmeans.starts(frame(spark, x), "vec_id", "x", [4], settings)
    two = kmeans.starts(frame(spark, x, partitions=7), "vec_id", "x", [4], settings)
    for a, b in zip(one, two):
        assert (a.centres == 500.0).all(axis=1).any()
        np.testing.assert_array_equal(a.centres, b.centres)


def test_encoder_gives_one_row_per_key(spark):
    texts = spark.createDataFrame([(1, 0, "aaaa"), (1, 1, "bb"), (2, 0, "c"), (3, 0, None)], "k long, part long, text string")
    plugged = encode_texts(texts, "k", "text", lambda: lambda batch: np.array([[len(t or ""), 1.0] for t in batch]))
    found = {r.k: r.embedding for r in plugged.collect()}
    assert sorted(found) == [1, 2, 3]
    np.testing.assert_allclose([found[1], found[2], found[3]], [[20 / 6, 1.0], [1.0, 1.0], [0.0, 1.0]])
