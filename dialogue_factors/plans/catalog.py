"""The registered queries: every operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dialogue_factors.config import FIELD_SEPARATOR, PERSONA_MARKER, Settings
from dialogue_factors.functions.vectors import argmax, dot, doubles
from dialogue_factors.operators import kmeans, metrics, reports, splits
from dialogue_factors.operators.embed import hashed_tfidf
from dialogue_factors.operators.encode import encode_tokens
from dialogue_factors.operators.episodes import (
    first_fact_personas,
    number_speakers,
    parse_dialogue,
    persona_texts,
    speaker_records,
)
from dialogue_factors.operators.examples import explode_records, label_utterances, seeded_shuffle
from dialogue_factors.operators.factors import LinearHeads, apply_heads, class_means, fit_factors, split_factors
from dialogue_factors.operators.ksweep import score_models, sweep
from dialogue_factors.operators.labels import attach_by_position, attach_labels, label_mismatch_report
from dialogue_factors.operators.lines import (
    classify_lines,
    is_dialogue,
    mentions_persona,
    number_lines,
    persona_fact_between,
)
from dialogue_factors.operators.order import place_in_order
from dialogue_factors.operators.probe import leakage, nearest_mean_predictions
from dialogue_factors.operators.reduce import covariance, map_2d, reduce_vectors
from dialogue_factors.operators.silhouette import row_silhouettes, silhouette_squared
from dialogue_factors.operators.word_vectors import count_pairs, encode_with_words, fit_word_vectors, positive_pmi, word_table
from dialogue_factors.plans.label_dialogue import label_by_position, label_lines
from dialogue_factors.session import materialize, scratch_path
from dialogue_factors.sources.dialogue_lines import read_lines
from dialogue_factors.sources.models import part, read_model, save_model
from dialogue_factors.sources.records import place_cluster_records, read_examples, read_k_scores, write_examples, write_k_scores
from dialogue_factors.streaming.episodes import stream_episodes, write_episodes

SETTINGS = Settings()
# Settings of the registered clustering queries: seeded starts and a fixed number
# of updates, which SQL can repeat step by step.
STEPS = replace(SETTINGS, kmeans_max_iter=10, kmeans_tol=0.0)
FEATURE_DIMS = 128


def table(spark: SparkSession, folder: str, name: str, *columns: str | Column) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def rounded(c: str | Column, places: int = 6) -> Column:
    value = F.round(F.col(c) if isinstance(c, str) else c, places) + 0.0
    return value.alias(c) if isinstance(c, str) else value


# ---- views of the tables -------------------------------------------------------


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings", "vec_id", doubles("embedding").alias("x"), "label")


def utterances(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").where("role <> 'system'").select(
        F.col("conv_id").alias("speaker_id"), F.col("turn").alias("pos"), "text"
    )


def persona_facts(spark: SparkSession, folder: str) -> DataFrame:
    """System text where a conversation has some, else its user turns."""
    rows = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("speaker_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("fact")
    )
    system = rows.where("role = 'system'")
    users = rows.where("role = 'user'").join(system.select("speaker_id").distinct(), "speaker_id", "left_anti")
    return system.unionByName(users).drop("role")


def speaker_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings", F.col("vec_id").alias("speaker_id"), "label")


def examples(spark: SparkSession, folder: str) -> DataFrame:
    labelled = label_utterances(utterances(spark, folder), speaker_labels(spark, folder))
    return labelled.withColumn("split", splits.hash_split("speaker_id"))


def speaker_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations", F.col("conv_id").alias("speaker_id")).distinct()


def rendered_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered dialogue lines `(conv_id, turn, kind, line)` told from conversations.

    Turn 0 becomes the persona line; each user turn followed by an assistant turn
    becomes a dialogue line, and one without reply a line without a second field. Replies
    are found by an equi-join on the turn.
    """
    turns = table(spark, folder, "conversations", "conv_id", "turn", "role", F.regexp_replace("text", r"[ \t\r\n\f]+", " ").alias("text"))
    persona = turns.where("turn = 0").select(
        "conv_id", "turn", F.lit(0).alias("kind"), F.concat(F.lit(f"1 {PERSONA_MARKER} "), "text").alias("line")
    )
    replies = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    dialogue = turns.where("role = 'user'").join(replies, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.lit(1).alias("kind"),
        F.concat(
            (F.col("turn") + 2).cast("string"), F.lit(" "), "text", F.coalesce(F.concat(F.lit(FIELD_SEPARATOR), "reply"), F.lit(""))
        ).alias("line"),
    )
    return persona.unionByName(dialogue)


def dialogue_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = rendered_lines(spark, folder).withColumn("source", F.lit(0))
    return place_in_order(lines, "source", "conv_id", "turn", "kind")


# ---- lines and episodes --------------------------------------------------------


def clean_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = documents(spark, folder).select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    return number_lines(lines).select("doc_id", "ln", "number", "rest")


def line_kinds(spark: SparkSession, folder: str) -> DataFrame:
    kinds = classify_lines(number_lines(rendered_lines(spark, folder)))
    return kinds.select(
        "conv_id", "turn", "kind", "number", "is_start", "is_persona", mentions_persona().alias("mentions_persona"),
        "fact", F.when(mentions_persona(), persona_fact_between()).alias("fact_between"),
        "is_dialogue", is_dialogue(exactly_two=True).alias("exactly_two"), "said", "reply",
    )


def _flat_records(records: DataFrame) -> DataFrame:
    return records.select(
        "speaker_id", "part", "persona_text", F.array_join("utterances", FIELD_SEPARATOR).alias("utterances"),
        F.size("utterances").cast("bigint").alias("n_utterances"),
    )


def episodes(spark: SparkSession, folder: str) -> DataFrame:
    return _flat_records(speaker_records(parse_dialogue(dialogue_lines(spark, folder))))


def streamed_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """Episodes of eight sources from a stream: the lines arrive in three slices, and each
    time a new query goes on from the checkpoint of the one before."""
    ordered = rendered_lines(spark, folder).select(
        (F.col("conv_id") % 8).cast("string").alias("source"), F.col("conv_id").alias("part"), F.lit("").alias("file"),
        (F.col("turn") * 2 + F.col("kind")).alias("start"), F.lit(0).cast("bigint").alias("n"), "line",
    )
    lines = materialize(ordered, "lines")
    bounds = lines.agg(F.percentile_approx("part", [1 / 3, 2 / 3])).first()[0] or [0, 0]
    after = lines.groupBy("source").agg(
        (F.max("part") + 1).alias("part"), F.lit("").alias("file"), F.lit(0).cast("bigint").alias("start"),
        F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("string").alias("line"),
    )
    arriving, out, state = (scratch_path(spark, name) for name in ("arriving", "streamed", "stream-state"))
    slices = [F.col("part") <= bounds[0], (F.col("part") > bounds[0]) & (F.col("part") <= bounds[1]), F.col("part") > bounds[1]]
    for rows in [*(lines.where(c) for c in slices[:2]), lines.where(slices[2]).unionByName(after)]:
        rows.write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(lines.schema).parquet(arriving)
        write_episodes(stream_episodes(stream), out, state).awaitTermination()
    records = spark.read.parquet(out)
    return records.select(
        "source", "episode", "part", "persona_text", F.array_join("utterances", FIELD_SEPARATOR).alias("utterances"),
        F.size("utterances").cast("bigint").alias("n_utterances"),
    )


def dialogue_files(spark: SparkSession, folder: str) -> DataFrame:
    """As `episodes`, but through text files: a folder of parts in order is one source."""
    path = scratch_path(spark, "lines")
    order = ("conv_id", "turn", "kind")
    rendered_lines(spark, folder).repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)
    return _flat_records(speaker_records(parse_dialogue(read_lines(spark, [path]))))


def source_union(spark: SparkSession, folder: str) -> DataFrame:
    """Two sources, conversations with a system turn before those without."""
    opening = table(spark, folder, "conversations").where("turn = 0").select(
        "conv_id", F.when(F.col("role") == "system", 0).otherwise(1).alias("source")
    )
    lines = rendered_lines(spark, folder).join(opening, "conv_id")
    both = lines.where("source = 0").unionByName(lines.where("source = 1"))
    dialogue = parse_dialogue(place_in_order(both, "source", "conv_id", "turn", "kind"))
    counted = dialogue.utterances.groupBy("speaker_id").agg(F.count(F.lit(1)).alias("n_utterances"))
    return number_speakers(dialogue.speakers).select("speaker_id", "position", "source").join(counted, "speaker_id")


def persona_only(spark: SparkSession, folder: str) -> DataFrame:
    """Personas of a corpus in which only conversations opened by a system turn go on with
    dialogue; the others are persona text alone, and speakers all the same."""
    opening = table(spark, folder, "conversations").where("turn = 0 and role = 'system'").select("conv_id").distinct()
    lines = rendered_lines(spark, folder)
    kept = lines.where("kind = 0").unionByName(lines.where("kind = 1").join(opening, "conv_id", "left_semi"))
    placed = place_in_order(kept.withColumn("source", F.lit(0)), "source", "conv_id", "turn", "kind")
    dialogue = parse_dialogue(placed, require_dialogue=False)
    counted = dialogue.utterances.groupBy("speaker_id").agg(F.count(F.lit(1)).alias("n"))
    personas = persona_texts(dialogue.facts).join(counted, "speaker_id", "left")
    return personas.select("speaker_id", "part", "persona_text", F.coalesce("n", F.lit(0)).alias("n_utterances"))


def cluster_file_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Utterances of parsed episodes, labelled from files of cluster records by their place."""
    path = scratch_path(spark, "clusters")
    records = table(spark, folder, "embeddings", "vec_id", F.lit("").alias("persona_text"), F.col("label").alias("cluster_id"))
    records.repartitionByRange("vec_id").sortWithinPartitions("vec_id").select("persona_text", "cluster_id").write.json(path)
    dialogue = parse_dialogue(dialogue_lines(spark, folder))
    labelled = label_by_position(dialogue, place_cluster_records(spark, path, multi_line=False))
    return labelled.examples.select("speaker_id", "pos", "text", "label", "split")


def epoch_batch_means(spark: SparkSession, folder: str) -> DataFrame:
    epochs = F.explode(F.sequence(F.lit(0), F.lit(SETTINGS.epochs - 1))).alias("epoch")
    means = metrics.epoch_batches(scored_rows(spark, folder).select("*", epochs), "vec_id")
    return means.select("epoch", "n_batches", rounded("loss"), rounded("accuracy"))


def first_facts(spark: SparkSession, folder: str) -> DataFrame:
    return first_fact_personas(dialogue_lines(spark, folder)).select("island", "part", "persona_text")


def personas(spark: SparkSession, folder: str) -> DataFrame:
    return persona_texts(persona_facts(spark, folder))


# ---- labels, splits, counts ----------------------------------------------------


def flatten_utterances(spark: SparkSession, folder: str) -> DataFrame:
    return examples(spark, folder).select("speaker_id", "pos", "text", "label")


def flatten_records(spark: SparkSession, folder: str) -> DataFrame:
    """Nested records of parsed episodes, labelled by the speakers' position, back to rows."""
    dialogue = parse_dialogue(dialogue_lines(spark, folder))
    labels = table(spark, folder, "embeddings", F.col("vec_id").alias("position"), F.col("label").alias("cluster_id"))
    positions = attach_labels(number_speakers(dialogue.speakers), labels, "position").select("speaker_id", "cluster_id")
    records = attach_labels(speaker_records(dialogue), positions)
    return explode_records(records).select("speaker_id", "pos", "text", "label")


def attach_positions(spark: SparkSession, folder: str) -> DataFrame:
    left = speaker_ids(spark, folder)
    right = table(spark, folder, "embeddings", "vec_id", "label")
    return attach_by_position(left, ["speaker_id"], right, ["vec_id"]).select("position", "speaker_id", "vec_id", "label")


def mismatch_report(spark: SparkSession, folder: str) -> DataFrame:
    return label_mismatch_report(speaker_ids(spark, folder), speaker_labels(spark, folder), "speaker_id")


def speaker_split_exact(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_exact(speaker_ids(spark, folder))


def speaker_split_hash(spark: SparkSession, folder: str) -> DataFrame:
    return speaker_ids(spark, folder).withColumn("split", splits.hash_split("speaker_id"))


def split_overlap(spark: SparkSession, folder: str) -> DataFrame:
    split = speaker_split_exact(spark, folder).withColumn("label", F.lit(0))
    return splits.split_overlap(label_utterances(utterances(spark, folder), split))


def split_overlap_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Speakers met in two splits when rows are split one by one: the leak that a split by
    speaker avoids."""
    rows = utterances(spark, folder).withColumn("row_key", F.concat_ws(":", F.col("speaker_id").cast("string"), F.col("pos").cast("string")))
    return splits.split_overlap(rows.select("speaker_id", splits.hash_split("row_key").alias("split")))


def class_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return reports.class_distribution(examples(spark, folder))


def cluster_sizes(spark: SparkSession, folder: str) -> DataFrame:
    labelled = attach_labels(speaker_ids(spark, folder), speaker_labels(spark, folder))
    return reports.cluster_sizes(labelled.withColumnRenamed("label", "cluster_id"))


def split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return reports.split_sizes(examples(spark, folder))


def json_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "examples-json")
    write_examples(examples(spark, folder), path, "json")
    return read_examples(spark, path).select("speaker_id", "pos", "text", "label", "split")


def shuffled(spark: SparkSession, folder: str) -> DataFrame:
    return seeded_shuffle(examples(spark, folder), 0, "speaker_id", "pos").select("speaker_id", "pos", "rank")


# ---- scores --------------------------------------------------------------------


def scored_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Fixture outputs cut from the vectors: logits, adversary logits, z_p, z_c."""
    return vectors(spark, folder).select(
        "vec_id", "label", F.slice("x", 1, 10).alias("logits"), F.slice("x", 33, 10).alias("adv_logits"),
        F.slice("x", 1, 32).alias("z_p"), F.slice("x", 33, 32).alias("z_c"),
    )


def accuracy(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored_rows(spark, folder).withColumn("prediction", argmax("logits"))
    return metrics.accuracy(rows).select("n", rounded("accuracy"))


def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion_matrix(scored_rows(spark, folder).withColumn("prediction", argmax("logits")))


def loss_terms(spark: SparkSession, folder: str) -> DataFrame:
    terms = metrics.loss_terms(scored_rows(spark, folder))
    return terms.select(*(rounded(c) for c in terms.columns))


def epoch_history(spark: SparkSession, folder: str) -> DataFrame:
    """Every row once per epoch, its logits growing with the epoch."""
    epochs = F.explode(F.sequence(F.lit(0), F.lit(SETTINGS.epochs - 1))).alias("epoch")
    grown = lambda c: F.transform(c, lambda v: v * (1 + F.col("epoch") / SETTINGS.epochs)).alias(c)
    rows = scored_rows(spark, folder).select("*", epochs).select(
        "epoch", "label", "z_p", "z_c", grown("logits"), grown("adv_logits")
    )
    return metrics.history_table(metrics.epoch_history(rows)).select("epoch", "metric", rounded("value"))


def given_heads(dims: int, inner: int, classes: int) -> LinearHeads:
    """Weights from a formula, for scoring with heads trained elsewhere."""

    def head(out: int, width: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.indices((out, width))
        return ((i * 7 + j * 3 + shift) % 11 - 5) / 10.0, (np.arange(out) % 3 - 1) / 10.0

    return LinearHeads(head(inner, dims, 0), head(inner, dims, 4), head(classes, inner, 0), head(classes, inner, 4))


def linear_heads(spark: SparkSession, folder: str) -> DataFrame:
    scored = apply_heads(vectors(spark, folder), "x", given_heads(64, 16, 10))
    heads = F.array(*(
        F.struct(F.lit(name).alias("head"), F.col(name).alias("v")) for name in ("z_p", "z_c", "logits", "adv_logits")
    ))
    return scored.select("vec_id", F.inline(heads)).select("vec_id", "head", F.posexplode("v").alias("i", "value")).select(
        "vec_id", "head", "i", rounded("value")
    )


# ---- vectors -------------------------------------------------------------------


def tfidf(spark: SparkSession, folder: str) -> DataFrame:
    embedded = hashed_tfidf(documents(spark, folder), "doc_id", dims=FEATURE_DIMS)
    return embedded.select("doc_id", F.posexplode("embedding").alias("bucket", "weight")).where("weight <> 0").select(
        "doc_id", "bucket", rounded("weight")
    )


def word_pmi(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of the 1,000 most frequent words that lie near each other more than by chance."""
    texts, settings = documents(spark, folder), replace(SETTINGS, word_vocabulary=1000)
    words = word_table(texts, settings=settings)
    pairs = materialize(count_pairs(texts, words, settings=settings), "pairs")
    name = lambda c: F.broadcast(words.select(F.col("word").alias(c), F.col("token").alias(f"{c}_token")))
    named = positive_pmi(pairs).join(name("word"), "word").join(name("context"), "context")
    return named.select(F.col("word_token").alias("word"), F.col("context_token").alias("context"), "n", rounded("pmi"))


def corpus_encoder(spark: SparkSession, folder: str) -> DataFrame:
    texts = documents(spark, folder)
    return encode_with_words(texts, "doc_id", fit_word_vectors(texts))


def token_encoding(spark: SparkSession, folder: str) -> DataFrame:
    encoded = encode_tokens(documents(spark, folder))
    flat = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ").alias(c)
    return encoded.select("doc_id", flat("input_ids"), flat("attention_mask"))


def covariance_table(spark: SparkSession, folder: str) -> DataFrame:
    return covariance(vectors(spark, folder), "x").select("i", "j", rounded("covariance"))


def pca_reduce(spark: SparkSession, folder: str) -> DataFrame:
    reduced = reduce_vectors(vectors(spark, folder), "x", 16)
    return reduced.select("vec_id", F.posexplode("reduced").alias("component", "value")).select("vec_id", "component", rounded("value"))


def pca_rotation(spark: SparkSession, folder: str) -> DataFrame:
    """All components keep the length of the centred vectors, whatever their signs."""
    rotated = reduce_vectors(vectors(spark, folder), "x", 64)
    return rotated.select("vec_id", rounded(dot("reduced", "reduced")).alias("squared_length"))


def chart_map(spark: SparkSession, folder: str) -> DataFrame:
    rows = vectors(spark, folder)
    parts = materialize(split_factors(rows, "x", fit_factors(rows, "x", "label")), "parts")
    chart = map_2d(parts, ["vec_id"], "label", ["x", "z_p", "z_c"])
    return chart.select("vec_id", "space", rounded("x"), rounded("y"), "label")


def chart_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The head of the rows is what this operator returns."""
    return reports.chart_sample(table(spark, folder, "embeddings", "vec_id", "label"), 300, "vec_id")


def nearest_centroid(spark: SparkSession, folder: str) -> DataFrame:
    rows = vectors(spark, folder)
    return nearest_mean_predictions(rows, rows, "x", "label").select("vec_id", F.col("prediction").alias("cluster_id"))


def model_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Class means kept as two versions of a run, the older in reverse order, and read back:
    the nearest mean by the current version and by the older epoch."""
    rows, store = vectors(spark, folder), scratch_path(spark, "models")
    means = np.array([r["mean"] for r in class_means(rows, "x", "label").orderBy("label").collect()])
    for epoch, centres in enumerate((means[::-1], means)):
        save_model(spark, store, "means", {"centres": part(centres), "mean": part(means.mean(axis=0))}, epoch)
    current, older = (kmeans.nearest("x", read_model(spark, store, "means", epoch)["centres"][0]) for epoch in (None, 0))
    return rows.select("vec_id", current.alias("cluster_id"), older.alias("older_id"))


def kmeans_fixed_init(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialize(vectors(spark, folder), "vectors")
    begun = kmeans.starts(rows, "vec_id", "x", [5], replace(SETTINGS, kmeans_starts=1), spread=False)
    model = kmeans.fit(rows, "x", begun, 3)[0]
    return kmeans.assign(rows, "x", model).select("vec_id", "cluster_id")


def kmeans_best_of_n(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialize(vectors(spark, folder), "vectors")
    begun = kmeans.starts(rows, "vec_id", "x", [SETTINGS.classes], STEPS, spread=False)
    fitted = kmeans.fit(rows, "x", begun, STEPS.kmeans_max_iter)
    return kmeans.assign(rows, "x", kmeans.best_of_starts(fitted)[SETTINGS.classes]).select("vec_id", "cluster_id")


def k_sweep(spark: SparkSession, folder: str) -> DataFrame:
    scores, _ = sweep(vectors(spark, folder), "vec_id", "x", settings=STEPS, spread=False)
    path = scratch_path(spark, "k-scores")
    write_k_scores(scores, path)
    return read_k_scores(spark, path).select("k", rounded("silhouette"))


def best_k(spark: SparkSession, folder: str) -> DataFrame:
    """Exact silhouette of one seeded start and three updates per k."""
    chosen = replace(SETTINGS, kmeans_starts=1, silhouette_metric="euclidean")
    rows = materialize(vectors(spark, folder), "vectors")
    begun = kmeans.starts(rows, "vec_id", "x", range(chosen.k_min, chosen.k_max + 1), chosen, spread=False)
    models = {m.k: m for m in kmeans.fit(rows, "x", begun, 3)}
    return reports.best_k(score_models(rows, "vec_id", "x", models, chosen)).select("k", rounded("silhouette"))


def silhouette_exact(spark: SparkSession, folder: str) -> DataFrame:
    scored = row_silhouettes(vectors(spark, folder), "vec_id", "x", ["label"])
    return scored.select("vec_id", rounded(F.get("s", F.lit(0))).alias("silhouette"))


def silhouette_linear(spark: SparkSession, folder: str) -> DataFrame:
    return silhouette_squared(vectors(spark, folder), "x", "label").select("label", "n", rounded("silhouette"))


# ---- factors and probes --------------------------------------------------------


def factor_split(spark: SparkSession, folder: str) -> DataFrame:
    """Class means of the label-free part: equal to the overall mean in every class."""
    rows = vectors(spark, folder)
    parts = split_factors(rows, "x", fit_factors(rows, "x", "label"))
    return class_means(parts, "z_c", "label").select("label", F.posexplode("mean").alias("i", "mean")).select(
        "label", "i", rounded("mean")
    )


def factor_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Both parts of every vector: their squared lengths add up to that of the centred
    vector, and what was taken away has its full share along the mean of the own class."""
    rows = vectors(spark, folder)
    factors = fit_factors(rows, "x", "label")
    means = class_means(rows, "x", "label").select("label", F.col("mean").alias("own"))
    centre = F.lit([float(v) for v in factors.mean])
    minus = lambda a, b: F.zip_with(a, b, lambda p, q: p - q)
    parts = split_factors(rows, "x", factors).join(means, "label").select(
        "vec_id", "z_p", minus("z_c", centre).alias("rest"), minus("x", "z_c").alias("taken"), minus("own", centre).alias("own")
    )
    return parts.select(
        "vec_id", F.size("z_p").alias("n_factors"), rounded(dot("z_p", "z_p") + dot("rest", "rest")).alias("squared_length"),
        rounded(dot("taken", "own")).alias("along_own"),
    )


def _factored(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of every vector, the basis fitted without the rows that test the probe."""
    rows = vectors(spark, folder)
    basis = fit_factors(rows.where(~splits.hash_holdout("vec_id")), "x", "label")
    return materialize(split_factors(rows, "x", basis), "parts")  # the probes read them several times


def persona_probe(spark: SparkSession, folder: str) -> DataFrame:
    return leakage(_factored(spark, folder), ["vec_id"], "label", ["z_p"])


def leakage_probe(spark: SparkSession, folder: str) -> DataFrame:
    return leakage(_factored(spark, folder), ["vec_id"], "label", ["x", "z_p", "z_c"])


def leakage_nearest_mean(spark: SparkSession, folder: str) -> DataFrame:
    held = vectors(spark, folder).withColumn("held", splits.hash_holdout("vec_id"))
    test = nearest_mean_predictions(held.where(~F.col("held")), held.where("held"), "x", "label")
    return metrics.accuracy(test).select("n", rounded("accuracy"))


def labelled_dialogue(spark: SparkSession, folder: str) -> DataFrame:
    """End to end: lines, episodes, vectors, clusters, splits, utterances, counts."""
    return reports.class_distribution(label_lines(dialogue_lines(spark, folder)).examples)


def labelled_split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """End to end again, counted by split alone: no utterance is lost on the way."""
    return reports.split_sizes(label_lines(dialogue_lines(spark, folder)).examples)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "clean_lines": clean_lines,
    "line_kinds": line_kinds,
    "episodes": episodes,
    "streamed_episodes": streamed_episodes,
    "dialogue_files": dialogue_files,
    "source_union": source_union,
    "first_fact_personas": first_facts,
    "persona_texts": personas,
    "flatten_utterances": flatten_utterances,
    "flatten_records": flatten_records,
    "attach_labels": attach_positions,
    "label_mismatch_report": mismatch_report,
    "speaker_split_exact": speaker_split_exact,
    "speaker_split_hash": speaker_split_hash,
    "split_overlap": split_overlap,
    "split_overlap_rows": split_overlap_rows,
    "class_distribution": class_distribution,
    "cluster_sizes": cluster_sizes,
    "split_sizes": split_sizes,
    "json_roundtrip": json_roundtrip,
    "seeded_shuffle": shuffled,
    "accuracy": accuracy,
    "confusion_matrix": confusion_matrix,
    "loss_terms": loss_terms,
    "epoch_history": epoch_history,
    "linear_heads": linear_heads,
    "covariance": covariance_table,
    "pca_reduce": pca_reduce,
    "pca_rotation": pca_rotation,
    "map_2d": chart_map,
    "chart_sample": chart_sample,
    "nearest_centroid": nearest_centroid,
    "model_roundtrip": model_roundtrip,
    "persona_only": persona_only,
    "cluster_file_labels": cluster_file_labels,
    "epoch_batches": epoch_batch_means,
    "kmeans_fixed_init": kmeans_fixed_init,
    "kmeans_best_of_n": kmeans_best_of_n,
    "k_sweep": k_sweep,
    "best_k": best_k,
    "silhouette_exact": silhouette_exact,
    "silhouette_squared": silhouette_linear,
    "factor_split": factor_split,
    "factor_lengths": factor_lengths,
    "persona_probe": persona_probe,
    "leakage_probe": leakage_probe,
    "leakage_nearest_mean": leakage_nearest_mean,
    "hashed_tfidf": tfidf,
    "encode_tokens": token_encoding,
    "word_pmi": word_pmi,
    "corpus_encoder": corpus_encoder,
    "labelled_dialogue": labelled_dialogue,
    "labelled_split_sizes": labelled_split_sizes,
}
