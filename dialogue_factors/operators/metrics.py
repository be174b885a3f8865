"""Scores over predicted rows, each one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dialogue_factors.config import Settings
from dialogue_factors.functions.text import seeded_hash
from dialogue_factors.functions.vectors import argmax, cosine, cross_entropy
from dialogue_factors.operators.order import rank_in_buckets


def accuracy_of(prediction: Column | str, label: Column | str) -> Column:
    """Share of rows predicted right; null without rows."""
    p = F.col(prediction) if isinstance(prediction, str) else prediction
    y = F.col(label) if isinstance(label, str) else label
    return F.avg((p == y).cast("double"))


def accuracy(rows: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), accuracy_of(prediction, label).alias("accuracy"))


def confusion_matrix(rows: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """`(label, prediction, n)` over all labels seen in truth or prediction, zeros included."""
    paired = rows.select(F.col(label).alias("label"), F.col(prediction).alias("prediction")).where("label IS NOT NULL AND prediction IS NOT NULL")
    counts = paired.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    # The set holds class numbers. Asking for n > 0, always true, keeps both uses of
    # the counts alike, so that the rows are scanned and counted once.
    seen = counts.where("n > 0").select(F.explode(F.array("label", "prediction")).alias("c")).agg(F.array_sort(F.collect_set("c")).alias("classes"))
    grid = seen.select(F.explode("classes").alias("label"), "classes").select("label", F.explode("classes").alias("prediction"))
    return grid.join(counts, ["label", "prediction"], "left").select("label", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def overlap(z_p: str = "z_p", z_c: str = "z_c") -> Column:
    """Squared cosine of the two parts of a row."""
    return F.pow(cosine(z_p, z_c), 2)


def loss_terms(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row: classification, adversary and overlap loss, and their weighted total."""
    return rows.agg(
        F.avg(cross_entropy("logits", "label")).alias("classification"),
        F.avg(cross_entropy("adv_logits", "label")).alias("adversary"),
        F.avg(overlap()).alias("overlap"),
    ).withColumn(
        "total",
        F.col("classification") + settings.adversary_weight * F.col("adversary") + settings.overlap_weight * F.col("overlap"),
    )


def staged_loss(settings: Settings = Settings()) -> Column:
    """Per-row loss of the two-stage schedule: classification alone at first, then the
    adversary with a weight growing by epoch, and the overlap."""
    classification = cross_entropy("logits", "label")
    weight = settings.adversary_weight * F.col("epoch") / settings.epochs
    full = classification + weight * cross_entropy("adv_logits", "label") + settings.overlap_weight * overlap()
    return F.when(F.col("epoch") < settings.staged_from_epoch, classification).otherwise(full)


def epoch_history(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`(epoch, loss, accuracy)` over scored rows: means over rows, not over batches."""
    return rows.groupBy("epoch").agg(
        F.avg(staged_loss(settings)).alias("loss"), accuracy_of(argmax("logits"), "label").alias("accuracy")
    )


def number_batches(rows: DataFrame, *keys: str, settings: Settings = Settings()) -> DataFrame:
    """Add `batch`: 0, 1, ... of `batch_size` rows each, in an order that differs by epoch
    and repeats for a seed; the last batch of an epoch may be smaller."""
    hashed = rows.withColumn("_digest", seeded_hash(settings.seed, "epoch", *keys)).withColumn("_bucket", F.substring("_digest", 1, 4))
    ranked = rank_in_buckets(hashed, ["_bucket"], ["_digest", *keys], "_rank", within=["epoch"])
    return ranked.withColumn("batch", F.expr(f"(_rank - 1) div {settings.batch_size}")).drop("_digest", "_bucket", "_rank")


def epoch_batches(rows: DataFrame, *keys: str, settings: Settings = Settings()) -> DataFrame:
    """`(epoch, n_batches, loss, accuracy)` as a training loop reports them: the loss is the
    mean of the batches' means, so that rows of a small last batch weigh more; accuracy is
    over rows. `keys` make a row unique."""
    narrow = rows.select("epoch", *keys, staged_loss(settings).alias("loss"), (argmax("logits") == F.col("label")).cast("double").alias("hit"))
    batches = number_batches(narrow, *keys, settings=settings).groupBy("epoch", "batch").agg(
        F.avg("loss").alias("loss"), F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n")
    )
    return batches.groupBy("epoch").agg(
        F.count(F.lit(1)).alias("n_batches"), F.avg("loss").alias("loss"), (F.sum("hits") / F.sum("n")).alias("accuracy")
    )


def history_table(history: DataFrame) -> DataFrame:
    """Long form `(epoch, metric, value)`."""
    return history.unpivot("epoch", ["loss", "accuracy"], "metric", "value")
