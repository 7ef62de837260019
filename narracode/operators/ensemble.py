"""Combining the scores of many models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narracode.functions.numeric import argmax, sigmoid, softmax
from narracode.operators.labels import binarize
from narracode.spec import LabelSpec


def ensemble_mean(scores: DataFrame) -> DataFrame:
    """Mean over models of long scores ``model, uid, label, class_idx, score``."""
    return scores.groupBy("uid", "label", "class_idx").agg(F.avg("score").alias("score"))


def threshold_mean(thresholds: DataFrame) -> DataFrame:
    return thresholds.groupBy("label").agg(F.avg("thresh").alias("thresh"))


def argmax_class(scores: DataFrame) -> DataFrame:
    """Class with the largest score per record and label, the first one on ties."""
    pick = F.max_by("class_idx", F.struct("score", -F.col("class_idx")))
    return scores.groupBy("uid", "label").agg(pick.alias("class_idx"))


def ensemble_average(
    binary_scores: DataFrame, thresholds: DataFrame, class_scores: DataFrame | None = None
) -> DataFrame:
    """Mean score strictly above mean threshold; for categorical labels the class with the
    largest mean score, plus one."""
    mean = binary_scores.groupBy("uid", "label").agg(F.avg("score").alias("score"))
    joined = mean.join(threshold_mean(thresholds), "label")
    out = joined.select("uid", "label", binarize(F.col("score"), F.col("thresh")).alias("y_hat"))
    if class_scores is not None:
        # the mean and the choice share one exchange
        classes = argmax_class(ensemble_mean(class_scores.repartition("uid", "label")))
        out = out.unionByName(
            classes.select("uid", "label", (F.col("class_idx") + 1).cast("int").alias("y_hat"))
        )
    return out


def ensemble_vote(binary_scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Each model votes with its own threshold; more than half must agree, so a tie is 0."""
    votes = binary_scores.join(thresholds, ["model", "label"])
    ayes = F.count_if(F.col("score") > F.col("thresh"))
    return votes.groupBy("uid", "label").agg((2 * ayes > F.count(F.lit(1))).cast("int").alias("y_hat"))


def activate(df: DataFrame, spec: LabelSpec, logits: str = "logits", out: str = "vec") -> DataFrame:
    """Logit vector to score vector: sigmoid on binary slots, softmax on each class range."""
    parts = [F.transform(F.slice(logits, 1, len(spec.binary)), sigmoid)]
    for _, kind, start, n in spec.slot_ranges():
        if kind == "categorical":
            parts.append(softmax(F.slice(logits, start + 1, n)))
    return df.withColumn(out, F.concat(*parts))


def ensemble_vectors(members: DataFrame, thresholds: DataFrame, spec: LabelSpec) -> DataFrame:
    """Average ensemble over ``model, uid, vec``: one wide row of codes per record.

    The vectors stay packed: a record sends one row of partial sums per task, where the long
    form would send one per slot. ``thresholds`` has one row per model and label.
    """
    n = spec.n_slots
    mean = members.groupBy("uid").agg(*[F.avg(F.get("vec", F.lit(i))).alias(f"_s{i}") for i in range(n)])
    known = threshold_mean(thresholds.filter(F.col("label").isin(spec.binary)))
    limits = known.agg(
        F.map_from_entries(F.collect_list(F.struct("label", "thresh"))).alias("limits")
    )
    with_limits = mean.withColumn("_limits", limits.scalar())
    out = []
    for label, kind, start, size in spec.slot_ranges():
        if kind == "binary":
            code = binarize(F.col(f"_s{start}"), F.col("_limits")[label])
        else:
            code = argmax(F.array(*[f"_s{start + i}" for i in range(size)])) + 1
        out.append(code.cast("int").alias(label))
    return with_limits.select("uid", *out)
