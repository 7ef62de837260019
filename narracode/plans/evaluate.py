"""Evaluation: label vectors and score vectors to per-label thresholds and F1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narracode.functions.numeric import argmax, sigmoid
from narracode.operators.labels import semi, validate
from narracode.operators.metrics import f1_micro, f1_variable_average
from narracode.operators.thresholds import threshold_search
from narracode.spec import LabelSpec


def score_files(preds: DataFrame, labels: DataFrame, spec: LabelSpec) -> tuple[DataFrame, DataFrame]:
    """The metric of a prediction table against labels, and the checks it should pass."""
    kept = semi(labels, preds.select("uid"))
    pairs = preds.alias("p").join(kept.alias("l"), "uid")
    rows = [
        F.struct(
            F.lit(label).alias("label"), F.lit(kind).alias("kind"), F.col(f"l.{label}").alias("y"), F.col(f"p.{label}").alias("y_hat")
        )
        for label, kind, _, _ in spec.slot_ranges()
    ]
    long = pairs.select(F.inline(F.array(*rows)))
    return f1_variable_average(long), validate(preds, kept, spec)


def evaluate_logits(df: DataFrame, spec: LabelSpec, logits: str = "logits", labels: str = "labels") -> DataFrame:
    """``label, thresh, f1`` of a model's logits: sigmoid and threshold search on binary
    slots, largest logit on class ranges."""
    n_bin = len(spec.binary)
    binary_names = F.array(*[F.lit(name) for name in spec.binary])
    binary = df.select(
        F.posexplode(F.arrays_zip(F.slice(logits, 1, n_bin).alias("x"), F.slice(labels, 1, n_bin).alias("y"))).alias("i", "e")
    ).select(F.get(binary_names, F.col("i")).alias("label"), sigmoid(F.col("e.x")).alias("score"), F.col("e.y").alias("y"))
    found = threshold_search(binary).select("label", "thresh", "f1")
    rows = [
        F.struct(
            F.lit(label).alias("label"),
            F.get(labels, F.lit(n_bin + i)).alias("y"),
            argmax(F.slice(logits, start + 1, n)).alias("y_hat"),
        )
        for i, (label, _, start, n) in enumerate(r for r in spec.slot_ranges() if r[1] == "categorical")
    ]
    classes = f1_micro(df.select(F.inline(F.array(*rows))))
    return found.unionByName(classes.select("label", F.lit(None).cast("double").alias("thresh"), "f1"))
