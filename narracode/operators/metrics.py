"""Evaluation tables: counts, F1, accuracy, IoU, profiles and reports."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narracode.functions.numeric import hash_uniform


def class_counts_distinct(labels_long: DataFrame) -> DataFrame:
    return labels_long.groupBy("label").agg(F.count_distinct("y").alias("n"))


def confusion(preds: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    """``tp, fp, fn, tn`` per group from columns ``y`` and ``y_hat``; summed map-side."""
    hit, truth = F.col("y_hat") == 1, F.col("y") == 1
    return preds.groupBy(*by).agg(
        F.count_if(hit & truth).alias("tp"),
        F.count_if(hit & ~truth).alias("fp"),
        F.count_if(~hit & truth).alias("fn"),
        F.count_if(~hit & ~truth).alias("tn"),
    )


def f1_of_counts(tp: Column, predicted: Column, actual: Column) -> Column:
    """``2 tp / (predicted + actual)``, zero when there is neither."""
    total = predicted + actual
    return F.when(total == 0, F.lit(0.0)).otherwise(2 * tp / F.greatest(total, F.lit(1)))


def f1_binary(preds: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    f1 = f1_of_counts(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"))
    return confusion(preds, by).select(*by, f1.alias("f1"))


def evaluation_report(preds: DataFrame) -> DataFrame:
    """``level, fold, label, kind, n, tp, predicted, actual, same, f1`` with sub-totals by fold and
    label, by label, by kind and over all, in one aggregation.

    Scores come from the counts of their level: binary F1 over all binary decisions where a level has
    them, the share of equal codes where it has only categorical ones. ``level`` names the level;
    columns that it sums over are null."""
    binary = F.col("kind") == "binary"
    hit, truth = binary & (F.col("y_hat") == 1), binary & (F.col("y") == 1)
    names = ["fold", "label", "kind"]
    # the kind goes with its label
    sets = [["fold", "label", "kind"], ["label", "kind"], ["kind"], []]
    counted = preds.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(
        F.grouping_id(*names).alias("_level"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(hit & truth).alias("tp"),
        F.count_if(hit).alias("predicted"),
        F.count_if(truth).alias("actual"),
        F.count_if(F.col("y") == F.col("y_hat")).alias("same"),
        F.count_if(binary).alias("_binary"),
    )
    level = F.when(F.col("_level") == 0, "fold").when(F.col("_level") == 4, "label").when(F.col("_level") == 6, "kind").otherwise("all")
    f1 = F.when(F.col("_binary") > 0, f1_of_counts(F.col("tp"), F.col("predicted"), F.col("actual"))).otherwise(F.col("same") / F.col("n"))
    return counted.select(level.alias("level"), *names, "n", "tp", "predicted", "actual", "same", f1.alias("f1"))


def f1_macro(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return f1_binary(preds, [*by, "label"]).groupBy(*by).agg(F.avg("f1").alias("f1"))


def f1_micro(preds: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    """Micro F1 of single-label classes, which is the share of equal codes."""
    return preds.groupBy(*by).agg(F.avg((F.col("y") == F.col("y_hat")).cast("double")).alias("f1"))


def f1_by_label(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``label, kind, f1`` for a mixed table in one aggregation: binary F1 for binary
    labels, micro F1 for categorical ones."""
    hit, truth = F.col("y_hat") == 1, F.col("y") == 1
    counts = preds.groupBy(*by, "label", "kind").agg(
        F.count_if(hit & truth).alias("_tp"),
        F.count_if(hit).alias("_pp"),
        F.count_if(truth).alias("_p"),
        F.avg((F.col("y") == F.col("y_hat")).cast("double")).alias("_same"),
    )
    f1 = F.when(F.col("kind") == "binary", f1_of_counts(F.col("_tp"), F.col("_pp"), F.col("_p")))
    return counts.select(*by, "label", "kind", f1.otherwise(F.col("_same")).alias("f1"))


def f1_variable_average(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the per-label scores; equal to weighting the macro F1 of the binary labels by
    their number and each categorical micro F1 by one."""
    per_label = f1_by_label(preds, by)
    return per_label.groupBy(*by).agg(F.avg("f1").alias("f1"))


def length_profile(df: DataFrame, length: Column, exact: bool = True) -> DataFrame:
    """Distribution of record lengths. Rows are first counted per length, so the percentile
    works on the distinct lengths; ``exact=False`` uses the sketch instead."""
    counts = df.select(length.alias("_len")).groupBy("_len").agg(F.count(F.lit(1)).alias("_n"))
    if exact:
        p50, p95 = [F.expr(f"percentile(_len, {q}D, _n)") for q in (0.5, 0.95)]
    else:
        sketch = df.select(length.alias("_len")).agg(
            F.min("_len").cast("bigint").alias("min"),
            F.avg("_len").alias("mean"),
            F.percentile_approx("_len", 0.5, 10_000).cast("double").alias("median"),
            F.percentile_approx("_len", 0.95, 10_000).cast("double").alias("p95"),
            F.max("_len").cast("bigint").alias("max"),
        )
        return sketch.select("min", "mean", "median", F.col("median").alias("p50"), "p95", "max")
    return counts.agg(
        F.min("_len").cast("bigint").alias("min"),
        (F.sum(F.col("_len") * F.col("_n")) / F.sum("_n")).alias("mean"),
        p50.alias("median"),
        p50.alias("p50"),
        p95.alias("p95"),
        F.max("_len").cast("bigint").alias("max"),
    )


def random_baseline(labels_long: DataFrame, spec_df: DataFrame, seed: int) -> DataFrame:
    """Variable-averaged F1 of hash-random predictions; codes are drawn from the valid range
    (0/1 for binary labels, 1..n for categorical ones)."""
    spec = F.broadcast(spec_df.select("label", "kind", "n_classes"))
    u = hash_uniform(f"{seed}|", F.col("label"), "|", F.col("uid"))
    draw = F.floor(u * F.col("n_classes")) + F.when(F.col("kind") == "binary", 0).otherwise(1)
    preds = labels_long.drop("kind").join(spec, "label").withColumn("y_hat", draw.cast("int"))
    return f1_variable_average(preds)


def best_checkpoint(evals: DataFrame, metric: str, larger: bool = True, by: Sequence[str] = ("run",)) -> DataFrame:
    """Step with the best metric per run, the earliest one on ties."""
    value = F.col(metric) if larger else -F.col(metric)
    return evals.groupBy(*by).agg(
        F.max_by("step", F.struct(value, -F.col("step"))).alias("step"),
        (F.max(metric) if larger else F.min(metric)).alias("best"),
    )


def keep_checkpoints(evals: DataFrame, metric: str, n: int = 2, by: Sequence[str] = ("run",)) -> DataFrame:
    """At most ``n`` steps per run: the best one and the latest others.

    The latest ``n`` are found with a ranked filter, which Spark limits per task before the
    shuffle, so a run with very many steps sends ``n`` rows per task.
    """
    by = list(by)
    best = best_checkpoint(evals, metric, by=by).select(*by, "step", F.lit(1).alias("is_best"))
    latest = Window.partitionBy(*by).orderBy(F.desc("step"))
    recent = (
        evals.select(*by, "step", F.lit(0).alias("is_best"))
        .withColumn("_r", F.row_number().over(latest))
        .filter(F.col("_r") <= n)
        .drop("_r")
    )
    few = recent.unionByName(best).groupBy(*by, "step").agg(F.max("is_best").alias("is_best"))
    keep = Window.partitionBy(*by).orderBy(F.desc("is_best"), F.desc("step"))
    return few.withColumn("slot", F.row_number().over(keep)).filter(F.col("slot") <= n)


def iou_binary(
    df: DataFrame, group: str | None, empty: float = 1.0, ignore: int | None = None
) -> DataFrame:
    """Intersection over union of class 1 in percent; mean over groups, or over the whole
    table as one group."""
    truth, hit = F.col("y") == 1, F.col("y_hat") == 1
    counted = hit if ignore is None else hit & (F.col("y") != ignore)
    by = [group] if group else []
    per_group = df.groupBy(*by).agg(
        F.count_if(truth & hit).alias("_i"), F.count_if(truth | counted).alias("_u")
    )
    iou = F.when(F.col("_u") == 0, F.lit(empty)).otherwise(F.col("_i") / F.greatest(F.col("_u"), F.lit(1)))
    return per_group.agg((F.lit(100.0) * F.avg(iou)).alias("iou"))


def iou_classes(
    df: DataFrame,
    n_classes: int,
    group: str | None = None,
    empty: float = 1.0,
    ignore: int | None = None,
) -> DataFrame:
    """Per-class IoU in percent, mean over groups.

    Rows are first counted per ``(group, y, y_hat)``; each of these cells then counts for its
    true and its predicted class, and once for its group, so nothing is repeated per class at
    row level.
    """
    keyed = df.withColumn("_g", F.col(group) if group else F.lit(0))
    cells = keyed.groupBy("_g", "y", "y_hat").agg(F.count(F.lit(1)).alias("_n"))
    wrong_side = F.col("y") != F.col("y_hat")
    if ignore is not None:
        wrong_side = wrong_side & (F.col("y") != ignore)
    same = (F.col("y") == F.col("y_hat")).cast("bigint") * F.col("_n")
    zero, whole = F.lit(0).cast("bigint"), F.lit(-1)
    sides = F.array(
        F.struct(F.col("y").alias("class"), same.alias("i"), F.col("_n").alias("u")),
        F.struct(F.when(wrong_side, F.col("y_hat")).alias("class"), zero.alias("i"), F.col("_n").alias("u")),
        F.struct(whole.alias("class"), zero.alias("i"), F.col("_n").alias("u")),
    )
    parts = cells.select("_g", F.inline(sides)).filter(F.col("class").between(-1, n_classes - 1))
    per_group = parts.groupBy("_g", "class").agg(F.sum("i").alias("_i"), F.sum("u").alias("_u"))
    per_class = per_group.groupBy("class").agg(
        F.sum(F.col("_i") / F.col("_u")).alias("sum"), F.count(F.lit(1)).alias("present")
    )
    # one row with a map of at most n_classes + 1 entries; the entry of class -1 counts the groups
    packed = per_class.agg(F.map_from_entries(F.collect_list(F.struct("class", F.struct("sum", "present")))).alias("m"))
    grid = packed.select("m", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias("class"))
    if ignore is not None:
        grid = grid.filter(F.col("class") != ignore)
    cell, groups = F.try_element_at("m", F.col("class")), F.try_element_at("m", whole)["present"]
    total = F.coalesce(cell["sum"], F.lit(0.0)) + (groups - F.coalesce(cell["present"], zero)) * F.lit(empty)
    return grid.select("class", (F.lit(100.0) * total / groups).alias("iou"))


def nan_mean(x: Column, ignore_nan: bool = False, empty: float = 0.0) -> Column:
    """Aggregate: mean with optional NaN skip and a value for empty input."""
    return F.coalesce(F.avg(F.when(~F.isnan(x), x) if ignore_nan else x), F.lit(empty))


def label_correlation(labels_wide: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of each pair of label columns, in one pass over the table."""
    pairs = list(combinations_with_replacement(cols, 2))
    row = labels_wide.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    entries = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])
    return row.select(F.inline(entries))


def class_prior(labels_long: DataFrame) -> DataFrame:
    """Class shares per label; the window runs over one row per class."""
    counts = labels_long.groupBy("label", "y").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("label"))
    return counts.select("label", "y", "n", (F.col("n") / total).alias("p"))
