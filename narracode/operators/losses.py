"""Loss values over prediction tables.

Two shapes occur. Losses per record work on the record's own arrays and need no shuffle at
all. Losses over a whole table, or over groups of any size, are sums over blocks of equal
error: the Jaccard steps inside a block telescope, so rows are first merged per error value,
and the running counts over the blocks are taken in two levels (ranges of errors, then blocks
inside a range). No task sorts a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narracode.functions.numeric import let, log_sum_exp, relu, sigmoid
from narracode.spec import LabelSpec

ERROR_RANGES = 1024


# ------------------------------------------------------------------ per record


def _sorted_errors(x: Column, y: Column, ignore: int | None) -> Column:
    """Array of ``(-error, slot, y)`` from the largest error on, ties by slot."""
    entry = F.transform(
        F.arrays_zip(x.alias("x"), y.alias("y")),
        lambda e, i: F.struct(
            (e["x"].cast("double") * (2.0 * e["y"] - 1.0) - 1.0).alias("neg_error"),
            i.alias("slot"),
            e["y"].cast("int").alias("y"),
        ),
    )
    if ignore is not None:
        entry = F.filter(entry, lambda e: e["y"] != ignore)
    return F.array_sort(entry)


def _jaccard(positives: Column, seen_pos: Column, seen_neg: Column) -> Column:
    """One minus intersection over union after some rows were seen; zero before the first."""
    union = positives + seen_neg
    return F.when(seen_pos + seen_neg == 0, F.lit(0.0)).otherwise(
        1.0 - (positives - seen_pos) / F.greatest(union, F.lit(1))
    )


def _walk(entries: Column) -> Column:
    """Fold over sorted errors; collects the loss of the non-negative errors."""
    positives = F.aggregate(entries, F.lit(0), lambda acc, e: acc + e["y"])
    start = F.struct(
        positives.alias("p"),
        F.lit(0).alias("pos"),
        F.lit(0).alias("neg"),
        F.lit(0.0).alias("jac"),
        F.lit(0.0).alias("loss"),
    )

    def step(acc: Column, e: Column) -> Column:
        pos, neg = acc["pos"] + e["y"], acc["neg"] + (1 - e["y"])
        jac = _jaccard(acc["p"], pos, neg)
        return F.struct(
            acc["p"].alias("p"),
            pos.alias("pos"),
            neg.alias("neg"),
            jac.alias("jac"),
            (acc["loss"] + relu(-e["neg_error"]) * (jac - acc["jac"])).alias("loss"),
        )

    return F.aggregate(entries, start, step)


def record_hinge(x: Column, y: Column, ignore: int | None = None, only_present: bool = False) -> Column:
    """Lovász hinge of one record from its logit and label arrays; no entries give 0."""

    def of(entries: Column) -> Column:
        end = _walk(entries)
        if only_present:
            return let(end, lambda w: F.when(w["p"] == 0, F.lit(0.0)).otherwise(w["loss"]))
        return end["loss"]

    return let(_sorted_errors(x, y, ignore), of)


def record_symmetric(x: Column, y: Column) -> Column:
    """Mean of the hinge for the labels and for their complement."""
    flipped = record_hinge(F.transform(x, lambda v: -v), F.transform(y, lambda v: 1 - v))
    return (record_hinge(x, y) + flipped) / 2


def lovasz_grad(df: DataFrame, x: str = "x", y: str = "y", ignore: int | None = None) -> DataFrame:
    """Steps of the running Jaccard over a record's entries sorted by error, descending:
    ``uid, pos, slot, g``."""

    def steps(entries: Column) -> Column:
        positives = F.aggregate(entries, F.lit(0), lambda acc, e: acc + e["y"])
        start = F.struct(
            positives.alias("p"), F.lit(0).alias("pos"), F.lit(0).alias("neg"), F.lit(0.0).alias("jac"),
            F.array().cast("array<struct<slot:int,g:double>>").alias("out"),
        )

        def step(acc: Column, e: Column) -> Column:
            pos, neg = acc["pos"] + e["y"], acc["neg"] + (1 - e["y"])
            jac = _jaccard(acc["p"], pos, neg)
            g = F.struct(e["slot"].alias("slot"), (jac - acc["jac"]).alias("g"))
            return F.struct(
                acc["p"].alias("p"), pos.alias("pos"), neg.alias("neg"), jac.alias("jac"),
                F.concat(acc["out"], F.array(g)).alias("out"),
            )

        return F.aggregate(entries, start, step)["out"]

    grads = df.withColumn("_g", let(_sorted_errors(F.col(x), F.col(y), ignore), steps))
    return grads.select("uid", F.posexplode("_g").alias("pos", "_e")).select(
        "uid", "pos", F.col("_e.slot").alias("slot"), F.col("_e.g").alias("g")
    )


def lovasz_hinge(
    df: DataFrame, x: str = "x", y: str = "y", ignore: int | None = None, only_present: bool = False
) -> DataFrame:
    """Mean over records of the hinge; ``only_present`` zeroes records without a positive."""
    return df.agg(F.coalesce(F.avg(record_hinge(F.col(x), F.col(y), ignore, only_present)), F.lit(0.0)).alias("loss"))


def symmetric_lovasz(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.agg(F.coalesce(F.avg(record_symmetric(F.col(x), F.col(y))), F.lit(0.0)).alias("loss"))


# ------------------------------------------------------- groups of any size


def lovasz_by_group(
    df: DataFrame, by: Sequence[str], error: str = "error", positive: str = "positive", ranges: int = ERROR_RANGES
) -> DataFrame:
    """``Σ relu(error) · Jaccard step`` per group over long rows ``(group, error, positive)``;
    also ``positives``.

    Range limits are quantiles of the errors, taken by a sketch inside the plan. They only
    balance the ranges: the result is the same for any limits.
    """
    by = list(by)
    blocks = df.groupBy(*by, error).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(positive).cast("bigint")).alias("_p")
    )
    blocks = _in_ranges(df, blocks, error, ranges)
    down = Window.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy(*by, "_range").agg(F.sum("_n").alias("_rn"), F.sum("_p").alias("_rp"))
    zero = F.lit(0).cast("bigint")
    carry = sums.select(
        *by,
        "_range",
        F.coalesce(F.sum("_rn").over(down), zero).alias("_n0"),
        F.coalesce(F.sum("_rp").over(down), zero).alias("_p0"),
        F.sum("_rp").over(Window.partitionBy(*by)).alias("_positives"),
    )
    keys = [*by, "_range"]
    inside = Window.partitionBy(*keys).orderBy(F.desc(error)).rowsBetween(Window.unboundedPreceding, 0)
    walked = blocks.join(carry, keys).withColumns(
        {
            "_cn": F.col("_n0") + F.sum("_n").over(inside),
            "_cp": F.col("_p0") + F.sum("_p").over(inside),
        }
    )
    now = _jaccard(F.col("_positives"), F.col("_cp"), F.col("_cn") - F.col("_cp"))
    pos_before, n_before = F.col("_cp") - F.col("_p"), F.col("_cn") - F.col("_n")
    before = _jaccard(F.col("_positives"), pos_before, n_before - pos_before)
    return walked.groupBy(*by).agg(
        F.sum(relu(F.col(error)) * (now - before)).alias("loss"), F.max("_positives").alias("positives")
    )


def _in_ranges(df: DataFrame, blocks: DataFrame, error: str, ranges: int) -> DataFrame:
    """Add ``_range``, the number of limits at or below the error, found in two steps of about
    the square root of their number each."""
    if ranges < 2:
        return blocks.withColumn("_range", F.lit(0))
    probabilities = [i / ranges for i in range(1, ranges)]
    width = max(2, round(ranges**0.5))
    limits = df.agg(F.percentile_approx(error, probabilities, 4 * ranges).alias("_all"))
    # every width-th limit is picked once here, not again for each error
    every = F.filter("_all", lambda x, i: i % width == width - 1)
    named = blocks.withColumn("_limits", limits.select(F.struct("_all", every.alias("_every"))).scalar())
    named = named.withColumn("_coarse", F.size(F.filter("_limits._every", lambda x: x <= F.col(error))))
    piece = F.slice("_limits._all", F.col("_coarse") * width + 1, F.lit(width))
    fine = F.size(F.filter(piece, lambda x: x <= F.col(error)))
    return named.withColumn("_range", F.col("_coarse") * width + fine).drop("_limits", "_coarse")


def lovasz_hinge_flat(df: DataFrame, x: str = "x", y: str = "y", ignore: int | None = None) -> DataFrame:
    """Hinge over all rows ``(x, y)`` of a table as one group."""
    rows = df if ignore is None else drop_ignored(df, ignore, y)
    error = 1.0 - F.col(x) * (2.0 * F.col(y) - 1.0)
    long = rows.select(error.alias("error"), F.col(y).alias("positive"))
    return lovasz_by_group(long, []).agg(F.coalesce(F.max("loss"), F.lit(0.0)).alias("loss"))


def lovasz_softmax(
    df: DataFrame,
    prob: str = "prob",
    y: str = "y",
    group: str | None = None,
    only_present: bool = False,
    ignore: int | None = None,
) -> DataFrame:
    """Mean over classes of the Lovász extension of ``|1[y = c] - p_c|``, for the whole table
    or as a mean over groups. A group that has only void rows, or no class present, counts as
    0."""
    rows = df if ignore is None else drop_ignored(df, ignore, y)
    by = [group] if group else []
    long = rows.select(*by, F.col(y).alias("_y"), F.posexplode(prob).alias("class", "_prob"))
    positive = (F.col("_y") == F.col("class")).cast("int")
    long = long.select(*by, "class", F.abs(positive - F.col("_prob")).alias("error"), positive.alias("positive"))
    per_class = lovasz_by_group(long, [*by, "class"])
    if only_present:
        per_class = per_class.filter(F.col("positives") > 0)
    per_group = per_class.groupBy(*by).agg(F.avg("loss").alias("loss"))
    if group:
        # groups that lost all their rows on the way
        every = df.select(group).distinct().withColumn("_zero", F.lit(0.0))
        per_group = every.join(per_group, group, "left").select(F.coalesce("loss", "_zero").alias("loss"))
    return per_group.agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss"))


# --------------------------------------------------------- row-wise averages


def drop_ignored(df: DataFrame, ignore: int, y: str = "y") -> DataFrame:
    """Rows whose label is not the void class."""
    return df.filter(F.col(y) != ignore)


def bce(x: Column, y: Column) -> Column:
    """Binary cross-entropy from a logit, safe for large values."""
    return relu(x) - x * y + F.log1p(F.exp(-F.abs(x)))


def bce_stable(df: DataFrame, x: str = "x", y: str = "y", ignore: int | None = None) -> DataFrame:
    rows = df if ignore is None else drop_ignored(df, ignore, y)
    return rows.agg(F.avg(bce(F.col(x), F.col(y))).alias("loss"))


def focal_loss(df: DataFrame, x: str = "x", y: str = "y", alpha: float = 0.25, gamma: float = 2.0) -> DataFrame:
    p, t = sigmoid(F.col(x)), F.col(y)
    right = p * t + (1 - p) * (1 - t)
    loss = bce(F.col(x), t) * F.pow(1 - right, F.lit(gamma))
    if alpha >= 0:
        loss = (alpha * t + (1 - alpha) * (1 - t)) * loss
    return df.agg(F.avg(loss).alias("loss"))


def record_cross_entropy(x: Column, y: Column) -> Column:
    """``logsumexp(x) - x[y]`` for a logit array and a class from zero."""
    return log_sum_exp(x) - F.get(x, y)


def cross_entropy(df: DataFrame, x: str = "x", y: str = "y", ignore: int | None = 255) -> DataFrame:
    rows = df if ignore is None else drop_ignored(df, ignore, y)
    return rows.agg(F.avg(record_cross_entropy(F.col(x), F.col(y))).alias("loss"))


def total_loss(df: DataFrame, spec: LabelSpec, logits: str = "logits", labels: str = "labels") -> DataFrame:
    """Symmetric Lovász on the binary slots plus cross-entropy per categorical label, from
    packed logits and packed zero-based labels, in one pass."""
    n_bin = len(spec.binary)
    x = F.slice(logits, 1, n_bin)
    terms = [F.avg(record_symmetric(x, F.slice(labels, 1, n_bin)))]
    for i, (_, _, start, n) in enumerate(r for r in spec.slot_ranges() if r[1] == "categorical"):
        terms.append(F.avg(record_cross_entropy(F.slice(logits, start + 1, n), F.get(labels, F.lit(n_bin + i)))))
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return df.agg(total.alias("loss"))
