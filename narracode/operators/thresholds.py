"""Decision thresholds: search, running best, last or best choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narracode.operators.metrics import f1_of_counts

GRID_STEPS = 100


def grid_value(j: Column) -> Column:
    """Grid point ``j``: the product, which differs from ``j / 100`` in the last bit for some
    points."""
    return j * F.lit(0.01)


def grid_points_below(score: Column) -> Column:
    """How many of the 101 grid points lie strictly below the score, 0..101.

    ``ceil`` of the scaled score is right up to one step; two comparisons with the grid
    values settle it.
    """
    k = F.ceil(score * GRID_STEPS)
    exact = (
        k
        + F.when(grid_value(k) < score, 1).otherwise(0)
        - F.when(grid_value(k - 1) >= score, 1).otherwise(0)
    )
    return F.when(score <= 0, 0).otherwise(F.least(F.lit(GRID_STEPS + 1), exact)).cast("int")


def threshold_search(scored: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    """Best of the grid ``0.00 .. 1.00`` by F1 per group, the lowest threshold on ties.

    Each score is placed once; what is shuffled is at most 102 counts per group and task,
    and the curve over all thresholds is a suffix sum over those counts.
    """
    by = list(by)
    counts = scored.groupBy(*by, grid_points_below(F.col("score")).alias("_k")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("y") == 1).alias("_pos")
    )
    histogram = counts.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("_k", F.struct("_n", "_pos")))).alias("_h"),
        F.sum("_pos").alias("_actual"),
    )
    grid = histogram.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(GRID_STEPS))))
    above = Window.partitionBy(*by).orderBy(F.desc("_j"))
    cell = F.try_element_at(F.col("_h"), F.col("_j") + 1)
    zero = F.lit(0).cast("bigint")
    curve = (
        grid.withColumns({"_n": F.coalesce(cell["_n"], zero), "_pos": F.coalesce(cell["_pos"], zero)})
        .withColumns({"_pp": F.sum("_n").over(above), "_tp": F.sum("_pos").over(above)})
        .withColumn("_f1", f1_of_counts(F.col("_tp"), F.col("_pp"), F.col("_actual")))
    )
    best = F.max(F.struct(F.col("_f1").alias("f1"), (-F.col("_j")).alias("neg_j")))
    return (
        curve.groupBy(*by)
        .agg(best.alias("_best"))
        .select(*by, grid_value(-F.col("_best.neg_j")).alias("thresh"), F.col("_best.f1").alias("f1"))
    )


def running_best(evals: DataFrame, by: Sequence[str] = ("run", "label"), span: int = 65_536) -> DataFrame:
    """Best threshold and score so far at each evaluation step; a tie takes the later step,
    and the state starts at threshold 0.5 with score 0.

    Steps are cut into ranges of ``span``. The best of each range is aggregated map-side and
    carried forward over the ranges, so a task sorts one range of one group and never all
    the steps of a group.
    """
    by = list(by)
    state = F.struct("f1", "step", "thresh")
    keyed = evals.withColumn("_range", F.floor(F.col("step") / span))
    per_range = keyed.groupBy(*by, "_range").agg(F.max(state).alias("_top"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_range.select(*by, "_range", F.max("_top").over(earlier).alias("_carry"))
    so_far = Window.partitionBy(*by, "_range").orderBy("step", "f1", "thresh").rowsBetween(
        Window.unboundedPreceding, 0
    )
    joined = keyed.join(carry, [*by, "_range"])
    best = F.greatest(F.max(state).over(so_far), F.col("_carry"))
    start = F.col("_best.f1") < 0
    return joined.withColumn("_best", best).select(
        *by,
        "step",
        "thresh",
        "f1",
        F.when(start, 0.5).otherwise(F.col("_best.thresh")).alias("best_thresh"),
        F.when(start, 0.0).otherwise(F.col("_best.f1")).alias("best_f1"),
    )


def final_state(evals: DataFrame, by: Sequence[str] = ("run", "label")) -> DataFrame:
    """The state after the last evaluation: ``thresh, f1, best_thresh, best_f1, step``."""
    last = F.max(F.struct("step", "thresh", "f1"))
    best = F.max(F.struct("f1", "step", "thresh"))
    return (
        evals.groupBy(*by)
        .agg(last.alias("_last"), best.alias("_best"))
        .select(
            *by,
            F.col("_last.thresh").alias("thresh"),
            F.col("_last.f1").alias("f1"),
            F.col("_best.thresh").alias("best_thresh"),
            F.col("_best.f1").alias("best_f1"),
            F.col("_last.step").alias("step"),
        )
    )
