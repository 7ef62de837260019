"""Connected components by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narracode.session import write_table


def _starts(edges: DataFrame) -> tuple:
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("u", "_m").alias("_m"))
    linked = both.filter("v > u").join(least, F.col("u") == F.col("_u"))
    return linked.select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), "_m")
    moved = down.join(least, F.col("u") == F.col("_u")).filter("v > _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return moved.unionAll(least.select(F.col("_u").alias("u"), F.col("_m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``u, v`` (any ordered type) that is not its
    own root; the root is the smallest node that can be reached.

    Each round is one large-star and one small-star step over written tables. A node with very
    many links costs a partial minimum and a join that Spark may split; its links are never
    gathered. No links give no rows.
    """
    now = write_table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "links")
    state = _starts(now)
    while state[0]:
        now = write_table(_small_star(_large_star(now)), "links")
        before, state = state, _starts(now)
        if before == state:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
