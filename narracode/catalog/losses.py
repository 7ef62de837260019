"""Loss values over logits."""

from __future__ import annotations

from pyspark.sql import functions as F

from narracode.catalog import tables as t
from narracode.catalog.metrics import rounded
from narracode.catalog.registry import query
from narracode.functions.numeric import softmax
from narracode.operators import losses as L
from narracode.spec import CODING_SPEC


def walk(source: str, by: str, order: str, x: str = "x", y: str = "y") -> dict[str, str]:
    """Rows of ``source`` with error, running Jaccard and its step ``g`` per group."""
    part = f"PARTITION BY {by}" if by else ""
    down = f"OVER ({part} ORDER BY e DESC, {order} ROWS UNBOUNDED PRECEDING)"
    return {
        "err": f"SELECT *, 1 - {x} * (2 * {y} - 1) AS e FROM {source}",
        "cum": f"SELECT *, sum({y}) OVER ({part}) AS tot, sum({y}) {down} AS cp, sum(1 - {y}) {down} AS cn, "
        f"row_number() OVER ({part} ORDER BY e DESC, {order}) - 1 AS pos FROM err",
        "jacs": "SELECT *, 1 - CAST(tot - cp AS DOUBLE) / CAST(tot + cn AS DOUBLE) AS jac FROM cum",
        "grads": f"SELECT *, jac - COALESCE(lag(jac) OVER ({part} ORDER BY pos), 0) AS g FROM jacs",
    }


@query(
    "lovasz_grad",
    t.with_tables(
        "SELECT uid, CAST(pos AS INT) AS pos, slot - 1 AS slot, round(g, 6) + 0 AS g FROM grads", "pairs", extra=walk("pairs", "uid", "slot")
    ),
)
def lovasz_grad(spark, sf):
    return rounded(L.lovasz_grad(t.pairs(spark, sf)), "g")


@query(
    "lovasz_hinge",
    t.with_tables(
        "SELECT round(avg(l), 6) AS loss FROM (SELECT uid, sum(greatest(e, 0) * g) AS l FROM grads GROUP BY uid)",
        "pairs",
        extra=walk("pairs", "uid", "slot"),
    ),
)
def lovasz_hinge(spark, sf):
    return rounded(L.lovasz_hinge(t.pairs(spark, sf)), "loss")


# every fifth slot carries the void label
_void = "SELECT uid, slot, x, CASE WHEN slot % 5 = 0 THEN 255 ELSE y END AS y FROM pairs"


def void_pairs(spark, sf):
    y = F.transform("y", lambda v, i: F.when((i + 1) % 5 == 0, 255).otherwise(v))
    return t.pairs(spark, sf).withColumn("y", y)


@query(
    "lovasz_hinge_present",
    t.with_tables(
        "SELECT round(avg(l), 6) AS loss FROM (SELECT uid, CASE WHEN max(y) = 0 THEN 0 ELSE sum(greatest(e, 0) * g) END AS l FROM grads GROUP BY uid)",
        "pairs",
        extra={"seen": f"SELECT * FROM ({_void}) WHERE y <> 255", **walk("seen", "uid", "slot")},
    ),
)
def lovasz_hinge_present(spark, sf):
    return rounded(L.lovasz_hinge(void_pairs(spark, sf), ignore=255, only_present=True), "loss")


@query(
    "lovasz_hinge_flat",
    t.with_tables("SELECT round(sum(greatest(e, 0) * g), 6) AS loss FROM grads", "pairs", extra=walk("pairs", "", "uid, slot")),
)
def lovasz_hinge_flat(spark, sf):
    """All slots of all records as one group."""
    long = t.pairs(spark, sf).select(F.inline(F.arrays_zip("x", "y")))
    return rounded(L.lovasz_hinge_flat(long), "loss")


_two_sides = "SELECT uid || '+' AS uid, slot, x, y FROM pairs UNION ALL SELECT uid || '-', slot, -x, 1 - y FROM pairs"


@query(
    "symmetric_lovasz",
    t.with_tables(
        "SELECT round(avg(l), 6) AS loss FROM (SELECT uid, sum(greatest(e, 0) * g) AS l FROM grads GROUP BY uid)",
        "pairs",
        extra={"sides": _two_sides, **walk("sides", "uid", "slot")},
    ),
)
def symmetric_lovasz(spark, sf):
    return rounded(L.symmetric_lovasz(t.pairs(spark, sf)), "loss")


def class_probabilities(spark, sf):
    """``uid, prob (6), y, grp``."""
    return t.vectors(spark, sf).select(
        "uid",
        softmax(F.slice("logits", 22, 6)).alias("prob"),
        F.get("labels", F.lit(21)).alias("y"),
        (F.length("uid")).alias("grp"),
    )


_prob = {
    "prob": (
        "SELECT uid, length(uid) AS grp, slot - 22 AS class, CAST(code % 6 = slot - 22 AS INT) AS fg, "
        "exp(x) / sum(exp(x)) OVER (PARTITION BY uid) AS p FROM slots WHERE slot BETWEEN 22 AND 27"
    )
}


def softmax_walk(by: str) -> dict[str, str]:
    steps = walk("prob", by, "uid", y="fg")
    return {**_prob, **steps, "err": "SELECT *, abs(fg - p) AS e FROM prob"}


@query(
    "lovasz_softmax",
    t.with_tables(
        "SELECT round(avg(l), 6) AS loss FROM (SELECT class, sum(e * g) AS l FROM grads GROUP BY class)", "slots", extra=softmax_walk("class")
    ),
)
def lovasz_softmax(spark, sf):
    return rounded(L.lovasz_softmax(class_probabilities(spark, sf)), "loss")


@query(
    "lovasz_softmax_grouped",
    t.with_tables(
        "SELECT round(avg(l), 6) AS loss FROM (SELECT grp, avg(l) AS l FROM (SELECT grp, class, sum(e * g) AS l FROM grads "
        "GROUP BY grp, class HAVING sum(fg) > 0) GROUP BY grp)",
        "slots",
        extra=softmax_walk("grp, class"),
    ),
)
def lovasz_softmax_grouped(spark, sf):
    return rounded(L.lovasz_softmax(class_probabilities(spark, sf), group="grp", only_present=True), "loss")


def flat_pairs(spark, sf):
    return t.pairs(spark, sf).select(F.inline(F.arrays_zip("x", "y")))


_bce = "greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))"
_sig = "(1 / (1 + exp(-x)))"


@query("bce_stable", t.with_tables(f"SELECT round(avg({_bce}), 6) AS loss FROM pairs", "pairs"))
def bce_stable(spark, sf):
    return rounded(L.bce_stable(flat_pairs(spark, sf)), "loss")


@query(
    "focal_loss",
    t.with_tables(
        f"SELECT round(avg(CASE WHEN y = 1 THEN {t.dbl(0.25)} ELSE {t.dbl(0.75)} END * ({_bce}) * "
        f"pow(1 - CASE WHEN y = 1 THEN {_sig} ELSE 1 - {_sig} END, 2)), 6) AS loss FROM pairs",
        "pairs",
    ),
)
def focal_loss(spark, sf):
    return rounded(L.focal_loss(flat_pairs(spark, sf)), "loss")


_ce_rows = (
    "SELECT uid, max(code) % 6 AS y, ln(sum(exp(x))) - max(CASE WHEN slot - 22 = code % 6 THEN x END) AS ce "
    "FROM slots WHERE slot BETWEEN 22 AND 27 GROUP BY uid"
)


@query(
    "cross_entropy",
    t.with_tables("SELECT round(avg(ce), 6) AS loss FROM ce", "slots", extra={"ce": _ce_rows}),
)
def cross_entropy(spark, sf):
    rows = t.vectors(spark, sf).select(F.slice("logits", 22, 6).alias("x"), F.get("labels", F.lit(21)).alias("y"))
    return rounded(L.cross_entropy(rows), "loss")


_ce2 = (
    "SELECT uid, ln(sum(exp(x))) - max(CASE WHEN slot - 28 = code % 12 THEN x END) AS ce "
    "FROM slots WHERE slot BETWEEN 28 AND 39 GROUP BY uid"
)


@query(
    "total_loss",
    t.with_tables(
        "SELECT round((SELECT avg(l) FROM (SELECT uid, sum(greatest(e, 0) * g) AS l FROM grads GROUP BY uid)) "
        "+ (SELECT avg(ce) FROM ce) + (SELECT avg(ce) FROM ce2), 6) AS loss",
        "pairs",
        extra={"sides": _two_sides, **walk("sides", "uid", "slot"), "ce": _ce_rows, "ce2": _ce2},
    ),
)
def total_loss(spark, sf):
    return rounded(L.total_loss(t.vectors(spark, sf), CODING_SPEC), "loss")


@query(
    "drop_ignored",
    t.with_tables(
        f"SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(avg({_bce}), 6) AS loss FROM seen",
        "pairs",
        extra={"seen": f"SELECT * FROM ({_void}) WHERE y <> 255"},
    ),
)
def drop_ignored(spark, sf):
    rows = void_pairs(spark, sf).select(F.inline(F.arrays_zip("x", "y")))
    kept = L.drop_ignored(rows, 255)
    loss = L.bce(F.col("x"), F.col("y"))
    return rounded(
        kept.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), F.avg(loss).alias("loss")), "loss"
    )
