"""Losses against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from narracode.operators import losses as L
from narracode.spec import LabelSpec


def steps(truth):
    total = truth.sum()
    union = total + np.cumsum(1 - truth)
    jaccard = 1 - (total - np.cumsum(truth)) / union
    return np.diff(jaccard, prepend=0.0)


def hinge(x, y, present=False):
    if len(y) == 0 or (present and y.sum() == 0):
        return 0.0
    errors = 1 - x * (2 * y - 1)
    order = np.argsort(-errors, kind="stable")
    return float(np.maximum(errors[order], 0) @ steps(y[order]))


def softmax_loss(prob, y, present=False):
    out = []
    for c in range(prob.shape[1]):
        truth = (y == c).astype(int)
        if present and truth.sum() == 0:
            continue
        errors = np.abs(truth - prob[:, c])
        order = np.argsort(-errors, kind="stable")
        out.append(errors[order] @ steps(truth[order]))
    return np.mean(out)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(0, 2, (40, 21)), 1)  # rounding makes equal errors
    y = rng.integers(0, 2, (40, 21))
    y[0], y[1] = 0, 1
    return x, y


def frame(spark, x, y):
    rows = [(str(i), a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "uid string, x array<double>, y array<int>")


def test_hinge_per_record(spark, data):
    x, y = data
    df = frame(spark, x, y)
    assert L.lovasz_hinge(df).first()[0] == pytest.approx(np.mean([hinge(a, b) for a, b in zip(x, y)]))
    present = np.mean([hinge(a, b, True) for a, b in zip(x, y)])
    assert L.lovasz_hinge(df, only_present=True).first()[0] == pytest.approx(present)
    both = np.mean([(hinge(a, b) + hinge(-a, 1 - b)) / 2 for a, b in zip(x, y)])
    assert L.symmetric_lovasz(df).first()[0] == pytest.approx(both)


def test_hinge_with_a_void_label_and_with_nothing_left(spark, data):
    x, y = data
    y = y.copy()
    y[:, ::4] = 255
    y[5] = 255
    want = np.mean([hinge(a[b != 255], b[b != 255]) for a, b in zip(x, y)])
    assert L.lovasz_hinge(frame(spark, x, y), ignore=255).first()[0] == pytest.approx(want)


def test_grad_steps(spark, data):
    x, y = data
    got = L.lovasz_grad(frame(spark, x, y)).filter("uid = '7'").orderBy("pos").collect()
    errors = 1 - x[7] * (2 * y[7] - 1)
    order = np.argsort(-errors, kind="stable")
    assert [r["slot"] for r in got] == order.tolist()
    assert [r["g"] for r in got] == pytest.approx(steps(y[7][order]))
    single = L.lovasz_grad(frame(spark, x[:1, :1], y[1:2, :1])).collect()
    assert [(r["pos"], r["g"]) for r in single] == [(0, 1.0)]


@pytest.mark.parametrize("ranges", [1, 4, 256])
def test_whole_table_hinge_for_any_number_of_ranges(spark, data, ranges):
    x, y = data
    rows = [(float(1 - a * (2 * b - 1)), int(b)) for a, b in zip(x.ravel(), y.ravel())]
    df = spark.createDataFrame(rows, "error double, positive int")
    got = L.lovasz_by_group(df, [], ranges=ranges).first()["loss"]
    assert got == pytest.approx(hinge(x.ravel(), y.ravel()))


def test_whole_table_hinge_when_one_error_holds_most_rows(spark):
    x = np.concatenate([np.zeros(900), np.linspace(-2, 2, 100)])
    y = np.tile([0, 1], 500)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    assert L.lovasz_hinge_flat(df).first()[0] == pytest.approx(hinge(x, y))
    assert L.lovasz_hinge_flat(df.filter("y > 5")).first()[0] == 0.0


@pytest.mark.parametrize("present", [False, True])
def test_softmax_loss(spark, present):
    rng = np.random.default_rng(4)
    logits = rng.normal(0, 1, (60, 5))
    prob = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    y = rng.integers(0, 4, 60)
    group = np.repeat([0, 1, 2], 20)
    rows = [(int(g), p.tolist(), int(c)) for g, p, c in zip(group, prob, y)]
    df = spark.createDataFrame(rows, "g int, prob array<double>, y int")
    assert L.lovasz_softmax(df, only_present=present).first()[0] == pytest.approx(softmax_loss(prob, y, present))
    want = np.mean([softmax_loss(prob[group == g], y[group == g], present) for g in range(3)])
    assert L.lovasz_softmax(df, group="g", only_present=present).first()[0] == pytest.approx(want)
    kept = y != 3
    assert L.lovasz_softmax(df, ignore=3, only_present=True).first()[0] == pytest.approx(
        softmax_loss(prob[kept], y[kept], True)
    )


def test_cross_entropies(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(0, 30, 50), rng.integers(0, 2, 50)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    bce = np.maximum(x, 0) - x * y + np.log1p(np.exp(-np.abs(x)))
    assert L.bce_stable(df).first()[0] == pytest.approx(bce.mean())
    p = 1 / (1 + np.exp(-x))
    right = p * y + (1 - p) * (1 - y)
    focal = (0.25 * y + 0.75 * (1 - y)) * bce * (1 - right) ** 2
    assert L.focal_loss(df).first()[0] == pytest.approx(focal.mean())
    logits, codes = rng.normal(0, 400, (20, 6)), rng.integers(0, 6, 20)
    codes[3] = 255
    rows = [(a.tolist(), int(b)) for a, b in zip(logits, codes)]
    ce = [np.logaddexp.reduce(a) - a[b] for a, b in zip(logits, codes) if b != 255]
    many = spark.createDataFrame(rows, "x array<double>, y int")
    assert L.cross_entropy(many).first()[0] == pytest.approx(np.mean(ce))


def test_total_loss_is_the_sum_of_its_parts(spark):
    spec = LabelSpec(["a", "b"], {"c": 3})
    rng = np.random.default_rng(2)
    logits = rng.normal(0, 2, (30, 5))
    labels = np.c_[rng.integers(0, 2, (30, 2)), rng.integers(0, 3, 30)]
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(logits, labels)], "logits array<double>, labels array<int>")
    sym = np.mean([(hinge(a[:2], b[:2]) + hinge(-a[:2], 1 - b[:2])) / 2 for a, b in zip(logits, labels)])
    ce = np.mean([np.logaddexp.reduce(a[2:]) - a[2 + b[2]] for a, b in zip(logits, labels)])
    assert L.total_loss(df, spec).first()[0] == pytest.approx(sym + ce)


def test_tie_order_does_not_matter(spark):
    df = spark.createDataFrame(
        [("u", [0.5, 0.5, -0.5], [1, 0, 0]), ("v", [-0.5, 0.5, 0.5], [0, 0, 1])], "uid string, x array<double>, y array<int>"
    )
    got = df.select(L.record_hinge(F.col("x"), F.col("y"))).collect()
    assert got[0][0] == pytest.approx(got[1][0])


def test_void_groups_count_as_zero(spark):
    rows = [("a", [0.7, 0.3], 0), ("b", [0.5, 0.5], 255)]
    df = spark.createDataFrame(rows, "g string, prob array<double>, y int")
    alone = L.lovasz_softmax(df.filter("g = 'a'"), group="g", ignore=255).first()["loss"]
    assert L.lovasz_softmax(df, group="g", ignore=255).first()["loss"] == pytest.approx(alone / 2)
    only = L.lovasz_softmax(df.withColumn("y", F.lit(7)), group="g", only_present=True)
    assert only.first()["loss"] == 0.0
