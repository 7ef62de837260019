"""The one-pass solver against a plain solver, single fits, and its job count."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from narracode.operators import linear as L
from narracode.operators import models as M


def loss_and_slope(m, huber):
    if huber:
        return np.where(m < -1, -4 * m, np.where(m < 1, (1 - m) ** 2, 0)), np.where(m < -1, -4, np.where(m < 1, -2 * (1 - m), 0))
    return np.logaddexp(0, -m), -1 / (1 + np.exp(m))


def plain(x, sign, alpha, huber, steps=60_000):
    """Proximal gradient descent with a safe step, one problem."""
    n, d = x.shape
    with_one = np.column_stack([x, np.ones(n)])
    step = 1 / ((2.0 if huber else 0.25) * np.linalg.eigvalsh(with_one.T @ with_one / n)[-1])
    w, v, t = np.zeros(d + 1), np.zeros(d + 1), 1.0
    for _ in range(steps):
        g = with_one.T @ (sign * loss_and_slope(sign * (with_one @ v), huber)[1]) / n
        new = v - step * g
        new[:d] = np.sign(new[:d]) * np.maximum(np.abs(new[:d]) - step * alpha, 0)
        if (v - new) @ (new - w) > 0:
            t, v = 1.0, new
        else:
            t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            v, t = new + (t - 1) / t1 * (new - w), t1
        if np.abs(new - w).max() < 1e-12:
            break
        w = new
    return w[:d], w[d]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n, d = 240, 60
    x = rng.normal(size=(n, d)) * (rng.random((n, d)) < 0.2)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    a = (x[:, :5].sum(axis=1) + 0.2 * rng.normal(size=n) > 0).astype(int)
    b = (x[:, 3:9].sum(axis=1) + 0.2 * rng.normal(size=n) > 0.3).astype(int)
    c = np.argmax(x[:, 10:13] + 0.1 * rng.normal(size=(n, 3)), axis=1)
    folds = rng.integers(0, 3, (n, 3))
    rows = []
    for i in range(n):
        at = np.flatnonzero(x[i])
        v = Vectors.sparse(d, at.tolist(), x[i, at].tolist()) if i % 2 else Vectors.dense(x[i])
        rows.append((str(i), v, int(a[i]), int(b[i]) if i % 17 else None, int(c[i]), *map(int, folds[i])))
    df = spark.createDataFrame(rows, ["uid", "features", "a", "b", "c", "fa", "fb", "fc"])
    return x, a, np.where(np.arange(n) % 17, b, -1), c, folds, df.repartition(3)


def test_all_problems_equal_a_plain_solver(table):
    x, a, b, c, folds, df = table
    estimators = {k: M.sparse_linear(kind, 5e-3, tol=1e-5) for k, kind in (("a", "binary"), ("b", "binary"), ("c", "categorical"))}
    models, oof = M.fit_stack(df, estimators, {k: f"f{k}" for k in "abc"}, 3)
    for name, y, huber in (("a", a, False), ("b", b, False), ("c", c, True)):
        some = y >= 0
        for k, target in enumerate(models[name].classes):
            w, i = plain(x[some], np.where(y[some] == target, 1.0, -1.0), 5e-3, huber)
            assert np.abs(models[name].coefficients()[:, k] - w).max() < 1e-4 and abs(models[name].intercepts[k] - i) < 1e-4
            assert 0 < (w != 0).sum() < 60
    got = {(r.uid, r.label): r for r in oof.collect()}
    assert len(got) == 3 * len(x)
    for f in range(3):  # out of fold, one label of each loss
        train = folds[:, 0] != f
        w, i = plain(x[train], np.where(a[train] == 1, 1.0, -1.0), 5e-3, False)
        for j in np.flatnonzero(~train):
            assert abs(got[str(j), "a"].score - 1 / (1 + np.exp(-(x[j] @ w + i)))) < 1e-4 and got[str(j), "a"].fold == f
        train = folds[:, 2] != f
        fits = [plain(x[train], np.where(c[train] == k, 1.0, -1.0), 5e-3, True) for k in range(3)]
        z = np.column_stack([x @ w + i for w, i in fits])
        clear = np.sort(z, axis=1)[:, -1] - np.sort(z, axis=1)[:, -2] > 1e-3
        for j in np.flatnonzero(~train & clear):
            assert got[str(j), "c"].score == z[j].argmax()
    assert got["0", "b"].y is None


def test_working_set_loses_nothing(table, monkeypatch):
    """A feature at a time, one problem a pass over all features, tiny ranges and pieces."""
    monkeypatch.setattr(L, "GROWTH", 3)
    monkeypatch.setattr(L, "MATRIX_BYTES", 8 * 60)
    monkeypatch.setattr(L, "RANGE", 7)
    monkeypatch.setattr(L, "CELLS", 50)
    monkeypatch.setattr(L, "BLOCK_ENTRIES", 100)
    x, a, _, _, _, df = table
    model = M.fit(M.sparse_linear("binary", 1e-2, tol=1e-4), df.withColumn("y", F.col("a")))
    w, i = plain(x, np.where(a == 1, 1.0, -1.0), 1e-2, False)
    assert np.abs(model.coefficients()[:, 0] - w).max() < 1e-3 and abs(model.intercepts[0] - i) < 1e-3


def jobs(spark, name, run):
    tracker, group = spark.sparkContext.statusTracker(), f"count-{name}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(tracker.getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_labels(spark, table):
    df = table[-1]
    settings = dict(tol=0.5, max_iter=3)

    def fit(labels):
        estimators = {c: M.sparse_linear("binary", 1e-2, **settings) for c in labels}
        return lambda: M.fit_stack(df.withColumns({c: F.col("a") for c in labels}), estimators, {c: "fa" for c in labels}, 3)[1].collect()

    one, many = jobs(spark, "one", fit(["l0"])), jobs(spark, "many", fit([f"l{i}" for i in range(12)]))
    assert one <= many <= one + 2


def test_odd_rows(spark, tmp_path):
    rows = [("a", Vectors.sparse(4, [], []), 1), ("b", Vectors.dense([1.0, 0.0, 0.0, 0.0]), 0), ("c", Vectors.sparse(4, [0], [1.0]), None)]
    df = spark.createDataFrame(rows, ["uid", "features", "y"])
    model = M.fit(M.sparse_linear("binary"), df)
    got = {r.uid: r.score for r in M.scores(model, df, "binary").collect()}
    assert got["a"] > 0.9 and got["b"] < 0.1 and got["c"] == got["b"]
    paths = M.save_models({"y": model}, str(tmp_path))
    again = M.load_model(spark, paths["y"])
    assert np.allclose(again.coefficients(), model.coefficients()) and (again.kind, again.loss, again.classes) == ("binary", "log", [1])
    none = M.fit(M.sparse_linear("binary"), df.limit(0))
    assert none.numFeatures == 0 and M.scores(none, df, "binary").count() == 3
