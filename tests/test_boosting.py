"""Boosted trees against a dense brute-force version that grows one leaf at a time."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from narracode.operators import boosting as B
from narracode.operators import linear as L
from narracode.operators import models as M


def brute(x, y, model, s):
    """Scores after each round. ``x``: bins of every used feature, dense."""
    n = len(x)
    z = np.tile(model.start, (n, 1))
    widths = np.diff(model.bins.base)
    for _ in range(s.trees):
        g, h = B.slopes(z, y, model.classes, model.kind)
        grown = []
        for k in range(z.shape[1]):
            def best(rows, k=k):
                found = (-np.inf, 0, 0)
                G, H = g[rows, k].sum(), h[rows, k].sum()
                for f in range(x.shape[1]):
                    for b in range(widths[f] - 1):
                        left = rows[x[rows, f] <= b]
                        if min(len(left), len(rows) - len(left)) < s.min_child:
                            continue
                        a, c = g[left, k].sum(), h[left, k].sum()
                        if min(c, H - c) < s.min_curvature:
                            continue
                        gain = a * a / c + (G - a) ** 2 / (H - c) - G * G / H
                        if gain > found[0] + 1e-9:
                            found = (gain, f, b)
                return found

            leaves = [(np.arange(n), best(np.arange(n)))]
            while len(leaves) < s.leaves:
                at = max(range(len(leaves)), key=lambda i: leaves[i][1][0])
                rows, (gain, f, b) = leaves[at]
                if gain <= 1e-12:
                    break
                low = x[rows, f] <= b
                leaves[at : at + 1] = [(r, best(r)) for r in (rows[low], rows[~low])]
            grown.append(leaves)
        for k, leaves in enumerate(grown):
            for rows, _ in leaves:
                z[rows, k] -= s.rate * g[rows, k].sum() / h[rows, k].sum()
    return z


def table(spark, seed, n=160, d=8, classes=2):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 2) * (rng.random((n, d)) < 0.5)
    y = (x[:, 0] - x[:, 1] + 0.3 * x[:, 2] * x[:, 3] + 0.4 * rng.normal(size=n) > 0).astype(int)
    if classes > 2:
        y = y + (x[:, 4] > 0.2)
    rows = []
    for i in range(n):
        at = np.flatnonzero(x[i])
        rows.append((str(i), Vectors.sparse(d, at.tolist(), x[i, at].tolist()) if i % 3 else Vectors.dense(x[i]), int(y[i])))
    return x, y, spark.createDataFrame(rows, ["uid", "features", "y"]).repartition(3)


@pytest.mark.parametrize("kind", ["binary", "categorical"])
def test_trees_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(B, "RANGE", 20)
    monkeypatch.setattr(L, "MATRIX_BYTES", 24 * 200)
    x, y, df = table(spark, 3, classes=2 if kind == "binary" else 3)
    s = B.SparseBoosted(kind, trees=3, leaves=6, min_child=9, bins=7)
    model = M.fit(s, df)
    dense = np.tile(model.bins.zero, (len(x), 1))
    for f in range(x.shape[1]):
        limits = model.bins.limits[model.bins.start[f] : model.bins.start[f + 1]]
        dense[:, f] = np.searchsorted(limits, x[:, f])
    want = brute(dense, y, model, s)
    row, index = np.nonzero(x)
    got = B.raw_scores(model.start, model.rounds, B._Columns.of_entries(model.bins, len(x), row, index, x[row, index]))
    assert np.allclose(got, want, atol=1e-9)
    assert max(sum(f < 0 for f in t.feature) for r in model.rounds for t in r) == 6
    scored = M.scores(model, df, kind).toPandas().set_index("uid").score
    for i in range(0, len(x), 7):
        p = 1 / (1 + np.exp(-want[i, 0])) if kind == "binary" else model.classes[want[i].argmax()]
        assert abs(scored[str(i)] - p) < 1e-9


def test_bins_of_a_value():
    bins = B.Bins(np.array([2, 5]), np.array([0, 3, 4]), np.array([-1.0, 0.0, 2.0, 0.0]), np.array([1, 0]))
    keep, at, code = B.codes(bins, np.array([5, 2, 2, 7, 2, 2]), np.array([3.0, -1.0, 2.5, 1.0, 2.0, 0.5]))
    assert keep.tolist() == [0, 1, 2, 4, 5] and at.tolist() == [1, 0, 0, 0, 0] and code.tolist() == [1, 0, 3, 2, 2]
    assert bins.base.tolist() == [0, 4, 6]


def test_saved_model_and_odd_rows(spark, tmp_path):
    x, y, df = table(spark, 4, n=80)
    df = df.withColumn("y", F.when(F.col("uid") != "5", F.col("y")))
    model = M.fit(M.sparse_boosted("binary", trees=2, min_child=5), df)
    again = M.load_model(spark, M.save_models({"y": model}, str(tmp_path))["y"])
    assert again.as_dict() == model.as_dict()
    a = M.scores(again, df, "binary").toPandas().set_index("uid").score
    assert a["5"] > 0 and len(a) == 80
    none = M.fit(M.sparse_boosted("categorical"), df.limit(0))
    assert none.rounds == []
    flat = M.fit(M.sparse_boosted("binary", trees=3, min_child=50), df)
    assert flat.rounds == [] and abs(M.scores(flat, df, "binary").first().score - y[np.arange(80) != 5].mean()) < 1e-9


@pytest.mark.parametrize("kind", ["binary", "categorical"])
def test_kept_scores_change_no_tree(spark, monkeypatch, kind):
    rng = np.random.default_rng(3)
    x = rng.random((120, 4)) * (rng.random((120, 4)) < 0.7)
    y = (x[:, 0] + x[:, 1] > 0.8).astype(int) + (kind != "binary") * (x[:, 2] > 0.5)
    rows = spark.createDataFrame([(str(i), Vectors.dense(v), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], ["uid", "features", "y"])
    rows = rows.coalesce(1).persist()
    settings = B.SparseBoosted(kind, trees=4, leaves=3)
    sent, look = [], B._look
    monkeypatch.setattr(B, "_look", lambda blocks, model, done, *rest: sent.append(len(model.rounds) - done) or look(blocks, model, done, *rest))
    plain = B.fit(settings, rows).as_dict()
    monkeypatch.setattr(B, "KEPT_ROUNDS", 1)
    del sent[:]
    assert B.fit(settings, rows).as_dict() == plain and len(plain["rounds"]) == 4
    assert max(sent) == 0  # no earlier tree is followed again
