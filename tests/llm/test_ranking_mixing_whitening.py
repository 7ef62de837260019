"""Lexical search, mixing and whitening against brute force, and over odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from narracode.llm import lexical, mixing, whitening
from narracode.llm.queries import QUERIES
from tests.llm.conftest import docs_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(lexical.UPPER, lexical.LOWER)

# ------------------------------------------------ lexical search


def ranked(docs, items, top):
    """``docs`` and ``items``: lists of (id, text)."""
    split = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    n_docs, total = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    df = collections.Counter(w for _, t in split for w in set(t))
    out = []
    for item, text in set(items):
        scores = []
        for i, t in split:
            tf, m = collections.Counter(t), 50 + (50 * len(t) * n_docs) // max(total, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 20 * m))
                for w in set(TERM.findall((text or "").translate(LOWER)))
                if tf[w]
            )
            if score > 0:
                scores.append((-score, i is None, i))
        scores.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(scores[:top])]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()], key=repr)


def test_terms_touch_their_guards():
    counter = lexical.TermCounter(["a", "ab", "b", "é", "x1"])
    text = "a ab,B  a-a\x00é x1 x1 xab abx"
    clean = lexical.guarded(text.encode())
    want = collections.Counter(w for w in TERM.findall(text.translate(LOWER)) if w in ("a", "ab", "b", "é", "x1"))
    for size in (1, 3, 1 << 20):
        found = counter.count(clean, size)
        assert {("a", "ab", "b", "é", "x1")[k]: n for k, n in found.items()} == want
    assert lexical.n_terms(clean) == len(TERM.findall(text)) and lexical.n_terms(b"") == 0 and lexical.n_terms(b"  ") == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 30])
def test_search_against_brute_force(spark, block_bytes):
    rng = random.Random(3)
    vocab = ["Straße", "the", "of", "cat", "dog", "𝒳y", "año", "x1", "Zed", "zed", "rare"]
    docs = [" ".join(rng.choices(vocab, [1, 9, 9, 3, 3, 1, 1, 1, 1, 1, 0.1], k=rng.randrange(0, 40))) for _ in range(150)]
    docs[10] = docs[11] = docs[12] = "cat dog"  # ties
    items = [(1, "The CAT"), (1, "The CAT"), (2, "rare zed 𝒳y"), (3, "nowhere"), (4, "..."), (5, None), (6, "año Straße the")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(lexical.search(docs_of(spark, docs), table, 20, block_bytes))
    assert got == ranked(list(enumerate(docs)), items, 20)


def test_search_of_odd_rows(spark, odd_docs, no_docs):
    items = [(1, "fox jumps", 3), (None, "alpha x", None), (2, None, 1), (3, "endoftext straße", 0)]
    table = spark.createDataFrame(items, "item_id long, text string, score int")
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert rows_of(lexical.search(odd_docs, table)) == ranked(docs, [r[:2] for r in items], 50)
    assert lexical.search(no_docs, table).collect() == []
    assert lexical.search(odd_docs, table.limit(0)).collect() == []


def test_damping_of_giant_counts():
    n = np.array([3, 10**9], np.int64)
    assert lexical.damping(n, 10**10, 10**12).tolist() == [50 + 50 * 3 * 10**10 // 10**12, 50 + 50 * 10**19 // 10**12]


def test_tasks_keep_the_best(monkeypatch):
    monkeypatch.setattr(lexical, "HELD_ROWS", 7)
    rng = np.random.default_rng(2)
    best = lexical._Best(3, 5)
    rows = [(int(a), int(b), i // 2, i % 9 == 0) for i, (a, b) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(1, 30, 200), strict=True))]
    for i in range(0, 200, 3):
        best.add(*(np.array(x) for x in zip(*rows[i : i + 3], strict=True)))
    best.cut()
    want = [sorted(([r for r in rows if r[0] == k]), key=lambda r: (-r[1], r[3], r[2]))[:5] for k in range(3)]
    assert list(zip(*(x.tolist() for x in best.rows), strict=True)) == [r for w in want for r in w]


# ------------------------------------------------ mixing


def mixed(rows, weights=mixing.WEIGHTS, most=mixing.MOST, seed="mix"):
    """``rows``: (doc_id, source, text). The taken words of each, and the targets of the sources."""
    sizes = [len(re.findall(mixing.WORD, t or "")) for _, _, t in rows]
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    own = {s: sum(z for z, r in zip(sizes, rows, strict=True) if r[1] == s) for s in names}
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full: set = set()
    while True:
        rate = (sum(own.values()) - most * sum(own[s] for s in full)) / (sum(w[s] for s in names if s not in full) or 1)
        new = {s for s in names if s in full or rate * w[s] > most * own[s]}
        if new == full:
            break
        full = new
    target = {s: float(most * own[s]) if s in full else rate * w[s] for s in names}
    taken = [0] * len(rows)
    for s in names:
        at = [i for i, r in enumerate(rows) if r[1] == s]
        level = {i: min(sizes[i], mixing.LEVEL) for i in at}
        wish = lambda i: level[i] / (level[i] + mixing.HALF)  # noqa: B023, E731
        low, high = 0.0, 1e9
        for _ in range(200):  # the rate by halving
            middle = (low + high) / 2
            if sum(min(most, middle * wish(i)) * sizes[i] for i in at) < target[s]:
                low = middle
            else:
                high = middle
        e = {i: min(most, high * wish(i)) for i in at}
        whole = {i: math.floor(e[i] + 1e-9) for i in at}
        p = {i: e[i] - whole[i] if e[i] - whole[i] > 1e-9 else 0 for i in at}
        place = {}
        for i in at:
            text = rows[i][2] or ""
            key = f"{seed}|{'' if rows[i][0] is None else rows[i][0]}|{hashlib.md5(text.encode()).hexdigest()}"
            u = (int(hashlib.md5(key.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            if p[i] and sizes[i]:
                place[i] = (u / (1 - u)) / (p[i] / (1 - p[i]))
        gap = max(0.0, target[s] - sum(whole[i] * sizes[i] for i in at))
        chosen: set = set()
        for _ in range(mixing.ROUNDS):
            limit = gap
            for i in sorted((i for i in place if i not in chosen and sizes[i] <= limit), key=lambda i: place[i]):
                if sizes[i] > gap:
                    break
                chosen.add(i)
                gap -= sizes[i]
        left = [(abs(sizes[i] - gap), place[i], i) for i in place if i not in chosen and abs(sizes[i] - gap) < gap]
        if left:
            chosen.add(min(left)[2])
        for i in at:
            taken[i] = sizes[i] * (whole[i] + (i in chosen))
    return sizes, target, taken


@pytest.fixture(scope="module")
def mixture(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "B", "Ä", "tiny", None]) if i < 380 else "few"
        rows.append((i if i % 50 else None, source, "w " * int(rng.lognormvariate(3, 1.2))))
    rows += [(7, "hot", "one two three four five")] * 30 + [(8, "z", ""), (9, "z", None)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string")


@pytest.mark.parametrize("window_rows", [mixing.WINDOW_ROWS, 2])
def test_mix_against_brute_force(mixture, window_rows):
    rows, docs = mixture
    sizes, target, taken = mixed(rows)
    key = lambda r: repr((r[0], *map(int, r[1:3]), round(r[3], 6), int(r[4])))
    own = {s: sum(z for z, r in zip(sizes, rows, strict=True) if r[1] == s) for s in target}
    want = [(r[0], n, own[r[1]], target[r[1]], t) for r, n, t in zip(rows, sizes, taken, strict=True)]
    got = [tuple(r)[:5] for r in mixing.mix(docs.repartition(5), window_rows=window_rows).collect()]
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_mix_reaches_its_targets(mixture):
    rows, docs = mixture
    got = mixing.mix(docs).toPandas()
    assert (got.taken <= 3 * got["size"]).all()
    by = got.groupby(["source_size", "target"]).taken.sum().reset_index()
    assert (abs(by.taken - by.target) <= 0.02 * by.target + 5).all()
    assert abs(by.target.sum() - got["size"].sum()) < 1e-6 * got["size"].sum()


def test_pareto_order_keeps_the_probabilities(spark):
    docs = spark.createDataFrame([(i, "s", "w " * (20 if i % 2 else 60)) for i in range(400)], "doc_id long, source string, text string")
    # one source takes its own words: long documents are taken once and a bit, short ones less
    got = mixing.mix(docs, "a").toPandas().groupby("size").copies.mean()
    level = lambda n: n / (n + mixing.HALF)
    rate = (200 * 20 + 200 * 60) / (200 * (20 * level(20) + 60 * level(60)))
    assert abs(got[20] - rate * level(20)) < 0.1 and abs(got[60] - rate * level(60)) < 0.04


def test_mix_of_odd_rows(odd_docs, no_docs):
    got = mixing.mix(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(r.taken <= 3 * r.size for r in got)
    assert mixing.mix(no_docs).collect() == []
    nothing = mixing.mix(odd_docs.filter("doc_id <= 3")).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 3


# ------------------------------------------------ whitening


def spectra(rng, n):
    yield rng.random(n)
    yield np.ones(n)
    yield np.r_[np.repeat(5.0, min(3, n)), rng.random(max(n - 3, 0))]
    yield np.r_[2.0, 2.0 + 1e-9, rng.random(max(n - 2, 0))][:n]
    yield np.r_[1e6, np.full(n - 1, 1e-3)]
    yield np.r_[rng.random(max(1, n // 2)), np.zeros(n - max(1, n // 2))]


@pytest.mark.parametrize("n", [1, 2, 3, 9, 64])
def test_slices_of_spectra(n):
    rng = np.random.default_rng(n)
    for e in spectra(rng, n):
        q = np.linalg.qr(rng.normal(size=(n, n)))[0]
        v = (q * e) @ q.T
        v = (v + v.T) / 2
        truth = np.sort(np.linalg.eigvalsh(v))[::-1]
        values, vectors = whitening.slice_spectrum(v)
        assert len(values) == min(8, n, (e > 1e-9).sum())
        assert np.allclose(values, truth[: len(values)], rtol=1e-9, atol=1e-12 * truth[0])
        white = (vectors.T @ v @ vectors) / np.sqrt(np.outer(values, values))
        assert np.abs(white - np.eye(len(values))).max() < 1e-6
        for shift in (0.3, 1.0 + 1e-7, 4.9, -1.0):
            assert whitening.above(v, shift) == (truth > shift).sum()


def test_inertia_of_indefinite_matrices():
    rng = np.random.default_rng(4)
    for n in (2, 3, 7, 30):
        for _ in range(20):
            a = rng.normal(size=(n, n)) * rng.integers(0, 2, (n, n))
            a = a + a.T
            assert whitening.inertia(a) == (np.linalg.eigvalsh(a) > 1e-12).sum()


def test_whitening_against_dense_eigenvectors(spark, sf):
    got = QUERIES["op13_whitening"](spark, sf).toPandas().sort_values(["vec_id", "component"])
    raw = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(np.stack(raw.embedding).astype(float) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    z = x - s / n
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    want = z @ u / np.sqrt(e)
    have = got.whitened.to_numpy().reshape(n, 8)
    assert np.allclose(np.abs(want), np.abs(have), atol=1e-7) and np.allclose(np.abs(want.T @ have) / n, np.eye(8), atol=1e-7)
    assert got.deviation.tolist() == np.repeat(((n * x - s) ** 2).sum(axis=1), 8).tolist()
    assert np.allclose(got.explained, np.tile(e / np.trace(v), n), rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(6)
    good = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(20)]
    odd = [(100, None), (101, []), (102, [nan, 1.0, 1.0]), (103, [inf, 1.0, 1.0]), (104, [None, 1.0, 1.0]), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0])]
    table = spark.createDataFrame([*good, *odd, (None, [0.5, 0.5, 0.5]), good[0]], "vec_id long, embedding array<double>").selectExpr("*", "1 AS n", "2 AS whitened")
    got = whitening.whiten(table).toPandas()
    assert len(got) == 22 * 3 and set(got.vec_id.dropna()) == set(range(20)) and got.n.unique().tolist() == [22]
    assert got.identity_error.iloc[0] < 1e-10
    assert whitening.whiten(table.limit(0)).collect() == []
    assert whitening.whiten(table.filter("vec_id = 3")).collect() == []
    # sums of squares beyond 64 bits
    big = spark.createDataFrame([(i, [float(i) * 1e11, 1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    got = whitening.whiten(big).toPandas()
    assert got.deviation.isna().any() and int(got[got.vec_id == 3].deviation_text.iloc[0]) > 2**63
    assert abs((got[got.component == 1].whitened ** 2).mean() - 1) < 1e-9
