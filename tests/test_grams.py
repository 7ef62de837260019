"""N-grams counted as numbers against the terms' rows, totals as lists, counts as planes."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from narracode.operators import features as T
from narracode.operators import grams as G
from narracode.operators import linear as L
from narracode.operators import models as M


def rows_of(n: int) -> list[tuple[str | None, str | None]]:
    rng = random.Random(n)
    word = lambda: "".join(rng.choices("abcé日𝄞", k=rng.choice([1, 1, 2, 3, 9])))
    rows = [(str(i % (n - 5)), " ".join(word() for _ in range(rng.randrange(40)))) for i in range(n)]
    return [*rows, (None, "aa bb aa"), (None, "aa"), ("x", None), ("y", ""), ("z", " \t\n")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(80), "uid string, text string")


def totals(df):
    return sorted((r.term, r.df, r.tf) for r in df.select("term", "df", "tf").collect())


@pytest.mark.parametrize("piece", [7, 1 << 17])
def test_totals_are_those_of_the_rows(docs, monkeypatch, piece):
    monkeypatch.setattr(G, "PIECE_TOKENS", piece)
    monkeypatch.setattr(G, "PAIRS", piece)
    monkeypatch.setattr(G, "HELD_TERMS", piece)
    for low, high in ((1, 3), (2, 2)):
        want = totals(T.term_totals(T.word_terms(docs, low, high, ["aa"])))
        assert totals(T.word_totals(docs, low, high, ["aa"])) == totals(G.add_up(T.word_terms(docs, low, high, ["aa"]), 3)) == want
    for low, high in ((3, 6), (5, 6)):  # words shorter than the least length are taken as they are
        assert totals(T.char_totals(docs, low, high)) == totals(T.term_totals(T.char_terms(docs, low, high)))


@pytest.mark.parametrize("k", [3, 10, 10**4])
@pytest.mark.parametrize("cells", [64, 1 << 12])
def test_vocabulary_by_cells_is_that_of_all_totals(docs, monkeypatch, k, cells):
    monkeypatch.setattr(G, "CELLS", cells)
    monkeypatch.setattr(G, "CELL_RANGE", 16)
    want = T.fit_vocab(T.word_terms(docs, 1, 2), 85, 2, 0.9, k)
    got = T.fit_word_vocab(docs, 85, 1, 2, None, 2, 0.9, k)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("options", [M.FeatureOptions(min_df=1, max_features=60), M.FeatureOptions((1, 2), (5, 6), 2, stop_words=("aa",))])
def test_weights_are_those_of_the_joins(docs, options, monkeypatch):
    features = M.TextFeatures.fit(docs, options)
    monkeypatch.setattr(G, "PIECE_TOKENS", 50)
    want = {r.uid: [(e.term_id, pytest.approx(e.w)) for e in r.entries] for r in features.packed(docs).collect() if r.uid is not None}
    got = features.transform(docs).collect()
    assert sorted(r.uid or "" for r in got) == sorted(u or "" for u, _ in rows_of(80))
    for r in got:
        assert list(zip(r.features.indices.tolist(), r.features.values.tolist(), strict=True)) == want.get(r.uid, [])


def test_counts_are_kept_small(spark):
    x = np.array([0, 1, 255, 256, 70_000, 2**31 - 1], np.int32)
    lengths, back = G.from_planes([G.planes(x[:2]), G.planes(x[:0]), G.planes(x[2:])])
    assert lengths.tolist() == [2, 0, 4] and (back == x).all()


def test_only_marked_terms_are_sent(spark, docs):
    """A rare term outside the cells that count does not leave its task."""
    every = T.word_totals(docs, 1, 2)
    cells = G.word_cells(T._word_lists(docs, None), 1, 2)
    assert cells.sum() == every.agg(F.sum("tf")).first()[0]
    some = T.word_totals(docs, 1, 2, cells=cells >= 20)
    frequent = every.filter("tf >= 20")
    assert frequent.exceptAll(some).count() == 0 < some.count() < every.count() / 2


def test_a_fit_writes_no_blocks_and_leaves_nothing_held(spark, docs, monkeypatch):
    features = M.TextFeatures.fit(docs, M.FeatureOptions(min_df=2))
    train = features.transform(docs.filter("uid is not null")).withColumn("y", (F.length("uid") % 2).cast("int"))
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    model = M.fit(M.sparse_linear("binary"), train)
    assert model.numFeatures == features.n_word + features.n_char
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before
    blocks, dim = L.pack(train, ["y"])
    assert blocks.storageLevel.useMemory and dim == model.numFeatures and L.classes_in(blocks, ["y"]) == L.classes_of(train, ["y"])
    blocks.unpersist()
    assert pa.types.is_binary(blocks.select("ptr").toArrow().schema.field(0).type)
