"""Vocabularies by bounds against vocabularies from all totals."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from narracode.operators import features as T


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(2)
    common = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        words = rng.choices(common, [1 / (k + 1) for k in range(60)], k=40) + [f"x{rng.randrange(10**6)}" for _ in range(20)]
        rows.append((str(i), " ".join(words)))
    return spark.createDataFrame(rows, "uid string, text string")


def vocab(terms, **limits):
    return sorted((r.term, r.term_id, r.df, round(r.idf, 9)) for r in T.fit_vocab(terms, 300, **limits).collect())


@pytest.mark.parametrize("limits", [dict(max_features=20), dict(min_df=5, max_df=0.6, max_features=15), dict(min_df=2, max_features=5000), dict(min_df=3)])
def test_same_vocabulary_as_from_all_totals(texts, limits):
    assert vocab(T.word_terms(texts, 1, 2, keys=("_b", "uid")), **limits) == vocab(T.word_terms(texts, 1, 2), **limits)
    assert vocab(T.char_terms(texts, keys=("_b", "uid")), **limits) == vocab(T.char_terms(texts), **limits)


def test_rare_terms_stay_in_their_bucket(spark, texts):
    by_bucket = T.write_table(T.bucket_totals(T.word_terms(texts, 1, 1, keys=("_b", "uid"))), "test")
    every = by_bucket.select("term").distinct().count()
    found = T.frequent_totals(by_bucket, F.lit(300), 1, 1.0, 20)
    assert found is not None and found.count() < 100 < 5000 < every
    # too few terms in the limits, and too many candidates
    assert T.frequent_totals(by_bucket, F.lit(300), 1, 1.0, 10**5) is None
    assert T.frequent_totals(by_bucket, F.lit(300), 1, 1.0, 20, broadcast_terms=3) is None


def test_buckets_are_added_up_without_an_exchange(texts):
    plan = T.bucket_totals(T.char_terms(texts, keys=("_b", "uid")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the texts themselves
