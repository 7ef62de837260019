"""Partitions of texts, weights without an exchange of n-grams, rows without keys."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from narracode.operators import features as T
from narracode.operators import models as M

TEXTS = [(str(i), f"red blue w{i % 7} green{i % 5} blue") for i in range(60)]
OPTIONS = M.FeatureOptions(min_df=2, max_features=50)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "uid string, text string")


def test_partitions_follow_the_bytes_of_the_texts(spark, docs):
    size = sum(len(text) for _, text in TEXTS)
    for keys in (("uid",), ("_b", "uid")):
        assert T.by_record(docs, keys, 20).rdd.getNumPartitions() == -(-size // 20)
    assert T.by_record(docs).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_only_the_texts_move_for_the_weights(docs):
    features = M.TextFeatures.fit(docs, OPTIONS)
    plan = features.packed(docs)._jdf.queryExecution().executedPlan().toString()
    moved = re.findall(r"(?<!Broadcast)Exchange (\w+\([^)]*\), \w+)", plan)
    assert moved and all("REPARTITION_BY_NUM" in x for x in moved)


def test_rows_without_a_key_and_repeated_keys(spark, docs):
    more = docs.unionByName(spark.createDataFrame([(None, "red blue"), (None, "blue"), ("3", "red"), ("x", None)], docs.schema))
    features = M.TextFeatures.fit(docs, OPTIONS)
    rows = features.transform(more).collect()
    assert sorted(r.uid or "" for r in rows) == sorted([u for u, _ in TEXTS] + ["3", "x", "", ""])
    sizes = {r.uid: r.features.numNonzeros() for r in rows}
    assert sizes[None] == sizes["x"] == 0 < sizes["3"]
    assert len({r.features for r in rows if r.uid == "3"}) == 1


def test_summaries_are_skipped_where_they_hold_most_rows(docs):
    by_bucket = T.write_table(T.bucket_totals(T.word_terms(docs, 1, 1, keys=("_b", "uid"))), "test")
    buckets = by_bucket.agg(F.count_distinct("_b")).first()[0]
    k = -(-by_bucket.count() // (2 * buckets))
    assert T.frequent_totals(by_bucket, F.lit(60), 1, 1.0, k) is None
