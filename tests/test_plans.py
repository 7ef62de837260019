"""What the plans must and must not contain."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from narracode.catalog import all_queries
from narracode.catalog import tables as t
from narracode.operators import features as V
from narracode.operators import losses as L
from narracode.operators import metrics as M
from narracode.operators.ensemble import ensemble_vectors
from narracode.operators.folds import kfold
from narracode.operators.labels import exclude_seen, semi
from narracode.operators.thresholds import running_best, threshold_search
from narracode.spec import CODING_SPEC

# queries that run a Python hook or build vectors
PYTHON = {"answer_batches", "running_best_events", "code_records", "score_batches"}
# queries that fit models when they are built are covered in test_models
FITS = {"fit_linear", "fit_linear_source", "fit_boosted", "cross_val_predict", "chain_feature", "fit_predict_all", "train_with_external", "mixed_registry"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> list[str]:
    return re.findall(r"(?<!Broadcast)Exchange (\w+)", plan(df))


@pytest.mark.parametrize("name", sorted(set(all_queries()) - FITS))
def test_no_cross_join_and_no_stray_python(spark, sf, name):
    text = plan(all_queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON:
        assert not re.search(r"PythonUDF|EvalPython|InPandas|InArrow", text)


def test_losses_per_record_move_no_rows(spark, sf):
    for df in (L.lovasz_hinge(t.pairs(spark, sf)), L.total_loss(t.vectors(spark, sf), CODING_SPEC)):
        assert exchanges(df) == ["SinglePartition"]  # partial sums only
    assert exchanges(L.lovasz_grad(t.pairs(spark, sf))) == []


def test_term_weights_use_one_exchange_of_the_texts(spark, sf):
    vocab = spark.sql("SELECT 'the' AS term, 0 AS term_id, 1.0D AS idf")
    weights = V.packed_weights(V.char_terms(t.docs(spark, sf)), vocab)
    assert "Window" not in plan(weights) and "Python" not in plan(weights)
    assert plan(weights).count("Exchange hashpartitioning(uid") == 1


def test_vocabulary_without_a_limit_is_not_hinted(spark, sf):
    vocab = V.fit_vocab(V.word_terms(t.docs(spark, sf), 1, 1), 100)
    text = V.tfidf(V.word_terms(t.docs(spark, sf), 1, 1), vocab)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in text


def test_packed_ensemble_uses_one_exchange_by_record(spark, sf):
    members = t.member_vectors(spark, sf).withColumnRenamed("logits", "vec")
    limits = spark.createDataFrame([(0, c, 0.5) for c in CODING_SPEC.binary], "model int, label string, thresh double")
    text = plan(ensemble_vectors(members, limits, CODING_SPEC))
    assert len(re.findall(r"Exchange hashpartitioning\(uid", text)) == 1


def test_threshold_search_shuffles_counts(spark, sf):
    text = plan(threshold_search(t.member_scores(spark, sf), ["model", "label"]))
    first = text.rindex("Exchange hashpartitioning")
    assert "partial_count" in text[first:]


def test_running_best_windows_are_cut_into_ranges(spark, sf):
    text = plan(running_best(t.evals(spark, sf)))
    assert "Exchange SinglePartition" not in text
    row_windows = [line for line in text.splitlines() if "Window [" in line and "specifiedwindowframe(RowFrame, unboundedpreceding$(), currentrow$())" in line]
    assert row_windows and all("_range" in line for line in row_windows)


def test_kept_checkpoints_are_limited_before_the_shuffle(spark, sf):
    text = plan(M.keep_checkpoints(t.evals(spark, sf), "f1", 2))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_folds_do_not_move_the_records(spark, sf):
    df = kfold(t.docs(spark, sf), 5, 1)
    text = plan(df)
    ranks = [line for line in text.splitlines() if "row_number()" in line and "Window [" in line]
    assert ranks and all("_range" in line for line in ranks)
    # nothing is exchanged outside the subquery that finds the k bounds, and it has no texts
    assert [line for line in text.splitlines() if "Exchange" in line and "text" in line] == []
    folds_of_wide = {(r["uid"], r["fold"]) for r in df.select("uid", "fold").collect()}
    assert folds_of_wide == {(r["uid"], r["fold"]) for r in kfold(t.docs(spark, sf).select("uid"), 5, 1).collect()}


def test_scans_read_only_needed_columns(spark, sf):
    text = plan(t.labels_wide(spark, sf).select("uid", "quality"))
    assert "ReadSchema: struct<doc_id:bigint,quality:int>" in text
    assert re.search(r"ReadSchema: struct<doc_id:bigint(,text:string)?>", plan(semi(t.docs(spark, sf), t.labels_wide(spark, sf))))
    assert "LeftAnti" in plan(exclude_seen(t.docs(spark, sf), t.labels_wide(spark, sf)))


def test_filters_reach_the_scan(spark, sf):
    kept = t.evals(spark, sf).filter(F.col("label") == "view")
    assert "EqualTo(event_type,view)" in plan(kept)
