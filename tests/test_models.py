"""Fits, out-of-fold scores, chaining, hooks and whole protocols."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from narracode.operators import models as M
from narracode.operators.scoring import answer_batches, score_batches
from narracode.plans import stacked
from narracode.plans.classify import RunSettings, boosted_settings, linear_settings, run_files, train_and_predict
from narracode.plans.coding import code_records
from narracode.session import scratch_path
from narracode.spec import CODING_SPEC, QUESTIONS, LabelSpec

SPEC = LabelSpec(["hot", "wet"], {"kind": 3})
OPTIONS = M.FeatureOptions(word_range=(1, 1), char_range=(3, 3), min_df=2, max_features=60)


def settings(chain_from=None):
    return RunSettings(OPTIONS, folds=3, chain_from=chain_from)



@pytest.fixture(scope="module")
def labelled(spark):
    """Texts whose words tell the labels."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(120):
        hot, wet, kind = int(i % 2), int(i % 3 == 0), int(i % 3) + 1
        words = ["sun" if hot else "ice", "rain" if wet else "dust", ["red", "green", "blue"][kind - 1]]
        words += list(rng.choice(["one", "two", "three", "four"], 5))
        rng.shuffle(words)
        rows.append((str(i), " ".join(words[:4]), " ".join(words[4:])))
        labels.append((str(i), hot, wet, kind))
    return (
        spark.createDataFrame(rows, "uid string, narrative_le string, narrative_cme string"),
        spark.createDataFrame(labels, "uid string, hot int, wet int, kind int"),
    )


def numeric(spark, n=90):
    rng = np.random.default_rng(1)
    rows = [(str(i), Vectors.dense(rng.normal(y, 0.3), rng.normal()), y, i % 3) for i in range(n) for y in [int(i % 2)]]
    return spark.createDataFrame(rows, ["uid", "features", "y", "fold"])


def test_out_of_fold_scores_cover_every_row_once(spark):
    got = M.cross_val_predict(numeric(spark), M.linear("binary"), "binary", 3).collect()
    assert len({r["uid"] for r in got}) == len(got) == 90
    assert np.mean([(r["score"] > 0.5) == bool(r["y"]) for r in got]) > 0.9
    assert all(int(r["uid"]) % 3 == r["fold"] for r in got)


@pytest.mark.parametrize("estimator", ["linear", "boosted"])
def test_categorical_models(spark, estimator):
    rng = np.random.default_rng(3)
    rows = [(str(i), Vectors.dense(*np.eye(3)[i % 3] + rng.normal(0, 0.1, 3)), i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, ["uid", "features", "y"])
    make = M.linear("categorical") if estimator == "linear" else M.boosted("categorical", trees=2, depth=2, select=3)
    scored = M.scores(M.fit(make, df), df, "categorical")
    assert scored.filter(F.col("score") == F.col("y")).count() >= 85


def test_chain_feature_appends_the_score_by_key(spark):
    df = numeric(spark)
    score = df.select("uid", F.col("uid").cast("double").alias("score")).orderBy(F.rand(1))
    got = M.chain_feature(df, score).select("uid", vector_to_array("features").alias("v")).collect()
    assert all(len(r["v"]) == 3 and r["v"][2] == float(r["uid"]) for r in got)


def test_protocol_learns_and_chains(spark, labelled):
    records, labels = labelled
    features, result = train_and_predict(records, labels, records, SPEC, settings("hot"))
    assert set(result.models) == set(SPEC.columns) and result.thresholds["kind"] is None
    assert min(result.scores.values()) > 0.95
    assert result.oof.count() == 3 * 120
    assert M.cross_val_score(result.oof).first()["f1"] > 0.95
    codes = result.submission.join(labels.toDF("uid", "h", "w", "k"), "uid")
    assert codes.count() == 120
    assert codes.filter("hot = h and wet = w and kind = k").count() >= 115
    width = features.n_word + features.n_char
    assert result.models["hot"].numFeatures == width
    assert result.models["wet"].numFeatures == width + 1
    assert result.models["kind"].numFeatures == width


def test_external_scores_become_features(spark, labelled):
    records, labels = labelled
    external = labels.select("uid", F.col("hot").cast("double").alias("hot"))
    features, result = train_and_predict(
        records, labels.select("uid", "hot"), records, LabelSpec(["hot"]), settings(), external
    )
    assert result.models["hot"].numFeatures == features.n_word + features.n_char + 1
    assert result.scores["hot"] == 1.0


def test_registry_mixes_runs(spark, labelled):
    records, labels = labelled
    docs = records.select("uid", F.concat_ws(" ", "narrative_le", "narrative_cme").alias("text"))
    base = scratch_path(spark, "test_registry")
    entries = []
    for label, kind, options in (("hot", "binary", OPTIONS), ("kind", "categorical", replace(OPTIONS, max_features=40))):
        features = M.TextFeatures.fit(docs, options)
        features.save(f"{base}/{label}/features")
        y = F.col(label) - (0 if kind == "binary" else 1)
        rows = features.transform(docs).join(labels.select("uid", y.alias("y")), "uid")
        paths = M.save_models({label: M.fit(M.linear(kind), rows)}, f"{base}/{label}/models")
        entries.append(M.RegistryEntry(label, kind, paths[label], f"{base}/{label}/features", 0.5))
    got = M.mixed_predict(docs, entries)
    long = labels.unpivot(["uid"], ["hot", "kind"], "label", "y")
    assert got.join(long, ["uid", "label"]).filter("y_hat = y").count() >= 235


def test_saved_run_predicts_what_it_predicted(spark, labelled):
    """External outputs and the chained score reach the saved models again."""
    records, labels = labelled
    codes = labels.select("uid", *[F.col(c).cast("double").alias(c) for c in SPEC.columns])
    features, result = train_and_predict(records, labels, records, SPEC, settings("hot"), codes)
    entries = M.save_run(features, result, scratch_path(spark, "run"), external=True, chain_from="hot")
    assert [(e.label, e.chained) for e in entries] == [("hot", False), ("wet", True), ("kind", False)]
    again = stacked.predict(records, codes, entries, SPEC.columns, "hot")
    first = result.submission.unpivot(["uid"], SPEC.columns, "label", "code")
    assert again.join(first, ["uid", "label"]).filter("y_hat = code").count() == 360
    loaded = M.TextFeatures.load(spark, entries[0].feature_path)
    assert loaded.options == OPTIONS and loaded.n_word == features.n_word


def test_presets(spark):
    assert type(boosted_settings(trees=3).make_estimator("a", "binary")).__name__ == "SparseBoosted"
    assert type(boosted_settings().make_estimator("WeaponType1", "categorical")).__name__ == "SparseLinear"
    preset = linear_settings()
    assert (preset.options.min_df, preset.options.max_df, preset.folds) == (10, 0.6, 5) and "the" in preset.options.stop_words


def test_a_record_without_known_terms_is_kept(spark, labelled):
    records, _ = labelled
    docs = records.select("uid", F.concat_ws(" ", "narrative_le", "narrative_cme").alias("text"))
    features = M.TextFeatures.fit(docs, OPTIONS)
    odd = spark.createDataFrame([("x", "zzzz"), ("y", "")], "uid string, text string")
    got = features.transform(odd).collect()
    assert {r["uid"]: r["features"].numNonzeros() for r in got} == {"x": 0, "y": 0}


# ------------------------------------------------------------------------- hooks


def echo_model():
    def run(texts):
        return np.array([[len(x), x.count("a")] for x in texts], dtype="float32")

    return run


def test_score_batches_keeps_every_text(spark):
    texts = [(str(i), "a" * i + "b") for i in range(70)]
    got = {r["uid"]: list(r["vec"]) for r in score_batches(spark.createDataFrame(texts, "uid string, text string"), echo_model, 16).collect()}
    assert got == {u: [len(x), x.count("a")] for u, x in texts}


def ask(prompts, question):
    return [" Yes, so" if len(p) % 2 else " nan Question 1: x\nrest" for p in prompts]


def answers_in_turn(prompt):
    lines = []
    for idx, question in enumerate(QUESTIONS, start=1):
        prompt = f"{prompt}\nQuestion {idx}: {question}\nAnswer:"
        odd = len(prompt) % 2 == 1
        if idx <= 21:
            answer = " yes" if odd else " no"
        else:
            answer = " Yes, so" if odd else " nan \nrest"
        lines.append("Q:" + answer)
        prompt += answer
    return "\n".join(lines)


def test_answers_feed_the_next_question(spark):
    prompts = [(str(i), "p" * i) for i in range(15)]
    got = answer_batches(spark.createDataFrame(prompts, "uid string, prompt string"), ask, batch=4)
    assert {r["uid"]: r["response"] for r in got.collect()} == {u: answers_in_turn(p) for u, p in prompts}


def always(prompts, question):
    return [" Shotgun" if question.startswith("Type of weapon") else " yes"] * len(prompts)


def test_records_to_codes(spark, labelled):
    records, _ = labelled
    train = records.withColumn("pos", F.col("uid").cast("int"))
    zeros = records.select("uid", *[F.lit(0).alias(c) for c in CODING_SPEC.binary], F.lit(1).alias("InjuryLocationType"), F.lit(5).alias("WeaponType1"))
    got = code_records(records, train, zeros, always).collect()
    assert len(got) == 120
    assert all(r["Argument"] == 1 and r["InjuryLocationType"] == 6 and r["WeaponType1"] == 5 for r in got)


def test_records_without_scores_fail(spark):

    from narracode.operators.features import stack_features

    x = spark.createDataFrame([("a", Vectors.dense([1.0])), ("b", Vectors.dense([2.0]))], ["uid", "features"])
    external = spark.createDataFrame([("a", 0.5)], "uid string, s double")
    for df in (M.append_scores(x, external, ["s"]), M.chain_feature(x, external.withColumnRenamed("s", "score")), stack_features(x, external)):
        with pytest.raises(Exception, match="record b"):
            df.collect()


def test_from_files_to_files(spark, labelled, tmp_path):
    from narracode.sources.readers import read_labels
    from narracode.sources.writers import write_csv

    records, labels = labelled
    named = records.withColumnsRenamed({"narrative_le": "NarrativeLE", "narrative_cme": "NarrativeCME"})
    write_csv(named, str(tmp_path / "records"))
    write_csv(labels, str(tmp_path / "labels"))
    write_csv(labels.select("uid", *[F.lit(0).alias(c) for c in SPEC.columns]), str(tmp_path / "template"))
    paths = [str(tmp_path / n) for n in ("records", "labels", "records", "template", "out")]
    got = {r["label"]: r for r in run_files(spark, *paths, SPEC, settings()).collect()}
    assert set(got) == set(SPEC.columns) and all(r["f1"] > 0.9 and r["floor"] < 0.8 for r in got.values())
    assert all(r["f1_half"] <= r["f1"] + 1e-9 for r in got.values())
    filled = read_labels(spark, str(tmp_path / "out/submission"), SPEC).join(labels, "uid").filter("uid is not null")
    assert filled.count() == 120
    assert spark.read.parquet(str(tmp_path / "out/oof")).count() == 360
