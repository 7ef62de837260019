"""Text features and per-label classifiers, from records to submission and report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narracode.operators.features import english_stop_words, sent_if_small
from narracode.operators.labels import align, binarize, corpus, semi, to_long
from narracode.operators.metrics import f1_by_label, random_baseline
from narracode.operators.models import (
    FeatureOptions,
    FitResult,
    TextFeatures,
    append_scores,
    fit_predict_all,
    save_run,
    sparse_boosted,
    sparse_linear,
)
from narracode.session import write_table
from narracode.sources import readers, writers
from narracode.spec import LabelSpec


@dataclass
class RunSettings:
    """Features, estimator per label, folds and the label whose score is chained."""

    options: FeatureOptions = field(default_factory=FeatureOptions)
    make_estimator: Callable = lambda label, kind: sparse_linear(kind)
    folds: int = 4
    seed: int = 314159
    chain_from: str | None = "SuicideIntentDisclosed"


def boosted_settings(linear_labels: tuple[str, ...] = ("WeaponType1",), **trees) -> RunSettings:
    """Boosted trees on all n-grams that occur in five records; the named labels stay linear."""
    return RunSettings(
        make_estimator=lambda label, kind: sparse_linear(kind) if label in linear_labels else sparse_boosted(kind, **trees)
    )


def linear_settings() -> RunSettings:
    """Linear models on n-grams of ten to 60 % of the records, without stop words."""
    options = FeatureOptions(min_df=10, max_df=0.6, stop_words=tuple(english_stop_words()))
    return RunSettings(options, folds=5)


def train_and_predict(
    train_records: DataFrame,
    train_labels: DataFrame,
    test_records: DataFrame,
    spec: LabelSpec,
    settings: RunSettings,
    external: DataFrame | None = None,
) -> tuple[TextFeatures, FitResult]:
    """Fit vocabularies on the training corpus, featurise both sides, run every label.

    ``external`` holds another model's outputs per label for both sides. Labels and outputs are narrow
    and go to the features if they are few enough.
    """

    def narrow(rows: DataFrame) -> DataFrame:
        return sent_if_small(write_table(rows, "narrow"))

    train_docs, test_docs = corpus(train_records), corpus(test_records)
    features = TextFeatures.fit(train_docs, settings.options)
    x_train, x_test = features.transform(train_docs), features.transform(test_docs)
    if external is not None:
        for_train = narrow(align(semi(external, train_docs.select("uid")), train_docs.select("uid")))
        for_test = narrow(align(semi(external, test_docs.select("uid")), test_docs.select("uid")))
        x_train = append_scores(x_train, for_train, spec.columns)
        x_test = append_scores(x_test, for_test, spec.columns)
    train = x_train.join(narrow(train_labels), "uid")
    result = fit_predict_all(
        train, x_test, spec, settings.make_estimator, settings.folds, settings.seed, settings.chain_from
    )
    return features, result


def report(result: FitResult, train_labels: DataFrame, spec: LabelSpec, seed: int = 314159) -> DataFrame:
    """``label, kind, f1_half, f1, floor``: out-of-fold F1 at a threshold of one half, at the
    thresholds that were found, and the F1 over all labels of random codes."""
    binary = F.col("kind") == "binary"
    half = result.oof.withColumn("y_hat", F.when(binary, binarize(F.col("score"), F.lit(0.5))).otherwise(F.col("y_hat")))
    at_half = f1_by_label(half).select("label", F.col("f1").alias("f1_half"))
    long = to_long(train_labels.select("uid", *[F.col(c).cast("int").alias(c) for c in spec.columns]), spec.columns)
    kinds = spec.frame(train_labels.sparkSession)
    floor = random_baseline(long, kinds, seed).select("f1").scalar()
    return f1_by_label(result.oof).join(at_half, "label").select("label", "kind", "f1_half", "f1", floor.alias("floor"))


def run_files(
    spark: SparkSession,
    train_path: str,
    labels_path: str,
    test_path: str,
    template_path: str,
    out: str,
    spec: LabelSpec,
    settings: RunSettings,
    multi_line: bool = False,
) -> DataFrame:
    """From record, label and template files to a filled template, the out-of-fold table, the
    saved vocabularies and models, and the report, all below ``out``."""
    train = readers.read_records(spark, train_path, multi_line)
    test = readers.read_records(spark, test_path, multi_line)
    labels = readers.read_labels(spark, labels_path, spec)
    features, result = train_and_predict(train, labels, test, spec, settings)
    template = readers.read_template(spark, template_path, spec)
    writers.write_submission(result.submission, template, f"{out}/submission", spec.columns)
    writers.save_oof(result.oof, f"{out}/oof")
    save_run(features, result, f"{out}/run", chain_from=settings.chain_from)
    report(result, labels, spec, settings.seed).write.parquet(f"{out}/report")
    return spark.read.parquet(f"{out}/report")
