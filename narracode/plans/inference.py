"""Ensemble inference: member scores and thresholds to a submission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from narracode.operators.ensemble import ensemble_vectors
from narracode.operators.labels import assign
from narracode.sources.readers import read_member_scores, read_member_thresholds, read_template
from narracode.sources.writers import write_submission
from narracode.spec import CODING_SPEC, LabelSpec


def predict(
    spark: SparkSession, scores_path: str, thresholds_path: str, template: DataFrame, spec: LabelSpec = CODING_SPEC
) -> DataFrame:
    """Template rows with the ensemble's codes written in by key."""
    members = read_member_scores(spark, scores_path)
    thresholds = read_member_thresholds(spark, thresholds_path, spec)
    return assign(template, ensemble_vectors(members, thresholds, spec), spec.columns)


def run(
    spark: SparkSession, scores_path: str, thresholds_path: str, template_path: str, save_path: str, spec: LabelSpec = CODING_SPEC
) -> None:
    template = read_template(spark, template_path, spec)
    codes = ensemble_vectors(
        read_member_scores(spark, scores_path), read_member_thresholds(spark, thresholds_path, spec), spec
    )
    write_submission(codes, template, save_path, spec.columns)
