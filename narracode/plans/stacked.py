"""Coded answers as features of the saved classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from narracode.operators.labels import corpus
from narracode.operators.models import RegistryEntry, mixed_predict
from narracode.session import write_table


def predict(
    records: DataFrame,
    answer_codes: DataFrame,
    registry: list[RegistryEntry],
    label_cols: list[str],
    chain_from: str | None = None,
) -> DataFrame:
    """``uid, label, y_hat`` for records whose answers were coded by
    :func:`narracode.plans.coding.code_records`; each label uses the run its registry entry
    names."""
    codes = write_table(answer_codes, "answer_codes")
    return mixed_predict(corpus(records), registry, codes, label_cols, chain_from)
