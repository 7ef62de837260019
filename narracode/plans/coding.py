"""Question answering: records to prompts, answers, codes, and a submission."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from narracode.operators.answers import answers_to_codes, render_examples, render_prompt
from narracode.operators.labels import align
from narracode.operators.scoring import answer_batches


def code_records(
    records: DataFrame, train: DataFrame, train_labels: DataFrame, answer_fn: Callable, template_cols: list[str] | None = None
) -> DataFrame:
    """Codes for each record from ``answer_fn``; ``train`` (with a position column ``pos``) and
    its labels give the example block."""
    examples = render_examples(train, train_labels)
    responses = answer_batches(render_prompt(records, examples), answer_fn)
    return align(answers_to_codes(responses, template_cols), records.select("uid"))
