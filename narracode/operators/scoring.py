"""Batched hooks for user models: score vectors and question answers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from narracode.operators.ordering import layout_by_length
from narracode.spec import QUESTIONS


def score_batches(
    docs: DataFrame, make_model: Callable, batch: int = 16, out: str = "vec", layout: bool = True
) -> DataFrame:
    """``uid, vec``: the model's score vector per text.

    ``make_model()`` runs once per Python worker and returns a function from an array of
    texts to a 2-d float array. With ``layout``, records of like length are moved together
    first, which pays for models that pad a batch to its longest text.
    """
    predict = predict_batch_udf(make_model, return_type=ArrayType(FloatType()), batch_size=batch)
    rows = layout_by_length(docs.withColumn("str_len", F.length("text"))) if layout else docs
    return rows.select("uid", predict(F.col("text")).alias(out))


def answer_batches(
    prompts: DataFrame,
    answer_fn: Callable[[list[str], str], list[str]],
    questions: list[str] = QUESTIONS,
    n_yes_no: int = 21,
    batch: int = 2,
) -> DataFrame:
    """``uid, response``: asks the questions in turn over ``uid, prompt``.

    Each cleaned answer is appended to the prompt before the next question.
    ``answer_fn(prompts, question)`` returns one raw answer per prompt.
    """

    def tidy(raw: str, idx: int) -> str:
        text = re.sub(r"Question.*", "", raw.rstrip()).rstrip()
        if idx <= n_yes_no:
            return " yes" if "yes" in text.lower() else " no"
        return " unknown" if text.strip().lower() == "nan" else text

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                chunk = frame.iloc[at : at + batch]
                texts = list(chunk["prompt"])
                lines: list[list[str]] = [[] for _ in texts]
                for idx, question in enumerate(questions, start=1):
                    texts = [f"{t}\nQuestion {idx}: {question}\nAnswer:" for t in texts]
                    answers = [tidy(a, idx) for a in answer_fn(texts, question)]
                    for row, answer in zip(lines, answers, strict=True):
                        row.append(f"Q:{answer}")
                    texts = [t + a for t, a in zip(texts, answers, strict=True)]
                yield pd.DataFrame({"uid": chunk["uid"].to_numpy(), "response": ["\n".join(r) for r in lines]})

    laid_out = layout_by_length(prompts.withColumn("str_len", F.length("prompt"))).select("uid", "prompt")
    return laid_out.mapInPandas(run, "uid string, response string")
