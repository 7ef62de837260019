from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _row int, _h long, kept boolean, n_words int, shard string, chunk int, score double"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 2500
SENTENCE = "the quick brown fox jumps over the lazy dog while seven wizards box with five jolly quacking ducks near a river bank "


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", 1, 2, True, 3, "s", 4, 0.5)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Missing values in every column, empty and very long texts, ties, repeated rows, and
    columns with the names that operators use themselves."""
    rows = [
        row(1, None),
        row(2, ""),
        row(3, " \n\t "),
        row(None, SENTENCE * 4),
        row(4, SENTENCE * 4, None, None),
        row(4, SENTENCE * 4, None, None),
        row(5, LONG),
        row(6, LONG + "one more word"),
        row(7, "x" * 40_000, "de", "b"),
        row(8, "Straße 𝒳 \x00 é́ ▁ <|endoftext|> a@b.co and +1 (386) 555-3733 or 10.0.0.1 or 4111 1111 1111 1111", "de", "b"),
        (None,) * 13,
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def docs_of(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
