"""Document rows with a key that survives missing and repeated ids and clashing column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed(docs: DataFrame) -> DataFrame:
    """``_id, _h, _text, _row``: the id, a hash of the text, the text, and the whole row.

    Rows of one id with different texts are different documents; rows with equal id and text
    are copies. Other columns of ``docs`` stay inside ``_row``, whatever their names.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h"), F.col("text").alias("_text"), row)


def same_document(a: DataFrame, b: DataFrame) -> Column:
    """Join condition on the key of ``keyed``; missing ids are equal to each other."""
    return a["_id"].eqNullSafe(b["_id"]) & (a["_h"] == b["_h"])
