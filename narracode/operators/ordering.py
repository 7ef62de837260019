"""Orders used for batching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narracode.functions.text import record_length


def with_length(records: DataFrame) -> DataFrame:
    return records.withColumn("str_len", record_length(F.col("narrative_le"), F.col("narrative_cme")))


def order_by_length(records: DataFrame) -> DataFrame:
    """Longest record first, ties by key (a range-partitioned sort)."""
    return with_length(records).orderBy(F.desc("str_len"), "uid")


def order_by_text(docs: DataFrame) -> DataFrame:
    """Descending by the text itself."""
    return docs.orderBy(F.desc("text"), "uid")


def layout_by_length(records: DataFrame, length: str = "str_len") -> DataFrame:
    """Put records of like length into the same task, longest first, so that batches need
    little padding. The key breaks ties, so one frequent length still spreads over tasks."""
    ranged = records.repartitionByRange(F.desc(length), "uid")
    return ranged.sortWithinPartitions(F.desc(length), "uid")
