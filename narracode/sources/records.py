"""Quoted CSV with line breaks inside fields, read in splits.

Whether a line break ends a record depends on the quotes before it, up to the start of the file. A
split cannot know them, but it can count its quotes: an even number leaves the state at its start as
it is, an odd number turns it round. So every split gives a transfer function of one bit, a prefix
pass over the splits of a file (a row each) gives the state at each split's start, and the split then
knows which of its lines begin a record. Lines are put together inside their split; what a split
holds of a record that began before goes to the split where it began, as one piece. Fields are
parsed by Spark's own parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def quotes(text: Column) -> Column:
    """Quotes of a line; a doubled quote counts twice and so changes nothing."""
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``_file, _start, _id, value``: lines by file and split, in order; only a line feed ends one."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )


def has_broken_records(spark: SparkSession, path: str) -> bool:
    """Whether some line holds an odd number of quotes: one pass, nothing is shuffled."""
    found = lines(spark, path).filter(quotes(F.col("value")) % 2 == 1).limit(1)
    return len(found.select(F.lit(1)).collect()) > 0


def split_states(counted: DataFrame) -> DataFrame:
    """``_file, _start, _odd, _owner``: the state at each split's start (1 inside quotes), and the
    start of the split in which the record began that goes on at the split's start.

    ``counted`` has ``_file, _start``, the quotes ``_q`` of a split, and the numbers of lines ``_even``
    and ``_odds`` that have an even and an odd number of quotes before them in the split: as many
    records begin there for either state."""
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    known = counted.withColumn("_odd", F.coalesce(F.sum("_q").over(before), F.lit(0)) % 2)
    known = known.withColumn("_begins", F.when(F.col("_odd") == 0, F.col("_even")).otherwise(F.col("_odds")))
    owner = F.max(F.when(F.col("_begins") > 0, F.col("_start"))).over(before)
    return known.select("_file", "_start", "_odd", "_begins", owner.alias("_owner"))


def record_texts(spark: SparkSession, path: str) -> DataFrame:
    """``_file, _start, _record, text`` of every record, the header included: the split where it
    begins and its number there from 1. Empty lines between records are left out."""
    rows = lines(spark, path).withColumn("_quotes", quotes(F.col("value")))
    in_split = Window.partitionBy("_file", "_start").orderBy("_id")
    parity = (F.sum("_quotes").over(in_split) - F.col("_quotes")) % 2
    rows = rows.withColumn("_parity", parity)
    counted = rows.groupBy("_file", "_start").agg(
        F.sum("_quotes").alias("_q"), F.count_if(F.col("_parity") == 0).alias("_even"), F.count_if(F.col("_parity") == 1).alias("_odds")
    )
    states = split_states(counted)
    rows = rows.join(states.drop("_owner", "_begins"), ["_file", "_start"])
    begins = (F.col("_parity") == F.col("_odd")).cast("int")
    rows = rows.withColumn("_record", F.sum(begins).over(in_split))
    pieces = rows.groupBy("_file", "_start", "_record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_id", "value"))), lambda x: x["value"]), "\n").alias("text")
    )
    pieces = pieces.join(states.drop("_odd"), ["_file", "_start"])
    # only the first and the last piece of a split can be part of a record that spans splits
    goes_on = F.col("_record") == 0
    at_edge = goes_on | (F.col("_record") == F.col("_begins"))
    inner = pieces.filter(~at_edge).select("_file", "_start", "_record", "text")
    edge = pieces.filter(at_edge).withColumn("_from", F.when(goes_on, F.col("_owner")).otherwise(F.col("_start")))
    joined = edge.groupBy("_file", F.col("_from").alias("_start")).agg(
        F.max("_record").alias("_record"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_start").alias("s"), "text"))), lambda x: x["text"]), "\n").alias("text"),
    )
    whole = inner.unionByName(joined.select("_file", "_start", "_record", "text"))
    text = F.regexp_replace("text", "\r$", "")
    return whole.withColumn("text", text).filter(F.col("text") != "")


def read_quoted(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV files with a header whose quoted fields may hold line breaks."""
    texts = record_texts(spark, path)
    # a file's header is the first record of its first split
    body = texts.filter(~((F.col("_start") == 0) & (F.col("_record") == 1)))
    options = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}
    return body.select(F.from_csv("text", schema, options).alias("_r")).select("_r.*")
