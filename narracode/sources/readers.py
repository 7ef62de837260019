"""Readers of record, label, template, score and threshold files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narracode.functions.text import tokens_to_null
from narracode.sources.records import has_broken_records, read_quoted
from narracode.spec import CODING_SPEC, LabelSpec

RECORD_SCHEMA = "uid string, NarrativeLE string, NarrativeCME string"


def _csv(spark: SparkSession, path: str, schema: str, multi_line: bool) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .csv(path)
    )


def read_records(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """``uid, narrative_le, narrative_cme`` from quoted CSV; spellings of a missing value
    become null. Files are split over tasks, also if quoted fields hold line breaks, for which a
    first pass looks; ``multi_line`` reads each file in one task instead."""
    if not multi_line and has_broken_records(spark, path):
        raw = read_quoted(spark, path, RECORD_SCHEMA)
    else:
        raw = _csv(spark, path, RECORD_SCHEMA, multi_line)
    return raw.select(
        "uid",
        tokens_to_null(F.col("NarrativeLE")).alias("narrative_le"),
        tokens_to_null(F.col("NarrativeCME")).alias("narrative_cme"),
    )


def label_schema(cols: list[str], kind: str = "int") -> str:
    return ", ".join(["uid string", *[f"`{c}` {kind}" for c in cols]])


def read_labels(spark: SparkSession, path: str, spec: LabelSpec = CODING_SPEC) -> DataFrame:
    """``uid`` and one integer column per label."""
    return _csv(spark, path, label_schema(spec.columns), False)


def read_external_scores(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    """Another model's outputs as doubles, keyed by uid, to be used as features."""
    return _csv(spark, path, label_schema(cols, "double"), False)


def read_template(spark: SparkSession, path: str, spec: LabelSpec = CODING_SPEC) -> DataFrame:
    """Labels plus ``template_pos``, the row's position over all files in path order.

    Rows are numbered per file split and shifted by the size of the splits before, so no task
    sees more than a split.
    """
    rows = _csv(spark, path, label_schema(spec.columns), False).select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    sizes = rows.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"))
    in_order = Window.orderBy("_file", "_start")
    offsets = sizes.select("_file", "_start", (F.sum("_n").over(in_order) - F.col("_n")).alias("_offset"))
    in_split = Window.partitionBy("_file", "_start").orderBy("_id")
    return (
        rows.join(offsets, ["_file", "_start"])
        .withColumn("template_pos", F.row_number().over(in_split) - 1 + F.col("_offset"))
        .drop("_file", "_start", "_id", "_offset")
    )


def read_member_scores(spark: SparkSession, path: str, model_type: str = "int") -> DataFrame:
    """``model, uid, vec`` of all ensemble members from one table with a ``model=<name>``
    folder per member; named members need ``model_type="string"``."""
    return spark.read.schema(f"uid string, vec array<double>, model {model_type}").parquet(path)


def read_member_thresholds(
    spark: SparkSession, path: str, spec: LabelSpec = CODING_SPEC, which: str = "last", model_type: str = "int"
) -> DataFrame:
    """``model, label, thresh`` of the binary labels from each member's JSON configuration.
    ``which`` takes the threshold of the last evaluation or the best one."""
    states = read_member_states(spark, path, spec, model_type).filter(F.col("kind") == "binary")
    return states.select("model", "label", F.col({"last": "thresh", "best": "best_thresh"}[which]).alias("thresh"))


def read_member_states(
    spark: SparkSession, path: str, spec: LabelSpec = CODING_SPEC, model_type: str = "int"
) -> DataFrame:
    """``model, label, kind, thresh, f1, best_thresh, best_f1, step`` from each member's JSON
    configuration.

    Entry ``eval_zthresh_<i>`` belongs to column *i* of the specification: ``[thresh, score,
    best thresh, best score, step]`` of a binary label, ``[score, best score, step]`` of a
    categorical one, which has no thresholds.
    """
    config = (
        spark.read.schema(f"task_specific_params map<string, array<double>>, model {model_type}")
        .option("multiLine", True)
        .json(path)
    )
    state = config.select("model", F.explode("task_specific_params").alias("key", "_s"))
    index = F.regexp_extract("key", r"^eval_zthresh_(\d+)$", 1)
    names = F.array(*[F.lit(name) for name in spec.columns])
    known = state.withColumn("_idx", F.when(index != "", index.cast("int"))).filter(F.col("_idx") < len(spec.columns))
    binary = F.col("_idx") < len(spec.binary)

    def element(of_binary: int, of_categorical: int | None) -> Column:
        other = F.lit(None).cast("double") if of_categorical is None else F.get("_s", F.lit(of_categorical))
        return F.when(binary, F.get("_s", F.lit(of_binary))).otherwise(other)

    return known.select(
        "model",
        F.get(names, F.col("_idx")).alias("label"),
        F.when(binary, "binary").otherwise("categorical").alias("kind"),
        element(0, None).alias("thresh"),
        element(1, 0).alias("f1"),
        element(2, None).alias("best_thresh"),
        element(3, 1).alias("best_f1"),
        element(4, 2).cast("bigint").alias("step"),
    )
