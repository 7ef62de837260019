"""Sinks: predictions, corpus lines, out-of-fold tables, member tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narracode.functions.text import numbered_key
from narracode.operators.corpus import stack_texts
from narracode.operators.labels import assign, project_template
from narracode.spec import LabelSpec


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV with a header; blanks at the ends of a text are kept."""
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(header=True, escape='"', **keep).csv(path)


def write_submission(preds: DataFrame, template: DataFrame, path: str, cols: list[str]) -> None:
    """Predictions in template row and column order; the files in name order hold the rows in
    order."""
    filled = assign(template, preds, cols)
    template_cols = [c for c in template.columns if c != "template_pos"]
    write_csv(project_template(filled.orderBy("template_pos"), template_cols), path)


def write_one_csv(df: DataFrame, path: str, *order: str) -> None:
    """One CSV file with one header, rows by ``order``.

    Rows are sorted in ranges by many tasks; one task then writes the ranges one after the other,
    as one file is one stream, and its file gets the name ``path``. No task holds more than a
    range, and the driver only renames."""
    spark = df.sparkSession
    folder = f"{path}.parts"
    cols = [c for c in df.columns if c not in order or c != "template_pos"]
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    ranged = df.orderBy(*order).select(*cols)
    ranged.coalesce(1).write.options(header=True, escape='"', **keep).csv(folder)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = [s.getPath() for s in fs.globStatus(fs_path(f"{folder}/part-*"))]
    if len(part) != 1 or fs.exists(fs_path(path)) or not fs.rename(part[0], fs_path(path)):
        raise FileExistsError(f"{path} cannot be written")
    fs.delete(fs_path(folder), True)


def write_submission_file(preds: DataFrame, template: DataFrame, path: str, cols: list[str]) -> None:
    """Predictions in template row and column order as one file."""
    write_one_csv(assign(template, preds, cols).select(*template.columns), path, "template_pos")


def write_lines(records: DataFrame, path: str) -> None:
    """Text lines of both narratives, one folder per ``split``."""
    stack_texts(records).select("line", "split").write.partitionBy("split").text(path)


def save_oof(oof: DataFrame, path: str) -> None:
    """``label, uid, fold, y, score, y_hat`` partitioned by label."""
    oof.write.partitionBy("label").parquet(path)


def save_member_scores(members: DataFrame, path: str) -> None:
    members.write.partitionBy("model").parquet(path)


def save_member_thresholds(states: DataFrame, path: str, spec: LabelSpec) -> None:
    """One JSON object per member from ``model, label, thresh, f1, best_thresh, best_f1,
    step``; a member has one row per label. Entries are numbered by the columns of ``spec``; a
    categorical label has no thresholds and three numbers."""
    names = F.array(*[F.lit(name) for name in spec.columns])
    place = (F.array_position(names, F.col("label")) - 1).cast("int")
    key = numbered_key("eval_zthresh_", place)
    step = F.col("step").cast("double")
    state = F.when(place < len(spec.binary), F.array("thresh", "f1", "best_thresh", "best_f1", step)).otherwise(
        F.array("f1", "best_f1", step)
    )
    packed = states.groupBy("model").agg(
        F.map_from_entries(F.collect_list(F.struct(key, state))).alias("task_specific_params")
    )
    packed.write.partitionBy("model").json(path)
