"""Projections, reshapes, keyed joins and checks on record, label and prediction tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narracode.functions.numeric import cut, half_even
from narracode.functions.text import repair_sentence_gaps
from narracode.spec import LabelSpec, code_table

# ------------------------------------------------------------------ projections


def corpus(records: DataFrame, repair: bool = True) -> DataFrame:
    """Both narratives as one text; null when either side is null."""
    text = F.concat(F.col("narrative_le"), F.lit(" "), F.col("narrative_cme"))
    return records.withColumn("text", repair_sentence_gaps(text) if repair else text)


def rebase_codes(df: DataFrame, cols: Iterable[str], by: int) -> DataFrame:
    """Shift categorical codes: -1 for zero-based work, +1 for output."""
    return df.withColumns({c: F.col(c) + F.lit(by) for c in cols})


def pack_labels(df: DataFrame, cols: list[str], name: str = "labels") -> DataFrame:
    return df.withColumn(name, F.array(*cols))


def prune(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.drop(*cols)


def project_template(df: DataFrame, template_cols: list[str]) -> DataFrame:
    return df.select(*template_cols)


def to_int(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Round half to even, then cast."""
    return df.withColumns({c: half_even(F.col(c)).cast("int") for c in cols})


def fold_split(df: DataFrame, fold: int) -> DataFrame:
    """Mark each row ``train`` or ``dev`` for one fold; filter on ``split`` to get a side."""
    return df.withColumn("split", F.when(F.col("fold") == fold, "dev").otherwise("train"))


def binarize(score: Column, thresh: Column) -> Column:
    """Strictly above the threshold."""
    return (score > thresh).cast("int")


def split_scores(df: DataFrame, spec: LabelSpec, vec: str = "vec") -> DataFrame:
    """Cut a record's score vector into ``bin`` and one array per categorical label."""
    cols = {"bin": cut(F.col(vec), 0, len(spec.binary))}
    for label, kind, start, n in spec.slot_ranges():
        if kind == "categorical":
            cols[label] = cut(F.col(vec), start, n)
    return df.withColumns(cols)


def to_long(df: DataFrame, cols: list[str], value: str = "y", ids: Iterable[str] = ("uid",)) -> DataFrame:
    """One row per record and label, so label loops become a grouping column."""
    return df.unpivot(list(ids), cols, "label", value)


# ------------------------------------------------------------------------ joins


def with_labels(records: DataFrame, labels: DataFrame) -> DataFrame:
    """Column concat by key with outer alignment."""
    return records.join(labels, "uid", "full_outer")


def semi(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys, "uid", "left_semi")


def exclude_seen(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.join(test, "uid", "left_anti")


def align(df: DataFrame, order: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of ``order`` with the columns of ``df``; keys without a row stay with nulls and
    are counted by :func:`validate`. With ``strict`` such a key fails the job and is named."""
    if not strict:
        return order.join(df, "uid", "left")
    joined = order.join(df.withColumn("_there", F.lit(True)), "uid", "left")
    missing = F.raise_error(F.concat(F.lit("no row for uid "), F.coalesce(F.col("uid").cast("string"), F.lit("null"))))
    checked = F.when(F.col("_there").isNotNull(), F.col("uid")).otherwise(missing)
    return joined.withColumn("uid", checked).drop("_there")


def assign(template: DataFrame, preds: DataFrame, cols: list[str]) -> DataFrame:
    """Write predicted columns into the template by key; rows without one keep their value."""
    new = preds.select("uid", *[F.col(c).alias(f"_new_{c}") for c in cols])
    joined = template.join(new, "uid", "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in cols}).drop(
        *[f"_new_{c}" for c in cols]
    )


def encode_lookup(
    df: DataFrame, text: str, vocab: dict[str, int] | DataFrame, out: str, default: int | None
) -> DataFrame:
    """Case-free text to code. A dict is broadcast (it fits the driver already); a table of
    unknown size is joined without a hint, so its size decides the strategy."""
    if isinstance(vocab, dict):
        table = code_table(df.sparkSession, vocab)
    else:
        table = vocab
    table = table.select(F.col("raw").alias("_raw"), F.col("code").alias(out))
    joined = df.join(table, F.lower(F.col(text)) == F.col("_raw"), "left").drop("_raw")
    return joined if default is None else joined.withColumn(out, F.coalesce(F.col(out), F.lit(default)))


def decode_lookup(df: DataFrame, code: str, names: dict[int, str], out: str) -> DataFrame:
    """Code to category name."""
    table = df.sparkSession.createDataFrame(list(names.items()), f"_code int, {out} string")
    return df.join(table, F.col(code) == F.col("_code"), "left").drop("_code")


def attach_one(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Add the single value of a one-row, one-column table to each row (a scalar subquery,
    not a cross join; Spark fails the job if there is more than one row)."""
    return df.withColumn(name, one_row.scalar())


def scores_with_thresholds(scores: DataFrame, thresholds: DataFrame, per_model: bool = False) -> DataFrame:
    """Join decision thresholds on label, or on model and label."""
    on = ["model", "label"] if per_model else ["label"]
    return scores.join(thresholds, on)


# ------------------------------------------------------------------------ checks


def validate(pred: DataFrame, labels: DataFrame, spec: LabelSpec) -> DataFrame:
    """One row ``check, ok`` per rule on predictions against labels keyed by ``uid``."""
    spark = pred.sparkSession
    cols = spec.columns
    pred_types = dict(pred.dtypes)
    pred_cols = [c for c in pred.columns if c != "uid"]
    static = [
        ("n_columns", len(pred_cols) == len(cols)),
        ("same_columns", pred_cols == [c for c in labels.columns if c != "uid"]),
        ("integer_columns", all(pred_types[c] in ("int", "bigint", "smallint", "tinyint") for c in pred_cols)),
    ]
    present = [c for c in cols if c in pred_cols]
    left = pred.select("uid", F.lit(1).alias("_p"), *present)
    right = labels.select("uid", F.lit(1).alias("_l"))
    limits = {**{b: (0, 1) for b in spec.binary}, **{c: (1, n) for c, n in spec.categorical.items()}}
    in_range = F.lit(True)
    no_null = F.lit(True)
    for c in present:
        low, high = limits[c]
        in_range = in_range & F.coalesce(F.col(c).between(low, high), F.lit(True))
        no_null = no_null & F.col(c).isNotNull()
    both = left.join(right, "uid", "full_outer")
    has_p, has_l = F.col("_p").isNotNull(), F.col("_l").isNotNull()
    counts = both.agg(
        F.count_if(~(has_p & has_l)).alias("same_keys"),
        F.count_if(has_p & ~no_null).alias("no_nulls"),
        F.count_if(has_p & ~in_range).alias("codes_in_range"),
    )
    dynamic = counts.unpivot([], ["same_keys", "no_nulls", "codes_in_range"], "check", "bad").select(
        "check", (F.col("bad") == 0).alias("ok")
    )
    return spark.createDataFrame(static, "check string, ok boolean").unionByName(dynamic)


def validate_labels(labels: DataFrame, spec: LabelSpec) -> DataFrame:
    """One row ``check, ok`` per rule on a label table: each key once, as many classes as the
    specification says."""
    counts = labels.agg(
        (F.count("uid") == F.count_distinct("uid")).alias("unique_keys"),
        *[(F.count_distinct(c) == n).alias(f"classes_{c}") for c, n in spec.categorical.items()],
    )
    return counts.unpivot([], counts.columns, "check", "ok")
