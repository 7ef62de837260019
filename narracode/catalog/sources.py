"""Sources and sinks: data derived from the tables is written to the shared folder and read
back."""

from __future__ import annotations

from pyspark.sql import functions as F

from narracode.catalog import tables as t
from narracode.catalog.registry import query
from narracode.functions.numeric import array_sum
from narracode.operators.ensemble import activate
from narracode.operators.features import fit_vocab, word_terms
from narracode.operators.folds import kfold, stratified_kfold
from narracode.operators.labels import fold_split
from narracode.operators.thresholds import threshold_search
from narracode.session import scratch_path, write_table
from narracode.sources import readers, writers
from narracode.spec import CODING_SPEC, NULL_TOKENS

_null_list = ", ".join(t.quote(x) for x in NULL_TOKENS)


def _null(col: str) -> str:
    return f"CASE WHEN {col} NOT IN ({_null_list}) THEN {col} END AS {col}"


@query(
    "read_records",
    t.with_tables(f"SELECT uid, {_null('narrative_le')}, {_null('narrative_cme')} FROM records", "records"),
)
def read_records(spark, sf):
    path = scratch_path(spark, "records_csv")
    out = t.records(spark, sf).toDF("uid", "NarrativeLE", "NarrativeCME")
    writers.write_csv(out, path)
    return readers.read_records(spark, path, multi_line=True)


@query(
    "read_split_records",
    t.with_tables(f"SELECT uid, {_null('narrative_le')}, {_null('narrative_cme')} FROM records", "records"),
)
def read_split_records(spark, sf):
    """The same files read in splits; their fields hold line breaks and quotes."""
    path = scratch_path(spark, "records_csv")
    writers.write_csv(t.records(spark, sf).toDF("uid", "NarrativeLE", "NarrativeCME"), path)
    return readers.read_records(spark, path)


@query(
    "write_submission_file",
    t.with_tables(
        "SELECT c.uid, "
        + ", ".join(f"COALESCE(w.quality, c.{c}) AS {c}" if c == "DepressedMood" else f"c.{c}" for c in CODING_SPEC.columns)
        + ", CAST(row_number() OVER (ORDER BY c.uid) - 1 AS BIGINT) AS template_pos "
        "FROM coded c LEFT JOIN labels_wide w ON c.uid = w.uid",
        "coded",
        "labels_wide",
    ),
)
def write_submission_file(spark, sf):
    """Template of all documents as one file with one header, read back in order."""
    template_path, path = scratch_path(spark, "template_csv"), scratch_path(spark, "submission.csv")
    writers.write_csv(t.coded(spark, sf).orderBy("uid"), template_path)
    preds = t.labels_wide(spark, sf).select("uid", F.col("quality").alias("DepressedMood"))
    writers.write_submission_file(preds, readers.read_template(spark, template_path), path, ["DepressedMood"])
    return readers.read_template(spark, path)


_coded_cols = ", ".join(CODING_SPEC.columns)


@query("read_labels", t.with_tables(f"SELECT uid, {_coded_cols} FROM coded", "coded"))
def read_labels(spark, sf):
    path = scratch_path(spark, "labels_csv")
    writers.write_csv(t.coded(spark, sf), path)
    return readers.read_labels(spark, path)


@query(
    "read_template",
    t.with_tables(
        f"SELECT uid, {_coded_cols}, CAST(row_number() OVER (ORDER BY uid DESC) - 1 AS BIGINT) AS template_pos FROM coded",
        "coded",
    ),
)
def read_template(spark, sf):
    path = scratch_path(spark, "template_csv")
    writers.write_csv(t.coded(spark, sf).orderBy(F.desc("uid")), path)
    return readers.read_template(spark, path)


def external_wide(spark, sf):
    """Member 0's scores of the labelled documents, one column per label."""
    member = t.member_scores(spark, sf).filter(F.col("model") == 0)
    return member.groupBy("uid").agg(
        *[F.max(F.when(F.col("label") == c, F.col("score"))).alias(c) for c in t.DOC_SPEC.binary]
    )


EXTERNAL_SQL = (
    "SELECT uid, max(CASE WHEN label = 'quality' THEN score END) AS quality, "
    "max(CASE WHEN label = 'toxic' THEN score END) AS toxic FROM member_scores WHERE model = 0 GROUP BY uid"
)


@query(
    "read_external_scores",
    t.with_tables(
        "SELECT uid, round(quality, 6) AS quality, round(toxic, 6) AS toxic FROM ext",
        "member_scores",
        extra={"ext": EXTERNAL_SQL},
    ),
)
def read_external_scores(spark, sf):
    path = scratch_path(spark, "external_csv")
    writers.write_csv(external_wide(spark, sf), path)
    back = readers.read_external_scores(spark, path, t.DOC_SPEC.binary)
    return back.select("uid", *[F.round(c, 6).alias(c) for c in t.DOC_SPEC.binary])


@query(
    "read_member_scores",
    t.with_tables(
        "SELECT model, uid, round(sum(x), 4) + 0 AS total, round(max(CASE WHEN slot = 39 THEN x END), 6) + 0 AS last, "
        "count(*) AS n FROM member_slots GROUP BY model, uid",
        "member_slots",
    ),
)
def read_member_scores(spark, sf):
    path = scratch_path(spark, "member_scores")
    writers.save_member_scores(t.member_vectors(spark, sf).withColumnRenamed("logits", "vec"), path)
    vec = F.col("vec")
    return readers.read_member_scores(spark, path).select(
        "model",
        "uid",
        (F.round(array_sum(vec), 4) + 0).alias("total"),
        (F.round(F.get(vec, F.lit(38)), 6) + 0).alias("last"),
        F.size(vec).cast("bigint").alias("n"),
    )


GRID_SQL = {
    "grid": f"SELECT CAST(range AS INT) AS j, range * {t.dbl(0.01)} AS thresh FROM range(101)",
    "curve": (
        "SELECT model, label, j, thresh, "
        "CASE WHEN sum(CAST(score > thresh AS INT)) + sum(y) = 0 THEN CAST(0 AS DOUBLE) ELSE "
        "2 * CAST(sum(CASE WHEN score > thresh THEN y ELSE 0 END) AS DOUBLE) / "
        "CAST(sum(CAST(score > thresh AS INT)) + sum(y) AS DOUBLE) END AS f1 "
        "FROM member_scores, grid GROUP BY model, label, j, thresh"
    ),
    "found": (
        "SELECT model, label, thresh, f1 FROM (SELECT *, row_number() OVER "
        "(PARTITION BY model, label ORDER BY f1 DESC, j) AS rn FROM curve) WHERE rn = 1"
    ),
}


@query(
    "read_member_thresholds",
    t.with_tables("SELECT model, label, round(thresh, 6) AS thresh FROM found", "member_scores", extra=GRID_SQL),
)
def read_member_thresholds(spark, sf):
    path = scratch_path(spark, "member_config")
    found = threshold_search(t.member_scores(spark, sf), ["model", "label"])
    states = found.select("*", F.col("thresh").alias("best_thresh"), F.col("f1").alias("best_f1"), F.col("model").alias("step"))
    writers.save_member_thresholds(states, path, t.DOC_SPEC)
    back = readers.read_member_thresholds(spark, path, t.DOC_SPEC)
    return back.select("model", "label", F.round("thresh", 6).alias("thresh"))


@query(
    "write_submission",
    t.with_tables(
        "SELECT c.uid, "
        + ", ".join(f"COALESCE(w.quality, c.{c}) AS {c}" if c == "DepressedMood" else f"c.{c}" for c in CODING_SPEC.columns)
        + ", CAST(row_number() OVER (ORDER BY c.uid) - 1 AS BIGINT) AS template_pos "
        "FROM coded c LEFT JOIN labels_wide w ON c.uid = w.uid",
        "coded",
        "labels_wide",
    ),
)
def write_submission(spark, sf):
    """Template of all documents, one column predicted for the labelled ones."""
    template_path, path = scratch_path(spark, "template_csv"), scratch_path(spark, "submission_csv")
    writers.write_csv(t.coded(spark, sf).orderBy("uid"), template_path)
    preds = t.labels_wide(spark, sf).select("uid", F.col("quality").alias("DepressedMood"))
    writers.write_submission(preds, readers.read_template(spark, template_path), path, ["DepressedMood"])
    return readers.read_template(spark, path)


_lines = (
    "SELECT uid, unnest(string_split(narrative_le, chr(10))) AS line FROM records "
    "UNION ALL SELECT uid, unnest(string_split(narrative_cme, chr(10))) FROM records"
)
FOLDS_SQL = "SELECT uid, CAST(ntile(5) OVER (ORDER BY md5('7|' || uid)) - 1 AS INT) AS fold FROM records"


@query(
    "write_lines",
    t.with_tables(
        "SELECT CASE WHEN fold = 0 THEN 'dev' ELSE 'train' END AS split, line, count(*) AS n "
        "FROM lines JOIN folds ON lines.uid = folds.uid GROUP BY 1, 2",
        "records",
        extra={"lines": _lines, "folds": FOLDS_SQL},
    ),
)
def write_lines(spark, sf):
    path = scratch_path(spark, "lines")
    writers.write_lines(fold_split(kfold(t.records(spark, sf), 5, 7), 0), path)
    back = spark.read.schema("value string, split string").text(path)
    return back.groupBy("split", F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


_word_tok = r"[\p{L}\p{N}_]{2,}"
VOCAB_SQL = {
    "terms": f"SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest(regexp_extract_all(lower(text), '{_word_tok}')) AS term FROM docs) GROUP BY uid, term",
    "totals": "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM terms GROUP BY term",
    "n_docs": "SELECT count(*) AS n FROM docs",
    "top": f"SELECT term, df, n FROM totals, n_docs WHERE df >= 5 AND df <= {t.dbl(0.6)} * n ORDER BY tf DESC, term LIMIT 500",
    "vocab": (
        "SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INT) AS term_id, df, "
        "ln(CAST(1 + n AS DOUBLE) / (1 + df)) + 1 AS idf FROM top"
    ),
}


def word_vocab(spark, sf):
    docs = t.docs(spark, sf)
    n = docs.select(F.count(F.lit(1)).alias("n"))
    vocab = fit_vocab(word_terms(docs, 1, 1), n, min_df=5, max_df=0.6, max_features=500)
    return F.broadcast(write_table(vocab, "word_vocab"))  # 500 terms at most


@query(
    "save_features",
    t.with_tables("SELECT term, term_id, df, round(idf, 6) AS idf FROM vocab", "docs", extra=VOCAB_SQL),
)
def save_features(spark, sf):
    path = scratch_path(spark, "vocab")
    word_vocab(spark, sf).write.parquet(path)
    back = spark.read.parquet(path)
    return back.select("term", "term_id", "df", F.round("idf", 6).alias("idf"))


STRATIFIED_SQL = (
    "SELECT uid, label, kind, y, CAST((row_number() OVER (PARTITION BY label ORDER BY y, md5('11|' || uid)) - 1) % 4 AS INT) AS fold "
    "FROM labels_long"
)


@query(
    "save_oof",
    t.with_tables(
        "SELECT s.label, s.uid, f.fold, s.y, round(s.score, 6) AS score, CAST(s.score > 0.5 AS INT) AS y_hat "
        "FROM member_scores s JOIN folds f ON s.uid = f.uid AND s.label = f.label WHERE s.model = 0",
        "member_scores",
        extra={"folds": STRATIFIED_SQL},
    ),
)
def save_oof(spark, sf):
    path = scratch_path(spark, "oof")
    member = t.member_scores(spark, sf).filter(F.col("model") == 0)
    folds = stratified_kfold(t.labels_long(spark, sf), 4, 11).select("uid", "label", "fold")
    oof = member.join(folds, ["uid", "label"]).select(
        "label", "uid", "fold", "y", "score", (F.col("score") > 0.5).cast("int").alias("y_hat")
    )
    writers.save_oof(oof, path)
    back = spark.read.parquet(path)
    return back.select("label", "uid", "fold", "y", F.round("score", 6).alias("score"), "y_hat")


_part = "CASE WHEN slot <= 21 THEN 0 WHEN slot <= 27 THEN 1 ELSE 2 END"


@query(
    "activate_scores",
    t.with_tables(
        "SELECT model, uid, round(sum(CASE WHEN slot <= 21 THEN s * slot END), 5) AS bin, round(sum(CASE WHEN slot > 21 THEN s * slot END), 5) AS cat "
        "FROM (SELECT model, uid, slot, CASE WHEN slot <= 21 THEN 1 / (1 + exp(-x)) ELSE "
        f"exp(x) / sum(exp(x)) OVER (PARTITION BY model, uid, {_part}) END AS s FROM member_slots) GROUP BY model, uid",
        "member_slots",
    ),
)
def activate_scores(spark, sf):
    """Logit vectors of the members as score vectors (the first step of inference)."""
    scored = activate(t.member_vectors(spark, sf), CODING_SPEC)
    weighted = F.transform("vec", lambda s, i: s * (i + 1))
    return scored.select(
        "model",
        "uid",
        F.round(array_sum(F.slice(weighted, 1, 21)), 5).alias("bin"),
        F.round(array_sum(F.slice(weighted, 22, 18)), 5).alias("cat"),
    )
