"""Aggregations, thresholds, ensembles and running states."""

from __future__ import annotations

from pyspark.sql import functions as F

from narracode.catalog import tables as t
from narracode.catalog.registry import query
from narracode.catalog.sources import GRID_SQL
from narracode.functions.text import words
from narracode.operators import ensemble as E
from narracode.operators import metrics as M
from narracode.operators import thresholds as T
from narracode.operators.ensemble import activate
from narracode.operators.folds import stratified_kfold
from narracode.plans.evaluate import evaluate_logits, score_files
from narracode.session import scratch_path
from narracode.spec import CODING_SPEC
from narracode.streaming.best_events import append_events
from narracode.streaming.running_best import run_to_table


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) + 0 for c in cols})


# ------------------------------------------------------------------- counts, F1


@query(
    "class_counts_distinct",
    t.with_tables("SELECT label, count(DISTINCT y) AS n FROM labels_long WHERE kind = 'categorical' GROUP BY label", "labels_long"),
)
def class_counts_distinct(spark, sf):
    return M.class_counts_distinct(t.labels_long(spark, sf).filter(F.col("kind") == "categorical"))


_binary = "(SELECT * FROM member_preds WHERE kind = 'binary')"
_counts = (
    f"SELECT model, label, count(*) FILTER (y_hat = 1 AND y = 1) AS tp, count(*) FILTER (y_hat = 1 AND y = 0) AS fp, "
    f"count(*) FILTER (y_hat = 0 AND y = 1) AS fn, count(*) FILTER (y_hat = 0 AND y = 0) AS tn FROM {_binary} GROUP BY 1, 2"
)
_f1 = (
    "SELECT model, label, CASE WHEN 2 * tp + fp + fn = 0 THEN CAST(0 AS DOUBLE) "
    "ELSE CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1 FROM counts"
)
_micro = (
    "SELECT model, label, avg(CAST(y = y_hat AS DOUBLE)) AS f1 FROM member_preds WHERE kind = 'categorical' GROUP BY 1, 2"
)
F1_SQL = {"counts": _counts, "f1b": _f1, "f1c": _micro, "f1all": "SELECT * FROM f1b UNION ALL SELECT * FROM f1c"}


def binary_preds(spark, sf):
    return t.member_preds(spark, sf).filter(F.col("kind") == "binary")


@query("confusion", t.with_tables("SELECT * FROM counts", "member_preds", extra={"counts": _counts}))
def confusion(spark, sf):
    return M.confusion(binary_preds(spark, sf), ["model", "label"])


@query("f1_binary", t.with_tables("SELECT model, label, round(f1, 6) AS f1 FROM f1b", "member_preds", extra=F1_SQL))
def f1_binary(spark, sf):
    return rounded(M.f1_binary(binary_preds(spark, sf), ["model", "label"]), "f1")


@query(
    "f1_macro",
    t.with_tables("SELECT model, round(avg(f1), 6) AS f1 FROM f1b GROUP BY model", "member_preds", extra=F1_SQL),
)
def f1_macro(spark, sf):
    return rounded(M.f1_macro(binary_preds(spark, sf), ["model"]), "f1")


@query("f1_micro", t.with_tables("SELECT model, label, round(f1, 6) AS f1 FROM f1c", "member_preds", extra=F1_SQL))
def f1_micro(spark, sf):
    preds = t.member_preds(spark, sf).filter(F.col("kind") == "categorical")
    return rounded(M.f1_micro(preds, ["model", "label"]), "f1")


@query(
    "f1_variable_average",
    t.with_tables(
        "SELECT model, round((2 * b.f1 + c.f1) / 4, 6) AS f1 FROM (SELECT model, avg(f1) AS f1 FROM f1b GROUP BY 1) b "
        "JOIN (SELECT model, sum(f1) AS f1 FROM f1c GROUP BY 1) c USING (model)",
        "member_preds",
        extra=F1_SQL,
    ),
)
def f1_variable_average(spark, sf):
    return rounded(M.f1_variable_average(t.member_preds(spark, sf), ["model"]), "f1")


_per_label = " UNION ALL ".join(
    f"SELECT '{c}' AS label, CAST(2 * count(*) FILTER (p.{c} = 1 AND l.{c} = 1) AS DOUBLE) / "
    f"greatest(count(*) FILTER (p.{c} = 1) + count(*) FILTER (l.{c} = 1), 1) AS f1 FROM preds p JOIN truth l USING (uid)"
    for c in CODING_SPEC.binary
) + "".join(
    f" UNION ALL SELECT '{c}', avg(CAST(p.{c} = l.{c} AS DOUBLE)) FROM preds p JOIN truth l USING (uid)"
    for c in CODING_SPEC.categorical
)
_shift = ", ".join(f"CASE WHEN toxic = 1 THEN 1 - {c} ELSE {c} END AS {c}" for c in CODING_SPEC.binary)
_shift += ", " + ", ".join(f"CASE WHEN toxic = 1 THEN {c} % {n} + 1 ELSE {c} END AS {c}" for c, n in CODING_SPEC.categorical.items())


@query(
    "score_submission",
    t.with_tables(
        "SELECT round(avg(f1), 6) AS f1 FROM per_label",
        "coded",
        "labels_wide",
        extra={
            "truth": "SELECT * FROM coded",
            "preds": f"SELECT uid, {_shift} FROM coded JOIN labels_wide USING (uid)",
            "per_label": _per_label,
        },
    ),
)
def score_submission(spark, sf):
    """The metric of a 23-label prediction table against a larger label table."""
    labels = t.coded(spark, sf)
    flip = F.col("toxic") == 1
    preds = labels.join(t.labels_wide(spark, sf).select("uid", "toxic"), "uid").select(
        "uid",
        *[F.when(flip, 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in CODING_SPEC.binary],
        *[F.when(flip, F.col(c) % n + 1).otherwise(F.col(c)).cast("int").alias(c) for c, n in CODING_SPEC.categorical.items()],
    )
    return rounded(score_files(preds, labels, CODING_SPEC)[0], "f1")


# -------------------------------------------------------------------- ensembles

MEAN_SQL = {
    "mean_class": "SELECT uid, label, class_idx, avg(score) AS score FROM member_class_scores GROUP BY 1, 2, 3",
    "mean_binary": "SELECT uid, label, avg(score) AS score, max(y) AS y FROM member_scores GROUP BY 1, 2",
    "mean_thresh": "SELECT label, avg(thresh) AS thresh FROM literal_thresholds GROUP BY 1",
    "picked": (
        "SELECT uid, label, class_idx FROM (SELECT *, row_number() OVER (PARTITION BY uid, label "
        "ORDER BY score DESC, class_idx) AS rn FROM mean_class) WHERE rn = 1"
    ),
}


@query(
    "ensemble_mean",
    t.with_tables(
        "SELECT uid, label, class_idx, round(score, 6) AS score FROM mean_class", "member_class_scores", extra={"mean_class": MEAN_SQL["mean_class"]}
    ),
)
def ensemble_mean(spark, sf):
    return rounded(E.ensemble_mean(t.member_class_scores(spark, sf)), "score")


@query(
    "threshold_mean",
    t.with_tables("SELECT label, round(avg(thresh), 6) AS thresh FROM literal_thresholds GROUP BY 1", "literal_thresholds"),
)
def threshold_mean(spark, sf):
    return rounded(E.threshold_mean(t.literal_thresholds(spark, sf)), "thresh")


@query(
    "ensemble_average",
    t.with_tables(
        "SELECT uid, label, CAST(score > thresh AS INT) AS y_hat FROM mean_binary JOIN mean_thresh USING (label) "
        "UNION ALL SELECT uid, label, class_idx + 1 FROM picked",
        "member_class_scores",
        "literal_thresholds",
        extra=MEAN_SQL,
    ),
)
def ensemble_average(spark, sf):
    return E.ensemble_average(t.member_scores(spark, sf), t.literal_thresholds(spark, sf), t.member_class_scores(spark, sf))


@query(
    "ensemble_vote",
    t.with_tables(
        "SELECT uid, label, CAST(round_even(avg(CAST(score > thresh AS DOUBLE)), 0) AS INT) AS y_hat "
        "FROM member_scores JOIN literal_thresholds USING (model, label) GROUP BY 1, 2",
        "member_scores",
        "literal_thresholds",
    ),
)
def ensemble_vote(spark, sf):
    return E.ensemble_vote(t.member_scores(spark, sf), t.literal_thresholds(spark, sf))


@query("argmax_class", t.with_tables("SELECT model, uid, label, class_idx FROM class_pick", "class_pick"))
def argmax_class(spark, sf):
    """Each member's class; the key is model and record."""
    keyed = t.member_class_scores(spark, sf).withColumn("uid", F.struct("model", "uid"))
    return E.argmax_class(keyed).select("uid.model", "uid.uid", "label", "class_idx")


_sig = f"{t.dbl(1)} / ({t.dbl(1)} + exp(-x))"


def _slot_label(start: int, n: int) -> str:
    return f"slot BETWEEN {start + 1} AND {start + n}"


_ranges = [r for r in CODING_SPEC.slot_ranges() if r[1] == "categorical"]
MEAN_SLOTS = {
    "acts": (
        f"SELECT model, uid, slot, CASE WHEN slot <= 21 THEN {_sig} ELSE "
        "exp(x) / sum(exp(x)) OVER (PARTITION BY model, uid, CASE WHEN slot <= 21 THEN 0 WHEN slot <= 27 THEN 1 ELSE 2 END) END AS s "
        "FROM member_slots"
    ),
    "means": "SELECT uid, slot, avg(s) AS s FROM acts GROUP BY 1, 2",
    "cats": (
        "SELECT uid, CASE WHEN slot <= 27 THEN 1 ELSE 2 END AS part, slot, row_number() OVER "
        "(PARTITION BY uid, CASE WHEN slot <= 27 THEN 1 ELSE 2 END ORDER BY s DESC, slot) AS rn FROM means WHERE slot > 21"
    ),
}
_vector_sql = (
    "SELECT m.uid, "
    + ", ".join(f"max(CASE WHEN m.slot = {i + 1} THEN CAST(m.s > {t.dbl(0.4)} AS INT) END) AS {c}" for i, c in enumerate(CODING_SPEC.binary))
    + ", "
    + ", ".join(
        f"CAST(max(CASE WHEN c.part = {k + 1} THEN c.slot - {start} END) AS INT) AS {label}" for k, (label, _, start, _) in enumerate(_ranges)
    )
    + " FROM means m LEFT JOIN (SELECT * FROM cats WHERE rn = 1) c ON m.uid = c.uid AND m.slot = c.slot GROUP BY m.uid"
)


@query("ensemble_vectors", t.with_tables(_vector_sql, "member_slots", extra=MEAN_SLOTS))
def ensemble_vectors(spark, sf):
    """Average ensemble on packed 39-slot vectors; the thresholds average to 0.4."""
    members = activate(t.member_vectors(spark, sf), CODING_SPEC).select("model", "uid", "vec")
    labels = CODING_SPEC.frame(spark).filter(F.col("kind") == "binary").select("label")
    limits = labels.select("label", F.explode(F.array(F.lit(0.25), F.lit(0.55))).alias("thresh"))
    return E.ensemble_vectors(members, limits, CODING_SPEC)


# ------------------------------------------------------------------- thresholds


@query(
    "threshold_search",
    t.with_tables("SELECT model, label, round(thresh, 6) AS thresh, round(f1, 6) AS f1 FROM found", "member_scores", extra=GRID_SQL),
)
def threshold_search(spark, sf):
    return rounded(T.threshold_search(t.member_scores(spark, sf), ["model", "label"]), "thresh", "f1")


@query(
    "ensemble_evaluation",
    t.with_tables(
        "SELECT label, round(CAST(2 * count(*) FILTER (score > thresh AND y = 1) AS DOUBLE) / "
        "greatest(count(*) FILTER (score > thresh) + sum(y), 1), 6) AS f1, count(*) AS n "
        "FROM mean_binary JOIN (SELECT label, avg(thresh) AS thresh FROM found GROUP BY 1) USING (label) GROUP BY label",
        "member_scores",
        extra={**GRID_SQL, "mean_binary": MEAN_SQL["mean_binary"]},
    ),
)
def ensemble_evaluation(spark, sf):
    """Members' scores to thresholds, average ensemble and F1 per label."""
    members = t.member_scores(spark, sf)
    thresholds = T.threshold_search(members, ["model", "label"])
    codes = E.ensemble_average(members, thresholds)
    truth = t.labels_long(spark, sf).filter(F.col("kind") == "binary").select("uid", "label", "y")
    counts = M.confusion(codes.join(truth, ["uid", "label"]))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f1 = M.f1_of_counts(tp, tp + fp, tp + fn)
    return rounded(counts.select("label", f1.alias("f1"), (tp + fp + fn + F.col("tn")).alias("n")), "f1")


_eval_sql = {
    "bin": f"SELECT slot, {_sig} AS s, y FROM slots WHERE slot <= 21",
    "grid": GRID_SQL["grid"],
    "curve": (
        "SELECT slot, j, thresh, CASE WHEN count(*) FILTER (s > thresh) + sum(y) = 0 THEN CAST(0 AS DOUBLE) ELSE "
        "CAST(2 * count(*) FILTER (s > thresh AND y = 1) AS DOUBLE) / CAST(count(*) FILTER (s > thresh) + sum(y) AS DOUBLE) END AS f1 "
        "FROM bin, grid GROUP BY 1, 2, 3"
    ),
    "best": "SELECT slot, thresh, f1 FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY f1 DESC, j) AS rn FROM curve) WHERE rn = 1",
    "top": (
        "SELECT uid, code, part, slot FROM (SELECT uid, code, slot, CASE WHEN slot <= 27 THEN 1 ELSE 2 END AS part, row_number() OVER "
        "(PARTITION BY uid, CASE WHEN slot <= 27 THEN 1 ELSE 2 END ORDER BY x DESC, slot) AS rn FROM slots WHERE slot > 21) WHERE rn = 1"
    ),
    "names": "SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, '{c}')" for i, c in enumerate(CODING_SPEC.binary)) + ") v(slot, label)",
}


@query(
    "evaluate_logits",
    t.with_tables(
        "SELECT label, round(thresh, 6) AS thresh, round(f1, 6) AS f1 FROM best JOIN names USING (slot) UNION ALL "
        "SELECT CASE part WHEN 1 THEN 'InjuryLocationType' ELSE 'WeaponType1' END, CAST(-1 AS DOUBLE), "
        "round(avg(CAST(slot = CASE part WHEN 1 THEN 22 + code % 6 ELSE 28 + code % 12 END AS DOUBLE)), 6) FROM top GROUP BY part",
        "slots",
        extra=_eval_sql,
    ),
)
def evaluate(spark, sf):
    scored = evaluate_logits(t.vectors(spark, sf), CODING_SPEC)
    return rounded(scored.withColumn("thresh", F.coalesce("thresh", F.lit(-1.0))), "thresh", "f1")


_state = "max(struct_pack(f1 := f1, step := step, t := thresh)) OVER (PARTITION BY run, label ORDER BY step)"


@query(
    "running_best",
    t.with_tables(
        f"SELECT run, label, step, round(thresh, 6) AS thresh, round(f1, 6) AS f1, round(b.t, 6) AS best_thresh, round(b.f1, 6) AS best_f1 "
        f"FROM (SELECT *, {_state} AS b FROM evals)",
        "evals",
    ),
)
def running_best(spark, sf):
    return rounded(T.running_best(t.evals(spark, sf), span=1024), "thresh", "f1", "best_thresh", "best_f1")


@query(
    "running_best_events",
    t.with_tables(
        f"SELECT run, label, step, round(thresh, 6) AS thresh, round(f1, 6) AS f1, round(b.t, 6) AS best_thresh, round(b.f1, 6) AS best_f1 "
        f"FROM (SELECT *, {_state} AS b FROM evals)",
        "evals",
    ),
)
def running_best_events(spark, sf):
    """A row for every evaluation from a stateful stream: three parts of the steps arrive one after
    the other, and the stream is started again from its checkpoint for each."""
    source, out, checkpoint = (scratch_path(spark, n) for n in ("evaluations", "best_events", "best_state"))
    evals = t.evals(spark, sf)
    steps = evals.agg(F.min("step").alias("a"), F.max("step").alias("b")).first()
    third = (steps["b"] - steps["a"]) // 3 + 1
    for k in range(3):
        low = steps["a"] + k * third
        evals.filter((F.col("step") >= low) & (F.col("step") < low + third)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(evals.schema).parquet(source)
        append_events(stream, out, checkpoint)
    return rounded(spark.read.parquet(out), "thresh", "f1", "best_thresh", "best_f1")


_report_folds = (
    "SELECT uid, label, CAST((row_number() OVER (PARTITION BY label ORDER BY y, md5('11|' || uid)) - 1) % 4 AS INT) AS fold FROM labels_long"
)


@query(
    "evaluation_report",
    t.with_tables(
        "SELECT CASE grouping_id(fold, label, kind) WHEN 0 THEN 'fold' WHEN 4 THEN 'label' WHEN 6 THEN 'kind' ELSE 'all' END AS level, "
        "fold, label, kind, count(*) AS n, "
        "count(*) FILTER (kind = 'binary' AND y = 1 AND y_hat = 1) AS tp, count(*) FILTER (kind = 'binary' AND y_hat = 1) AS predicted, "
        "count(*) FILTER (kind = 'binary' AND y = 1) AS actual, count(*) FILTER (y = y_hat) AS same, "
        "round(CASE WHEN count(*) FILTER (kind = 'binary') > 0 THEN CASE WHEN count(*) FILTER (kind = 'binary' AND (y = 1 OR y_hat = 1)) = 0 THEN 0 "
        "ELSE CAST(2 * count(*) FILTER (kind = 'binary' AND y = 1 AND y_hat = 1) AS DOUBLE) / "
        "(count(*) FILTER (kind = 'binary' AND y = 1) + count(*) FILTER (kind = 'binary' AND y_hat = 1)) END "
        "ELSE CAST(count(*) FILTER (y = y_hat) AS DOUBLE) / count(*) END, 6) AS f1 "
        "FROM (SELECT p.uid, p.label, p.kind, p.y, p.y_hat, f.fold FROM member_preds p JOIN folds f ON p.uid = f.uid AND p.label = f.label WHERE p.model = 0) "
        "GROUP BY GROUPING SETS ((fold, label, kind), (label, kind), (kind), ())",
        "member_preds",
        extra={"folds": _report_folds},
    ),
)
def evaluation_report(spark, sf):
    """Out-of-fold decisions of one member: scores by fold and label, by label, by kind, over all."""
    preds = t.member_preds(spark, sf).filter(F.col("model") == 0)
    folds = stratified_kfold(t.labels_long(spark, sf), 4, 11).select("uid", "label", "fold")
    return rounded(M.evaluation_report(preds.join(folds, ["uid", "label"])), "f1")


FINAL_SQL = (
    "SELECT label, max_by(thresh, step) AS thresh, max_by(f1, step) AS f1, "
    "max(struct_pack(f1 := f1, step := step, t := thresh)) AS b, max(step) AS step FROM evals GROUP BY label"
)


@query(
    "running_best_stream",
    t.with_tables(
        "SELECT label, round(thresh, 6) AS thresh, round(f1, 6) AS f1, round(b.t, 6) AS best_thresh, round(b.f1, 6) AS best_f1, step FROM fin",
        "evals",
        extra={"fin": FINAL_SQL},
    ),
)
def running_best_stream(spark, sf):
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    # a pattern, as the stream source wants a folder or a pattern and not a single file
    events = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")
    done = run_to_table(spark, events.select(*t.eval_columns()))
    return rounded(done, "thresh", "f1", "best_thresh", "best_f1")


@query(
    "best_checkpoint",
    t.with_tables(
        "SELECT run, step, round(f1, 6) AS best FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY f1 DESC, step) AS rn FROM evals) WHERE rn = 1",
        "evals",
    ),
)
def best_checkpoint(spark, sf):
    return rounded(M.best_checkpoint(t.evals(spark, sf), "f1"), "best")


@query(
    "keep_checkpoints",
    t.with_tables(
        "SELECT run, step, is_best, slot FROM (SELECT run, step, is_best, CAST(row_number() OVER (PARTITION BY run ORDER BY is_best DESC, step DESC) AS INT) AS slot "
        "FROM (SELECT run, step, CAST(row_number() OVER (PARTITION BY run ORDER BY f1 DESC, step) = 1 AS INT) AS is_best FROM evals)) WHERE slot <= 2",
        "evals",
    ),
)
def keep_checkpoints(spark, sf):
    return M.keep_checkpoints(t.evals(spark, sf), "f1", 2)


# ------------------------------------------------------------ profiles, reports

_tok = r"[\p{L}\p{N}_]+"


@query(
    "length_profile",
    "SELECT min(n) AS min, round(avg(n), 6) AS mean, round(median(n), 6) AS median, round(quantile_cont(n, 0.5), 6) AS p50, "
    f"round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS max FROM (SELECT len(regexp_extract_all(text, '{_tok}')) AS n FROM documents)",
)
def length_profile(spark, sf):
    profile = M.length_profile(t.docs(spark, sf), F.size(words(F.col("text"))))
    return rounded(profile, "mean", "median", "p50", "p95")


_rand_u = t.uniform("'5|' || label || '|' || uid")


@query(
    "random_baseline",
    t.with_tables(
        "SELECT round(avg(f1), 6) AS f1 FROM per_label",
        "labels_long",
        extra={
            "drawn": (
                f"SELECT label, kind, y, CAST(floor({_rand_u} * CASE kind WHEN 'binary' THEN 2 ELSE CASE label WHEN 'lang_code' THEN 4 ELSE 12 END END) "
                "+ CASE kind WHEN 'binary' THEN 0 ELSE 1 END AS INT) AS y_hat FROM labels_long"
            ),
            "per_label": (
                "SELECT label, CASE WHEN max(kind) = 'binary' THEN CAST(2 * count(*) FILTER (y = 1 AND y_hat = 1) AS DOUBLE) / "
                "greatest(count(*) FILTER (y = 1) + count(*) FILTER (y_hat = 1), 1) ELSE avg(CAST(y = y_hat AS DOUBLE)) END AS f1 "
                "FROM drawn GROUP BY label"
            ),
        },
    ),
)
def random_baseline(spark, sf):
    return rounded(M.random_baseline(t.labels_long(spark, sf), t.DOC_SPEC.frame(spark), 5), "f1")


def decisions_by_language(spark, sf):
    """The members' decisions on the binary labels, grouped by member, label and language."""
    languages = t.labels_wide(spark, sf).select("uid", "lang_code")
    return binary_preds(spark, sf).join(languages, "uid").withColumn("grp", F.concat_ws("-", "model", "label", "lang_code"))


IOU_SQL = {
    "rows_": "SELECT p.uid, p.y, p.y_hat, model || label || w.lang_code AS grp FROM member_preds p JOIN labels_wide w ON p.uid = w.uid WHERE kind = 'binary'",
    "cls": (
        "SELECT p.uid, p.y - 1 AS y, p.y_hat - 1 AS y_hat, model || '-' || w.lang_code AS grp FROM member_preds p "
        "JOIN labels_wide w ON p.uid = w.uid WHERE label = 'source_code'"
    ),
}


@query(
    "iou_binary",
    t.with_tables(
        "SELECT round(100 * avg(CASE WHEN u = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(i AS DOUBLE) / greatest(u, 1) END), 6) AS iou FROM "
        "(SELECT grp, count(*) FILTER (y = 1 AND y_hat = 1) AS i, count(*) FILTER (y = 1 OR y_hat = 1) AS u FROM rows_ GROUP BY grp)",
        "member_preds",
        extra={"rows_": IOU_SQL["rows_"]},
    ),
)
def iou_binary(spark, sf):
    return rounded(M.iou_binary(decisions_by_language(spark, sf), "grp"), "iou")


@query(
    "iou_classes",
    t.with_tables(
        "SELECT class, round(100 * avg(CASE WHEN u = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(i AS DOUBLE) / greatest(u, 1) END), 6) AS iou FROM "
        "(SELECT grp, class, count(*) FILTER (y = class AND y_hat = class) AS i, "
        "count(*) FILTER (y = class OR (y_hat = class AND y <> 3)) AS u FROM cls, (SELECT CAST(range AS INT) AS class FROM range(12)) "
        "WHERE class <> 3 GROUP BY grp, class) GROUP BY class",
        "member_preds",
        extra={"cls": IOU_SQL["cls"]},
    ),
)
def iou_classes(spark, sf):
    """Source classes by member and language, with class 3 as the void class."""
    preds = t.member_preds(spark, sf).filter(F.col("label") == "source_code")
    languages = t.labels_wide(spark, sf).select("uid", "lang_code")
    zero = preds.select("model", "uid", (F.col("y") - 1).alias("y"), (F.col("y_hat") - 1).alias("y_hat"))
    grouped = zero.join(languages, "uid").withColumn("grp", F.concat_ws("-", "model", "lang_code"))
    return rounded(M.iou_classes(grouped, 12, "grp", ignore=3), "iou")


@query(
    "nan_mean",
    "SELECT event_type, round(COALESCE(avg(value) FILTER (user_id % 7 <> 0), 0), 6) AS mean FROM events GROUP BY event_type",
)
def nan_mean(spark, sf):
    """Mean value by type where some users' values are not a number."""
    value = F.when(F.col("user_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    events = t.table(spark, sf, "events").select("event_type", value.alias("value"))
    return rounded(events.groupBy("event_type").agg(M.nan_mean(F.col("value"), True).alias("mean")), "mean")


_cols = t.DOC_SPEC.columns


@query(
    "label_correlation",
    t.with_tables(
        " UNION ALL ".join(
            f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM labels_wide" for i, a in enumerate(_cols) for b in _cols[i:]
        ),
        "labels_wide",
    ),
)
def label_correlation(spark, sf):
    return rounded(M.label_correlation(t.labels_wide(spark, sf), _cols), "r")


@query(
    "class_prior",
    t.with_tables(
        "SELECT label, y, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY label) AS DOUBLE), 6) AS p FROM labels_long GROUP BY label, y",
        "labels_long",
    ),
)
def class_prior(spark, sf):
    return rounded(M.class_prior(t.labels_long(spark, sf)), "p")
