"""Files: missing values, quoting, order, thresholds and the stream."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from narracode.plans.evaluate import evaluate_logits, score_files
from narracode.plans.inference import run
from narracode.session import scratch_path, shared_dir
from narracode.sources import readers, writers
from narracode.spec import CODING_SPEC, LabelSpec
from narracode.streaming.running_best import running_best_stream

SPEC = LabelSpec(["a", "b"], {"c": 3})
ROOT = Path(__file__).resolve().parent.parent


def test_records_with_missing_values_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "records.csv"
    path.write_text('uid,NarrativeLE,NarrativeCME\n1,"a ""quoted"", one\nnext",x\n2,NA,\n3,nan,"  kept  "\n')
    got = {r["uid"]: (r["narrative_le"], r["narrative_cme"]) for r in readers.read_records(spark, str(path), multi_line=True).collect()}
    assert got == {"1": ('a "quoted", one\nnext', "x"), "2": (None, None), "3": (None, "  kept  ")}


def test_template_positions_follow_the_files(spark, tmp_path):
    for i in range(3):
        rows = "\n".join(f"{i}-{k},0,1,2" for k in range(50))
        (tmp_path / f"part-{i}.csv").write_text(f"uid,a,b,c\n{rows}\n")
    got = readers.read_template(spark, str(tmp_path), SPEC).orderBy("template_pos").collect()
    assert [r["uid"] for r in got] == [f"{i}-{k}" for i in range(3) for k in range(50)]
    assert [r["template_pos"] for r in got] == list(range(150))


def test_template_of_a_file_in_many_splits(spark, tmp_path):
    (tmp_path / "t.csv").write_text("uid,a,b,c\n" + "\n".join(f"k{k:05d},0,1,2" for k in range(3000)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = readers.read_template(spark, str(tmp_path / "t.csv"), SPEC).orderBy("template_pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["uid"] for r in got] == [f"k{k:05d}" for k in range(3000)]


def test_thresholds_last_or_best(spark):
    rows = [(m, c, 0.1 * (m + 1), 0.5, 0.9, 0.8, 7) for m in range(2) for c in SPEC.binary]
    states = spark.createDataFrame(rows, "model int, label string, thresh double, f1 double, best_thresh double, best_f1 double, step int")
    path = scratch_path(spark, "configs")
    writers.save_member_thresholds(states, path, SPEC)
    last = {(r["model"], r["label"]): r["thresh"] for r in readers.read_member_thresholds(spark, path, SPEC).collect()}
    assert last == pytest.approx({(m, c): 0.1 * (m + 1) for m in range(2) for c in SPEC.binary})
    best = readers.read_member_thresholds(spark, path, SPEC, "best").select("thresh").distinct().collect()
    assert [r[0] for r in best] == [0.9]


def test_member_state_of_all_labels(spark):
    """Five numbers per binary label and three per categorical one, back as they were."""
    rows = []
    for m in range(5):
        for i, c in enumerate(SPEC.columns):
            t = 0.1 * m + 0.01 * i if c in SPEC.binary else None
            rows.append((m, c, t, 0.5 + 0.01 * i, t, 0.6 + 0.01 * i, 7 + m))
    columns = "model int, label string, thresh double, f1 double, best_thresh double, best_f1 double, step bigint"
    path = scratch_path(spark, "configs")
    writers.save_member_thresholds(spark.createDataFrame(rows, columns), path, SPEC)
    back = readers.read_member_states(spark, path, SPEC)
    got = {tuple(r) for r in back.select("model", "label", "thresh", "f1", "best_thresh", "best_f1", "step").collect()}
    assert got == set(rows)
    assert back.filter("kind = 'categorical'").count() == 5 * (len(SPEC.columns) - len(SPEC.binary))


def test_named_members(spark):
    rows = [(m, "a", 0.2, 0.5, 0.9, 0.8, 7) for m in ("large", "small")]
    states = spark.createDataFrame(rows, "model string, label string, thresh double, f1 double, best_thresh double, best_f1 double, step int")
    path, scores = scratch_path(spark, "configs"), scratch_path(spark, "members")
    writers.save_member_thresholds(states, path, SPEC)
    got = readers.read_member_thresholds(spark, path, SPEC, model_type="string").collect()
    assert {(r["model"], r["label"], r["thresh"]) for r in got} == {("large", "a", 0.2), ("small", "a", 0.2)}
    members = spark.createDataFrame([("large", "u", [0.5])], "model string, uid string, vec array<double>")
    writers.save_member_scores(members, scores)
    assert readers.read_member_scores(spark, scores, "string").first()["model"] == "large"


def test_inference_writes_the_template_order(spark):
    uids = [f"u{i}" for i in (3, 1, 2, 0)]
    template = spark.createDataFrame([(u, 0, 0, 1) for u in uids], "uid string, a int, b int, c int").coalesce(1)
    vec = {"u0": [0.9, 0.1, 0.2, 0.5, 0.3], "u1": [0.1, 0.9, 0.5, 0.2, 0.3], "u2": [0.5, 0.6, 0.1, 0.1, 0.8], "u3": [0.2, 0.2, 0.4, 0.4, 0.2]}
    members = spark.createDataFrame([(m, u, v) for m in range(2) for u, v in vec.items()], "model int, uid string, vec array<double>")
    states = spark.createDataFrame(
        [(m, c, 0.5, 0.0, 0.5, 0.0, 1) for m in range(2) for c in SPEC.binary],
        "model int, label string, thresh double, f1 double, best_thresh double, best_f1 double, step int",
    )
    paths = {k: scratch_path(spark, k) for k in ("members", "configs", "template", "out")}
    writers.save_member_scores(members, paths["members"])
    writers.save_member_thresholds(states, paths["configs"], SPEC)
    writers.write_csv(template, paths["template"])
    run(spark, paths["members"], paths["configs"], paths["template"], paths["out"], SPEC)
    got = readers.read_template(spark, paths["out"], SPEC).orderBy("template_pos")
    want = {"u0": (1, 0, 2), "u1": (0, 1, 1), "u2": (0, 1, 3), "u3": (0, 0, 1)}
    assert [(r["uid"], (r["a"], r["b"], r["c"])) for r in got.collect()] == [(u, want[u]) for u in uids]


def test_score_files_ignores_other_labels(spark):
    labels = spark.createDataFrame([("1", 1, 0, 2), ("2", 0, 1, 3), ("3", 1, 1, 1)], "uid string, a int, b int, c int")
    preds = labels.filter("uid <> '3'")
    score, checks = score_files(preds, labels, SPEC)
    assert score.first()["f1"] == 1.0 and all(r["ok"] for r in checks.collect())


def test_evaluation_of_perfect_logits(spark):
    rows = [([9.0, -9.0, 5.0, 0.0, 0.0], [1, 0, 0]), ([-9.0, 9.0, 0.0, 0.0, 5.0], [0, 1, 2])]
    df = spark.createDataFrame(rows, "logits array<double>, labels array<int>")
    got = {r["label"]: r["f1"] for r in evaluate_logits(df, SPEC).collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": 1.0}


def test_stream_continues_where_it_stopped(spark):
    source, out, state = (scratch_path(spark, n) for n in ("evals", "best", "state"))
    schema = "label string, step bigint, thresh double, f1 double"

    def feed(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        running_best_stream(spark.readStream.schema(schema).parquet(source), out, state)
        return {r["label"]: (r["best_thresh"], r["best_f1"], r["step"], r["f1"]) for r in spark.read.parquet(out).collect()}

    assert feed([("a", 1, 0.3, 0.5), ("a", 2, 0.4, 0.7), ("b", 1, 0.1, 0.2)]) == {"a": (0.4, 0.7, 2, 0.7), "b": (0.1, 0.2, 1, 0.2)}
    assert feed([("a", 3, 0.6, 0.7), ("a", 4, 0.9, 0.1)])["a"] == (0.6, 0.7, 4, 0.1)


def test_shared_folder_is_the_named_one(tmp_path):
    code = (
        "from narracode.session import build_session, scratch_path\n"
        f"spark = build_session('named', '1', **{{'spark.checkpoint.dir': {str(tmp_path)!r}}})\n"
        "print('AT', scratch_path(spark, 'x'))\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert f"AT {tmp_path}/narracode/" in done.stdout and "/x-" in done.stdout


def test_scratch_paths_are_new(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert scratch_path(spark, "x").startswith(shared_dir(spark))


def test_lines_are_written_per_split(spark):
    rows = [("1", "a\nb", "c", "train"), ("2", "d", "", "dev")]
    path = scratch_path(spark, "lines")
    writers.write_lines(spark.createDataFrame(rows, "uid string, narrative_le string, narrative_cme string, split string"), path)
    got = spark.read.text(f"{path}/split=train").select("value").collect()
    assert sorted(r[0] for r in got) == ["a", "b", "c"]
    assert spark.read.text(f"{path}/split=dev").filter(F.col("value") != "").count() == 1


def test_labels_and_external_scores(spark):
    path = scratch_path(spark, "labels")
    writers.write_csv(spark.createDataFrame([("1", *[1] * 21, 6, 12)], ", ".join(["uid string", *[f"{c} int" for c in CODING_SPEC.columns]])), path)
    row = readers.read_labels(spark, path).first()
    assert row["Argument"] == 1 and row["WeaponType1"] == 12
    assert readers.read_external_scores(spark, path, CODING_SPEC.columns).first()["WeaponType1"] == 12.0
