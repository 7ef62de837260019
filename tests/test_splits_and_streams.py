"""Quoted line breaks over split edges, one submission file, the stateful stream."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from narracode.operators.thresholds import running_best
from narracode.sources import readers, records, writers
from narracode.streaming.best_events import append_events

SCHEMA = "uid string, NarrativeLE string, NarrativeCME string"


@pytest.fixture
def tiny_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    kept = {k: spark.conf.get(k) for k in keys}

    def set_size(n):
        for k, v in zip(keys, (n, 1), strict=True):
            spark.conf.set(k, str(v))

    yield set_size
    for k, v in kept.items():
        spark.conf.set(k, v)


def field(rng):
    text = "".join(rng.choices(["a", "b c", ",", '"', "\n", "\r\n", "é", " ", "\n\n", '""'], k=rng.randrange(1, 14))).strip()
    return text or "x"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("size", [1, 7, 33, 200, 10**6])
def test_quoted_line_breaks_over_split_edges(spark, tmp_path, tiny_splits, size):
    rng = random.Random(size)
    folder, want = tmp_path / "csv", []
    folder.mkdir()
    for f in range(3):
        rows = pd.DataFrame([(f"{f}-{i}", field(rng), field(rng)) for i in range(40)], columns=["uid", "NarrativeLE", "NarrativeCME"])
        # only fields that need quotes have them
        rows.to_csv(folder / f"{f}.csv", index=False, lineterminator="\n")
        back = pd.read_csv(folder / f"{f}.csv", keep_default_na=False, dtype=str)
        want += [tuple(r) for r in back.itertuples(index=False)]
    tiny_splits(size)
    got = records.read_quoted(spark, str(folder), SCHEMA)
    assert rows_of(got) == sorted(want)
    if size < 10**6:
        assert records.lines(spark, str(folder)).select("_file", "_start").distinct().count() > 6


def test_a_record_longer_than_many_splits(spark, tmp_path, tiny_splits):
    long = "one \"word\"\n" * 400
    path = str(tmp_path / "one.csv")
    pd.DataFrame([("1", long, "b"), ("2", "c", "d\n"), ("3", "e", "")], columns=["uid", "NarrativeLE", "NarrativeCME"]).to_csv(path, index=False)
    tiny_splits(100)
    assert records.has_broken_records(spark, path)
    got = {r.uid: r for r in readers.read_records(spark, path).collect()}
    assert got["1"].narrative_le == long and got["2"].narrative_cme == "d\n" and got["3"].narrative_cme is None
    assert len(got) == 3


def test_files_without_broken_records_take_the_plain_reader(spark, tmp_path):
    path = str(tmp_path / "plain.csv")
    pd.DataFrame([("1", 'a "b", c', "d")], columns=["uid", "NarrativeLE", "NarrativeCME"]).to_csv(path, index=False)
    assert not records.has_broken_records(spark, path)
    got = readers.read_records(spark, path)
    assert got.first().narrative_le == 'a "b", c' and "Window" not in got._jdf.queryExecution().toString()


def test_one_file_in_template_order(spark, tmp_path):
    names = [f"u{i:04d}" for i in range(500)]
    random.Random(1).shuffle(names)
    template = pd.DataFrame({"uid": names, "a": 0, "b": 5})
    rows = spark.createDataFrame([(n, i, 0, 5) for i, n in enumerate(names)], "uid string, template_pos long, a int, b int")
    rows = rows.select("uid", "a", "b", "template_pos").repartition(7)
    preds = spark.createDataFrame([(n, int(n[1:]) % 2) for n in names[::3]], "uid string, a int")
    path = str(tmp_path / "out.csv")
    writers.write_submission_file(preds, rows, path, ["a"])
    template.loc[::3, "a"] = [int(n[1:]) % 2 for n in names[::3]]
    template.to_csv(tmp_path / "want.csv", index=False)
    assert open(path, "rb").read() == open(tmp_path / "want.csv", "rb").read()
    assert [p.name for p in tmp_path.iterdir() if "parts" in p.name] == []
    with pytest.raises(FileExistsError):
        writers.write_submission_file(preds, rows, path, ["a"])


def test_stream_over_triggers_and_restarts(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k % 2, "ab"[k % 3 > 0], k, rng.randrange(101) * 0.01, rng.choice([0.0, 0.2, 0.2, 0.5, 0.7])) for k in range(120)]
    evals = spark.createDataFrame(rows, "run int, label string, step long, thresh double, f1 double")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for k in range(4):
        part = evals.filter((F.col("step") >= 30 * k) & (F.col("step") < 30 * k + 30))
        if k == 3:  # a step that comes late, and one that comes twice
            part = part.unionByName(evals.filter("step in (2, 89)").withColumn("f1", F.lit(1.0)))
        part.repartition(2).write.mode("append").parquet(source)
        append_events(spark.readStream.schema(evals.schema).parquet(source), out, state)
    cols = ["run", "label", "step", "thresh", "f1", "best_thresh", "best_f1"]
    assert rows_of(spark.read.parquet(out).select(cols)) == rows_of(running_best(evals).select(cols))
