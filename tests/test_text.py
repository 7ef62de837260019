"""Answers, text features, folds and batches against plain restatements."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from narracode.functions import text as X
from narracode.operators import answers as A
from narracode.operators import features as V
from narracode.operators.corpus import mask_tokens, stack_texts
from narracode.operators.folds import batch_ids, global_rank, hash_key, kfold, stratified_kfold
from narracode.operators.labels import align, assign, corpus, decode_lookup, encode_lookup, validate, validate_labels
from narracode.spec import CODING_SPEC, LOCATION_CODES, LOCATION_NAMES, WEAPON_CODES, WEAPON_NAMES, LabelSpec, slot_names

TEXTS = {
    "1": "a bb  cccc\tdddddddddd e.F",
    "2": "Élan vital élan; über_x 12 a1",
    "3": "",
    "4": "the cat the cat the dog\nthe end",
    "5": "x",
}


def docs(spark, texts=TEXTS):
    return spark.createDataFrame(list(texts.items()), "uid string, text string")


def py_words(text, low, high, stop=()):
    tokens = [w for w in re.findall(r"(?u)\b\w\w+\b", text.lower()) if w not in stop]
    return Counter(" ".join(tokens[i : i + n]) for n in range(low, high + 1) for i in range(len(tokens) - n + 1))


def py_chars(text, low, high):
    out = Counter()
    for word in text.lower().split():
        padded = f" {word} "
        for n in range(low, high + 1):
            out.update([padded[i : i + n] for i in range(max(1, len(padded) - n + 1))])
            if len(padded) <= n:
                break
    return out


def collected(terms):
    out = {}
    for r in terms.collect():
        out.setdefault(r["uid"], {})[r["term"]] = r["tf"]
    return out


@pytest.mark.parametrize("stop", [None, ["the"]])
def test_word_terms(spark, stop):
    want = {u: dict(c) for u, t in TEXTS.items() if (c := py_words(t, 1, 3, stop or ()))}
    assert collected(V.word_terms(docs(spark), 1, 3, stop)) == want


def test_char_terms(spark):
    want = {u: dict(c) for u, t in TEXTS.items() if (c := py_chars(t, 3, 6))}
    assert collected(V.char_terms(docs(spark), 3, 6)) == want


def test_given_documents_have_the_same_terms(spark, sf):
    from narracode.catalog import tables as t

    given = t.docs(spark, sf)
    texts = {r["uid"]: r["text"] for r in given.collect()}
    got = collected(V.char_terms(given, 3, 5))
    assert got == {u: dict(c) for u, x in texts.items() if (c := py_chars(x, 3, 5))}
    words = collected(V.word_terms(given, 1, 2))
    assert words == {u: dict(c) for u, x in texts.items() if (c := py_words(x, 1, 2))}


@pytest.mark.parametrize("limit", [None, 7])
def test_vocabulary_and_weights(spark, limit):
    tf = {u: py_words(t, 1, 2) for u, t in TEXTS.items()}
    total, df = Counter(), Counter()
    for counts in tf.values():
        total.update(counts)
        df.update(counts.keys())
    kept = [w for w in total if df[w] <= 0.9 * 5]
    if limit:
        kept = sorted(kept, key=lambda w: (-total[w], w))[:limit]
    ids = {w: i for i, w in enumerate(sorted(kept))}
    idf = {w: math.log(6 / (1 + df[w])) + 1 for w in ids}
    terms = V.word_terms(docs(spark), 1, 2)
    vocab = V.fit_vocab(terms, 5, 1, 0.9, limit)
    assert {r["term"]: r["term_id"] for r in vocab.collect()} == ids
    assert {r["term"]: r["idf"] for r in vocab.collect()} == pytest.approx(idf)
    weights = V.packed_weights(terms, vocab)
    vectors = {r["uid"]: r["features"].toArray() for r in V.to_vector(weights, len(ids), docs(spark)).collect()}
    for uid, counts in tf.items():
        want = np.zeros(len(ids))
        for w, n in counts.items():
            if w in ids:
                want[ids[w]] = (1 + math.log(n)) * idf[w]
        norm = np.linalg.norm(want)
        assert vectors[uid] == pytest.approx(want / norm if norm else want)


def test_top_terms_cuts_ties_in_term_order(spark):
    totals = spark.createDataFrame([(w, 1, n) for w, n in [("d", 2), ("a", 2), ("c", 2), ("b", 9), ("e", 1)]], "term string, df bigint, tf bigint")
    assert [r["term"] for r in V.top_terms(totals, 3).collect()] == ["b", "a", "c"]
    assert V.top_terms(totals, 50).count() == 5


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 203])
def test_fold_sizes(spark, n):
    got = kfold(spark.range(n).select(F.col("id").cast("string").alias("uid")), 5, 1).groupBy("fold").count().collect()
    sizes = {r["fold"]: r["count"] for r in got}
    assert sizes == {f: n // 5 + (f < n % 5) for f in range(min(n, 5))}


def test_folds_do_not_depend_on_the_partitioning(spark):
    keys = spark.range(100).select(F.col("id").cast("string").alias("uid"))
    one = {r["uid"]: r["fold"] for r in kfold(keys.coalesce(1), 4, 9).collect()}
    many = {r["uid"]: r["fold"] for r in kfold(keys.repartition(7), 4, 9).collect()}
    other_seed = {r["uid"]: r["fold"] for r in kfold(keys, 4, 10).collect()}
    assert one == many != other_seed


def test_stratified_folds_balance_every_class(spark):
    rows = [(str(i), label, y) for label in ("a", "b") for i in range(90) for y in [i % 3 if label == "a" else int(i < 60)]]
    df = spark.createDataFrame(rows, "uid string, label string, y int")
    counts = stratified_kfold(df, 4, 3).groupBy("label", "y", "fold").count().collect()
    for label, y in {(r["label"], r["y"]) for r in counts}:
        sizes = [r["count"] for r in counts if (r["label"], r["y"]) == (label, y)]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1


def test_global_rank_with_one_hot_value(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("uid"), F.when(F.col("id") < 400, 7).otherwise(F.col("id")).alias("v"))
    ranked = global_rank(df, hash_key(0, "uid"), coarse=F.col("v")).collect()
    want = sorted(ranked, key=lambda r: r["rank"])
    assert [r["rank"] for r in want] == list(range(500)) and {r["n"] for r in want} == {500}
    assert [r["v"] for r in want] == sorted(r["v"] for r in ranked)


@pytest.mark.parametrize("n", [1, 2, 5, 33])
def test_batches(spark, n):
    df = spark.range(n).select(F.col("id").cast("string").alias("uid"), (F.col("id") % 5).cast("int").alias("len"))
    got = [(r["batch"], r["len"]) for r in batch_ids(df, 2, F.col("len")).collect()]
    parts = [range(n)] if n <= 2 else np.array_split(range(n), n // 2)
    assert Counter(b for b, _ in got) == {i: len(p) for i, p in enumerate(parts)}
    by_batch = sorted(got)
    assert [v for _, v in sorted(by_batch, key=lambda x: (x[0], -x[1]))] == sorted((v for _, v in got), reverse=True)


# ------------------------------------------------------------------------ labels


def test_corpus_is_null_when_a_side_is_null(spark):
    df = spark.createDataFrame([("1", "a.b", "c.9d"), ("2", None, "x")], "uid string, narrative_le string, narrative_cme string")
    assert [r["text"] for r in corpus(df).orderBy("uid").collect()] == ["a. b c.9d", None]


def test_align_and_assign_keep_the_order_table(spark):
    order = spark.createDataFrame([("a", 0), ("b", 1)], "uid string, pos int")
    df = spark.createDataFrame([("b", 5), ("c", 6)], "uid string, v int")
    assert sorted(map(tuple, align(df, order).select("uid", "v").collect())) == [("a", None), ("b", 5)]
    assert align(df, order.filter("uid = 'b'"), strict=True).select("uid", "v").collect() == [("b", 5)]
    with pytest.raises(Exception, match="no row for uid a"):
        align(df, order, strict=True).select("uid", "v").collect()
    template = spark.createDataFrame([("a", 1), ("b", 1)], "uid string, v int")
    assert sorted(map(tuple, assign(template, df, ["v"]).collect())) == [("a", 1), ("b", 5)]


def test_validate_reports_each_fault(spark):
    spec = LabelSpec(["a"], {"c": 3})
    good = spark.createDataFrame([("1", 1, 3)], "uid string, a int, c int")
    assert all(r["ok"] for r in validate(good, good, spec).collect())
    bad = spark.createDataFrame([("1", 2, None), ("2", 0, 1)], "uid string, a int, c int")
    got = {r["check"]: r["ok"] for r in validate(bad, good, spec).collect()}
    assert got == {
        "n_columns": True, "same_columns": True, "integer_columns": True,
        "same_keys": False, "no_nulls": False, "codes_in_range": False,
    }
    floats = spark.createDataFrame([("1", 1.0, 3)], "uid string, a double, c int")
    assert not {r["check"]: r["ok"] for r in validate(floats, good, spec).collect()}["integer_columns"]


def test_validate_labels(spark):
    spec = LabelSpec(["a"], {"c": 2})
    good = spark.createDataFrame([("1", 1, 1), ("2", 0, 2)], "uid string, a int, c int")
    assert all(r["ok"] for r in validate_labels(good, spec).collect())
    bad = {r["check"]: r["ok"] for r in validate_labels(good.limit(1).union(good.limit(1)), spec).collect()}
    assert bad == {"unique_keys": False, "classes_c": False}


def test_slots(spark):
    rows = slot_names(CODING_SPEC.frame(spark)).orderBy("idx").collect()
    assert len(rows) == 39 and [r["idx"] for r in rows] == list(range(39))
    assert (rows[0]["name"], rows[21]["name"], rows[27]["name"], rows[38]["name"]) == (
        "DepressedMood", "InjuryLocationType_0", "WeaponType1_00", "WeaponType1_11",
    )


# ----------------------------------------------------------------------- answers


def py_clean(raw, idx):
    a = re.sub(r"Question.*", "", raw.rstrip()).rstrip()
    if idx <= 21:
        return " yes" if "yes" in a.lower() else " no"
    return " unknown" if a.strip().lower() == "nan" else a


def test_clean_answer(spark):
    raws = [" Yes Question 5: x", " NaN", " nan\t\n", "Firearm \n Question 3: q\nmore", "", " Eyes", " Other (e.g. x) ", "Question"]
    rows = [(r, i) for r in raws for i in (1, 21, 22, 23)]
    df = spark.createDataFrame(rows, "raw string, idx int")
    got = df.select("raw", "idx", A.clean_answer(F.col("raw"), F.col("idx")).alias("a")).collect()
    assert [r["a"] for r in got] == [py_clean(r["raw"], r["idx"]) for r in got]


def py_parse(text):
    return dict(zip(CODING_SPEC.columns, [line.split(":")[-1].strip() for line in text.splitlines() if line]))


def test_parse_response(spark):
    texts = ["", "Q: yes\n\nQ:\tno ", "\n".join(f"Q: a:{i}" for i in range(30)), "no colon\r\nQ:x:", "a\n  \nb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", A.parse_response(F.col("t"), CODING_SPEC.columns).alias("m")).collect()
    assert [r["m"] for r in got] == [py_parse(r["t"]) for r in got]


def test_render_parse_code_round_trip(spark):
    rng = np.random.default_rng(0)
    rows = [(str(i), *map(int, rng.integers(0, 2, 21)), int(rng.integers(1, 7)), int(rng.integers(1, 13))) for i in range(30)]
    schema = ", ".join(["uid string", *[f"{c} int" for c in CODING_SPEC.columns]])
    codes = spark.createDataFrame(rows, schema)
    lines = F.concat_ws("\n", *[F.concat(F.lit("Q: "), F.col(c)) for c in CODING_SPEC.columns])
    responses = A.decode_labels(codes).select("uid", lines.alias("response"))
    assert sorted(map(tuple, A.answers_to_codes(responses).collect())) == sorted(rows)


def test_defaults_of_short_and_missing_responses(spark):
    df = spark.createDataFrame([("short", "Q: YES"), ("none", None), ("odd", "\n".join(["Q: perhaps"] * 23))], "uid string, response string")
    got = {r["uid"]: r for r in A.answers_to_codes(df).collect()}
    assert (got["short"]["DepressedMood"], got["short"]["Argument"]) == (1, 0)
    assert (got["short"]["InjuryLocationType"], got["short"]["WeaponType1"]) == (6, 11)
    assert (got["none"]["InjuryLocationType"], got["none"]["WeaponType1"]) == (1, 5)
    assert (got["odd"]["InjuryLocationType"], got["odd"]["WeaponType1"], got["odd"]["Argument"]) == (6, 11, 0)
    unexpected = A.unexpected_values(A.answer_codes_long(df))
    assert unexpected.filter("raw = 'perhaps'").count() == 23
    assert [r["uid"] for r in A.unparsed_keys(df).collect()] == ["none"]
    assert A.unparsed_count(df).first()["n"] == 1


def test_vocabularies_decode_and_encode(spark):
    for names, codes, default in ((LOCATION_NAMES, LOCATION_CODES, 6), (WEAPON_NAMES, WEAPON_CODES, 11)):
        df = spark.createDataFrame([(c,) for c in names], "c int")
        back = encode_lookup(decode_lookup(df, "c", names, "name"), "name", codes, "again", default)
        assert all(r["c"] == r["again"] for r in back.collect())
    assert (WEAPON_CODES["train"], WEAPON_CODES["no weapon used"], WEAPON_CODES["carbon monoxide"]) == (11, 11, 9)


def test_merge_vocab_takes_the_last_entry(spark):
    rows = [("a", 1, 0), ("b", 2, 1), ("a", 3, 2)]
    got = A.merge_vocab(spark.createDataFrame(rows, "raw string, code int, src_pos int")).collect()
    assert {r["raw"]: r["code"] for r in got} == {"a": 3, "b": 2}


def test_json_answers(spark):
    texts = ['{"a": "1"}', '{"a": "1"} -- more', '{"a": "1"} and } more', "nothing"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(A.parse_json_answer(F.col("t"))).collect()
    assert [r[0] for r in got] == [{"a": "1"}, {"a": "1"}, {"a": "1"}, None]


def test_prompts(spark):
    records = spark.createDataFrame([("1", "one", None)], "uid string, narrative_le string, narrative_cme string")
    codes = spark.createDataFrame([(str(i), *[0] * 21, 1, 11) for i in range(5)], ", ".join(["uid string", *[f"{c} int" for c in CODING_SPEC.columns]]))
    train = codes.select("uid", F.lit("le").alias("narrative_le"), F.lit("cme").alias("narrative_cme"), F.col("uid").cast("int").alias("pos"))
    block = A.render_examples(train, codes)
    text = block.first()["block"]
    assert text.count("EXAMPLE INPUT") == 3 and "Question 23:" in text and text.count("Answer: no\n") == 63
    prompt = A.render_prompt(records, block).first()["prompt"]
    assert prompt.startswith("You are an expert") and text in prompt and prompt.endswith("nan\n\nOUTPUT:\n")
    assert "Q23. Type of weapon" in prompt and len(A.render_prompt(records).first()["prompt"]) < len(prompt)


# ------------------------------------------------------------------------ corpus


def test_strip_and_null_tokens(spark):
    df = spark.createDataFrame([("\t a b \n",), ("NA",), ("",), ("nan",), ("nano",)], "t string")
    got = df.select(X.strip(F.col("t")), X.rstrip(F.col("t")), X.tokens_to_null(F.col("t"))).collect()
    assert got[0][0] == "a b" and got[0][1] == "\t a b"
    assert [r[2] for r in got] == ["\t a b \n", None, None, None, "nano"]


def test_masking_shares_and_whole_lines(spark):
    lines = spark.createDataFrame([(str(i), " ".join(f"w{j}" for j in range(100))) for i in range(100)] + [("x", "")], "line_id string, line string")
    vocab = spark.createDataFrame([(i, f"v{i}") for i in range(10)], "term_id int, term string")
    rows = mask_tokens(lines, vocab, 10, block=30).collect()
    assert len(rows) == 10_000 and max(r["pos"] for r in rows) == 29 and max(r["block_no"] for r in rows) == 3
    chosen = [r for r in rows if r["masked"]]
    assert len(chosen) / 10_000 == pytest.approx(0.15, abs=0.015)
    kinds = Counter("mask" if r["token"] == "[MASK]" else "keep" if r["token"] == r["target"] else "random" for r in chosen)
    assert kinds["mask"] / len(chosen) == pytest.approx(0.8, abs=0.04)
    assert kinds["random"] > 0 and kinds["keep"] > 0
    assert all(r["target"] is None and r["token"].startswith("w") for r in rows if not r["masked"])
    again = mask_tokens(lines.repartition(5), vocab, 10, block=30).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in again}


def test_stacked_lines(spark):
    df = spark.createDataFrame([("1", "a\n\nb", "c")], "uid string, narrative_le string, narrative_cme string")
    got = [(r["part"], r["line_no"], r["line"]) for r in stack_texts(df).orderBy("part", "line_no").collect()]
    assert got == [(0, 0, "a"), (0, 1, ""), (0, 2, "b"), (1, 0, "c")]
