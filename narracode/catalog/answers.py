"""Prompts, answers and codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from narracode.catalog import tables as t
from narracode.catalog.labels import codes_sql
from narracode.catalog.registry import query
from narracode.operators import answers as A
from narracode.operators.scoring import answer_batches
from narracode.plans.coding import code_records
from narracode.spec import (
    CODING_SPEC,
    EXAMPLE_BLOCK,
    LOCATION_CODES,
    LOCATION_NAMES,
    QUESTIONS,
    RECORD_BLOCK,
    UNPARSED_LOCATION,
    UNPARSED_WEAPON,
    WEAPON_CODES,
    WEAPON_NAMES,
    YES_NO_CODES,
)


def filled(template: str, *values: str) -> str:
    """The fixed text with SQL expressions in its places."""
    pieces = template.split("%s")
    out = [t.quote(pieces[0])]
    for value, piece in zip(values, pieces[1:], strict=True):
        out += [value, t.quote(piece)]
    return " || ".join(out)


def train_records(spark, sf):
    """All documents with a position."""
    return t.records(spark, sf).withColumn("pos", F.col("uid").cast("bigint"))


_answer_of = {
    c: f"CASE {c} WHEN 1 THEN 'yes' ELSE 'no' END" for c in CODING_SPEC.binary
} | {"InjuryLocationType": t._case("InjuryLocationType", LOCATION_NAMES), "WeaponType1": t._case("WeaponType1", WEAPON_NAMES)}
_answers = " || ".join(
    f"{t.quote(f'Question {i}: {q}' + chr(10) + 'Answer: ')} || {_answer_of[c]} || chr(10)"
    for i, (q, c) in enumerate(zip(QUESTIONS, CODING_SPEC.columns, strict=True), start=1)
)
_blocks = {
    "picked": "SELECT * FROM records JOIN coded USING (uid) ORDER BY CAST(uid AS BIGINT) LIMIT 3",
    "block": "SELECT string_agg("
    + filled(EXAMPLE_BLOCK, "narrative_le", "narrative_cme", f"({_answers})")
    + ", chr(10) ORDER BY CAST(uid AS BIGINT)) AS block FROM picked",
}


@query("render_examples", t.with_tables("SELECT block FROM block", "records", "coded", extra=_blocks))
def render_examples(spark, sf):
    return A.render_examples(train_records(spark, sf), t.coded(spark, sf))


@query(
    "render_prompt",
    t.with_tables(
        f"SELECT uid, md5({t.quote(A.instruction())} || chr(10) || block || chr(10) || {filled(RECORD_BLOCK, 'narrative_le', 'narrative_cme')}) AS prompt_md5 "
        "FROM records, block",
        "records",
        "coded",
        extra=_blocks,
    ),
)
def render_prompt(spark, sf):
    block = A.render_examples(train_records(spark, sf), t.coded(spark, sf))
    prompts = A.render_prompt(t.records(spark, sf), block)
    return prompts.select("uid", F.md5("prompt").alias("prompt_md5"))


_raw_answer = (
    "SELECT conv_id, turn, ' ' || text || CASE WHEN turn % 3 = 0 THEN ' Question 5: more' ELSE ' ' END AS raw, "
    "CAST(turn % 23 + 1 AS INT) AS idx FROM conversations "
    "UNION ALL SELECT -1 - doc_id, doc_id, CASE doc_id % 4 WHEN 0 THEN ' NaN ' WHEN 1 THEN ' Yes, it was' WHEN 2 THEN ' Firearm' || chr(10) || 'Question 4: a' ELSE '' END, "
    "CAST(doc_id % 23 + 1 AS INT) FROM documents"
)


@query(
    "clean_answer",
    t.with_tables(
        "SELECT conv_id, turn, CASE WHEN idx <= 21 THEN CASE WHEN contains(lower(cut), 'yes') THEN ' yes' ELSE ' no' END "
        r"WHEN lower(regexp_replace(cut, '^\s+|\s+$', '', 'g')) = 'nan' THEN ' unknown' ELSE cut END AS answer FROM "
        r"(SELECT *, regexp_replace(regexp_replace(regexp_replace(raw, '\s+$', ''), 'Question[^\n]*', '', 'g'), '\s+$', '') AS cut FROM raws)",
        extra={"raws": _raw_answer},
    ),
)
def clean_answer(spark, sf):
    """Dialogue turns and short answers, put to questions in turn."""
    tail = F.when(F.col("turn") % 3 == 0, " Question 5: more").otherwise(" ")
    turns = t.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat(F.lit(" "), "text", tail).alias("raw"), (F.col("turn") % 23 + 1).cast("int").alias("idx")
    )
    kind = F.col("doc_id") % 4
    short = (
        F.when(kind == 0, " NaN ").when(kind == 1, " Yes, it was").when(kind == 2, " Firearm\nQuestion 4: a").otherwise("")
    )
    extra = t.table(spark, sf, "documents").select(
        (-1 - F.col("doc_id")).alias("conv_id"), F.col("doc_id").alias("turn"), short.alias("raw"), (F.col("doc_id") % 23 + 1).cast("int").alias("idx")
    )
    raws = turns.unionByName(extra)
    return raws.select("conv_id", "turn", A.clean_answer(F.col("raw"), F.col("idx")).alias("answer"))


_split = r"'\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'"
_parsed = {
    "lines": f"SELECT uid, response, list_filter(regexp_split_to_array(response, {_split}), lambda x: x <> '') AS l FROM responses",
    "fields": r"SELECT uid, response, list_transform(l, lambda x: regexp_replace(string_split(x, ':')[-1], '^\s+|\s+$', '', 'g')) AS a FROM lines",
    "labels_": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(CODING_SPEC.columns, start=1)) + ") v(i, label)",
    "parsed": "SELECT uid, label, a[i] AS answer FROM fields, labels_ WHERE response IS NOT NULL AND i <= len(a)",
}


@query("parse_response", t.with_tables("SELECT uid, label, answer FROM parsed", "responses", extra=_parsed))
def parse_response(spark, sf):
    answers = A.parse_response(F.col("response"), CODING_SPEC.columns)
    return t.responses(spark, sf).select("uid", F.explode(answers).alias("label", "answer"))


@query(
    "yes_no_code",
    t.with_tables(
        f"SELECT uid, label, COALESCE(code, 0) AS code FROM parsed LEFT JOIN ({codes_sql(YES_NO_CODES)}) ON lower(answer) = raw",
        "responses",
        extra=_parsed,
    ),
)
def yes_no_code(spark, sf):
    answers = A.parse_response(F.col("response"), CODING_SPEC.columns)
    long = t.responses(spark, sf).select("uid", F.explode(answers).alias("label", "answer"))
    return long.select("uid", "label", A.yes_no_code(F.col("answer")).alias("code"))


@query(
    "location_code",
    t.with_tables(
        f"SELECT uid, COALESCE(code, 6) AS code FROM parsed LEFT JOIN ({codes_sql(LOCATION_CODES)}) ON lower(answer) = raw WHERE label = 'InjuryLocationType'",
        "responses",
        extra=_parsed,
    ),
)
def location_code(spark, sf):
    answers = A.parse_response(F.col("response"), CODING_SPEC.columns)
    texts = t.responses(spark, sf).select("uid", F.try_element_at(answers, F.lit(t.LOCATION)).alias("raw_text"))
    return A.location_code(texts.filter(F.col("raw_text").isNotNull()), "raw_text", "code").select("uid", "code")


@query(
    "weapon_code",
    t.with_tables(
        f"SELECT uid, COALESCE(code, 11) AS code FROM parsed LEFT JOIN ({codes_sql(WEAPON_CODES)}) ON lower(answer) = raw WHERE label = 'WeaponType1'",
        "responses",
        extra=_parsed,
    ),
)
def weapon_code(spark, sf):
    answers = A.parse_response(F.col("response"), CODING_SPEC.columns)
    texts = t.responses(spark, sf).select("uid", F.try_element_at(answers, F.lit(t.WEAPON)).alias("raw_text"))
    return A.weapon_code(texts.filter(F.col("raw_text").isNotNull()), "raw_text", "code").select("uid", "code")


@query(
    "parse_json_answer",
    "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
)
def parse_json_answer(spark, sf):
    """Events' JSON properties with a tail after a rule, a tail after the brace, or no tail."""
    kind = F.col("event_id") % 3
    tail = F.when(kind == 0, "").when(kind == 1, "-- end").otherwise(" and more}")
    text = F.concat("props", tail)
    return t.table(spark, sf, "events").select("event_id", A.parse_json_answer(text)["k"].alias("k"))


_wide = (
    "SELECT r.uid, "
    + ", ".join(
        f"CASE WHEN r.response IS NULL THEN {t.quote(UNPARSED_LOCATION) if c == 'InjuryLocationType' else t.quote(UNPARSED_WEAPON) if c == 'WeaponType1' else 'NULL'} "
        f"ELSE r.a[{i}] END AS {c}"
        for i, c in enumerate(CODING_SPEC.columns, start=1)
    )
    + " FROM fields r"
)


@query(
    "answer_defaults",
    t.with_tables(
        "SELECT uid, COALESCE(DepressedMood, '0') AS first, COALESCE(InjuryLocationType, '0') AS place, COALESCE(WeaponType1, '0') AS weapon FROM wide_",
        "responses",
        extra={**_parsed, "wide_": _wide},
    ),
)
def answer_defaults(spark, sf):
    wide = A.answer_columns(t.responses(spark, sf))
    picks = {"first": "DepressedMood", "place": t.LOCATION, "weapon": t.WEAPON}
    return wide.select("uid", *[F.coalesce(F.col(c), F.lit("0")).alias(n) for n, c in picks.items()])


def _code_of(c: str) -> str:
    if c == "InjuryLocationType":
        return f"COALESCE((SELECT code FROM loc_ WHERE raw = lower({c})), 6) AS {c}"
    if c == "WeaponType1":
        return f"COALESCE((SELECT code FROM weap_ WHERE raw = lower({c})), 11) AS {c}"
    return f"COALESCE((SELECT code FROM yn_ WHERE raw = lower({c})), 0) AS {c}"


_tables = {"loc_": codes_sql(LOCATION_CODES), "weap_": codes_sql(WEAPON_CODES), "yn_": codes_sql(YES_NO_CODES)}


@query(
    "answers_to_codes",
    t.with_tables(
        f"SELECT uid, {', '.join(_code_of(c) for c in CODING_SPEC.columns)} FROM wide_",
        "responses",
        extra={**_parsed, "wide_": _wide, **_tables},
    ),
)
def answers_to_codes(spark, sf):
    return A.answers_to_codes(t.responses(spark, sf))


_long = " UNION ALL ".join(
    f"SELECT uid, '{c}' AS label, {c} AS raw, (SELECT code FROM {dict(InjuryLocationType='loc_', WeaponType1='weap_').get(c, 'yn_')} x "
    f"WHERE x.raw = lower(w.{c})) AS code FROM wide_ w"
    for c in CODING_SPEC.columns
)


@query(
    "unexpected_values",
    t.with_tables(
        "SELECT label, COALESCE(raw, '') AS raw, count(*) AS n FROM long_ WHERE code IS NULL GROUP BY 1, 2",
        "responses",
        extra={**_parsed, "wide_": _wide, **_tables, "long_": _long},
    ),
)
def unexpected_values(spark, sf):
    found = A.unexpected_values(A.answer_codes_long(t.responses(spark, sf)))
    return found.groupBy("label", F.coalesce("raw", F.lit("")).alias("raw")).agg(F.sum("n").alias("n"))


@query(
    "unparsed_report",
    t.with_tables("SELECT uid, (SELECT count(*) FROM responses WHERE response IS NULL) AS n FROM responses WHERE response IS NULL", "responses"),
)
def unparsed_report(spark, sf):
    responses = t.responses(spark, sf)
    return A.unparsed_keys(responses).withColumn("n", A.unparsed_count(responses).scalar())


def by_accent(prompts: list[str], question: str) -> list[str]:
    """A stand-in for a question-answering model: looks for an accented letter in the record."""
    out = []
    for prompt in prompts:
        found = "é" in prompt.rsplit("\nINPUT:\n", 1)[1]
        if question.startswith("Type of weapon"):
            out.append(" GSW to the head \nQuestion 24: x" if found else " NaN")
        elif question.startswith("The type of place"):
            out.append(" Dorm" if found else " nowhere")
        else:
            out.append(" Yes, it was" if found else " unknown\nQuestion 3: yes")
    return out


_found = "contains(narrative_le || narrative_cme, 'é')"
# a line of the answer to a yes/no question; cutting the next question leaves no "yes" in it
_accent = {
    "seen": f"SELECT uid, {_found} AS hit FROM records",
    "lines_": "SELECT uid, hit, CASE WHEN hit THEN 'Q: yes' ELSE 'Q: no' END AS l FROM seen",
}


@query(
    "answer_batches",
    t.with_tables(
        "SELECT uid, md5(repeat(l || chr(10), 21) || CASE WHEN hit THEN 'Q: Dorm' || chr(10) || 'Q: GSW to the head' "
        "ELSE 'Q: nowhere' || chr(10) || 'Q: unknown' END) AS response_md5 FROM lines_",
        "records",
        extra=_accent,
    ),
)
def answer_batches_query(spark, sf):
    """All questions in turn over all records."""
    responses = answer_batches(A.render_prompt(t.records(spark, sf)), by_accent)
    return responses.select("uid", F.md5("response").alias("response_md5"))


@query(
    "code_records",
    t.with_tables(
        "SELECT uid, "
        + ", ".join(f"CAST(hit AS INT) AS {c}" for c in CODING_SPEC.binary)
        + ", CASE WHEN hit THEN 1 ELSE 6 END AS InjuryLocationType, CASE WHEN hit THEN 5 ELSE 12 END AS WeaponType1 FROM seen",
        "records",
        extra={"seen": _accent["seen"]},
    ),
)
def code_records_query(spark, sf):
    """Records to prompts, answers of the stand-in model, and codes."""
    return code_records(t.records(spark, sf), train_records(spark, sf), t.coded(spark, sf), by_accent)
