"""Prompt texts, free-text answers and their codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narracode.functions.text import last_field, nonempty_lines, rstrip, strip
from narracode.operators.labels import attach_one, decode_lookup, encode_lookup
from narracode.spec import (
    CODING_SPEC,
    DEFAULT_LOCATION,
    DEFAULT_WEAPON,
    EXAMPLE_BLOCK,
    INSTRUCTION_HEAD,
    INSTRUCTION_TAIL,
    LOCATION_CODES,
    LOCATION_NAMES,
    QUESTIONS,
    RECORD_BLOCK,
    UNPARSED_LOCATION,
    UNPARSED_WEAPON,
    WEAPON_CODES,
    WEAPON_NAMES,
    YES_NO_CODES,
    LabelSpec,
)

LOCATION, WEAPON = CODING_SPEC.categorical


def question_table(spark: SparkSession, questions: list[str] = QUESTIONS) -> DataFrame:
    return spark.createDataFrame(list(enumerate(questions, start=1)), "idx int, question string")


def instruction(questions: list[str] = QUESTIONS) -> str:
    """Head, numbered questions, tail; the questions are a driver-side list."""
    return INSTRUCTION_HEAD + "\n".join(f"Q{i}. {q}" for i, q in enumerate(questions, start=1)) + INSTRUCTION_TAIL


def fill(template: str, *values: Column) -> Column:
    """Put columns into the ``%s`` places of a fixed text; a null value reads ``nan``."""
    pieces = template.split("%s")
    out = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:], strict=True):
        out += [F.coalesce(value, F.lit("nan")), F.lit(piece)]
    return F.concat(*out)


def render_prompt(
    records: DataFrame, examples: DataFrame | None = None, questions: list[str] = QUESTIONS
) -> DataFrame:
    """``uid, prompt``: instruction, optional example block, then the record's texts."""
    record = fill(RECORD_BLOCK, F.col("narrative_le"), F.col("narrative_cme"))
    if examples is None:
        prompt = F.concat_ws("\n", F.lit(instruction(questions)), record)
        return records.select("uid", prompt.alias("prompt"))
    with_block = attach_one(records, examples, "_examples")
    prompt = F.concat_ws("\n", F.lit(instruction(questions)), F.col("_examples"), record)
    return with_block.select("uid", prompt.alias("prompt"))


def decode_labels(labels_wide: DataFrame, spec: LabelSpec = CODING_SPEC) -> DataFrame:
    """Codes to answer texts: 0/1 to no/yes, category codes to category names."""
    yes_no = {c: F.when(F.col(c) == 1, "yes").when(F.col(c) == 0, "no") for c in spec.binary}
    decoded = labels_wide.withColumns(yes_no)
    for label, names in ((LOCATION, LOCATION_NAMES), (WEAPON, WEAPON_NAMES)):
        decoded = decode_lookup(decoded.withColumnRenamed(label, "_code_in"), "_code_in", names, label).drop("_code_in")
    return decoded


def first_examples(train: DataFrame, pos: str, n: int = 3) -> DataFrame:
    """The first ``n`` rows by a position column (a top-n, not a full sort)."""
    return train.orderBy(pos).limit(n)


def render_examples(train: DataFrame, labels: DataFrame, pos: str = "pos", n: int = 3) -> DataFrame:
    """One row ``block``: the first ``n`` training records as example input and output.

    ``train`` has the narratives and a position, ``labels`` the codes. The rows are picked
    first; only their labels are looked up and decoded.
    """
    picked = first_examples(train, pos, n)
    # n keys
    few = labels.join(F.broadcast(picked.select("uid")), "uid", "left_semi")
    coded = picked.join(decode_labels(few), "uid", "left")
    answers = F.concat(
        *[
            F.concat(F.lit(f"Question {i}: {q}\nAnswer: "), F.coalesce(F.col(c), F.lit("nan")), F.lit("\n"))
            for i, (q, c) in enumerate(zip(QUESTIONS, CODING_SPEC.columns, strict=True), start=1)
        ]
    )
    block = fill(EXAMPLE_BLOCK, F.col("narrative_le"), F.col("narrative_cme"), answers)
    listed = coded.agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), block.alias("text")))).alias("l"))
    return listed.select(F.array_join(F.col("l.text"), "\n").alias("block"))


# ---------------------------------------------------------------------- answers


def clean_answer(raw: Column, idx: Column, n_yes_no: int = 21) -> Column:
    """Cut a tail that starts a new question; yes/no questions become exactly yes or no,
    later ones keep their text with ``nan`` read as unknown."""
    cut = rstrip(F.regexp_replace(rstrip(raw), r"Question[^\n]*", ""))
    yes_no = F.when(F.contains(F.lower(cut), F.lit("yes")), " yes").otherwise(" no")
    text = F.when(F.lower(strip(cut)) == "nan", " unknown").otherwise(cut)
    return F.when(idx <= n_yes_no, yes_no).otherwise(text)


def parse_response(response: Column, labels: list[str]) -> Column:
    """Map label to answer: the n-th non-empty line answers the n-th label, by the field after
    its last colon. A short response leaves labels out; extra lines are ignored."""
    answers = F.transform(nonempty_lines(response), lambda line: strip(last_field(line)))
    n = F.least(F.size(answers), F.lit(len(labels)))
    names = F.array(*[F.lit(c) for c in labels])
    return F.map_from_arrays(F.slice(names, F.lit(1), n), F.slice(answers, F.lit(1), n))


def parse_json_answer(text: Column) -> Column:
    """JSON object as a map: the text itself, else the part before ``--``, else the part up to
    the first closing brace."""
    kind = "map<string,string>"
    before_rule = F.substring_index(text, "--", 1)
    to_brace = F.concat(F.substring_index(text, "}", 1), F.lit("}"))
    return F.coalesce(*[F.from_json(t, kind) for t in (text, before_rule, to_brace)])


def yes_no_code(answer: Column, default: int | None = 0) -> Column:
    """0/1 from a yes/no text; five spellings, so a map literal and no join."""
    codes = F.create_map(*[F.lit(v) for pair in YES_NO_CODES.items() for v in pair])
    code = F.try_element_at(codes, F.lower(answer))
    return code if default is None else F.coalesce(code, F.lit(default))


def location_code(df: DataFrame, text: str, out: str, default: int | None = DEFAULT_LOCATION) -> DataFrame:
    return encode_lookup(df, text, LOCATION_CODES, out, default)


def weapon_code(df: DataFrame, text: str, out: str, default: int | None = DEFAULT_WEAPON) -> DataFrame:
    return encode_lookup(df, text, WEAPON_CODES, out, default)


def answer_columns(responses: DataFrame, spec: LabelSpec = CODING_SPEC) -> DataFrame:
    """``uid`` and one text column per label. A response that is null cannot be parsed and
    gets the placeholder row; a label a short response does not reach is null."""
    parsed = responses.withColumn("_answers", parse_response(F.col("response"), spec.columns))
    placeholder = {c: F.lit(None).cast("string") for c in spec.binary}
    placeholder |= {LOCATION: F.lit(UNPARSED_LOCATION), WEAPON: F.lit(UNPARSED_WEAPON)}
    return parsed.select(
        "uid",
        *[
            F.when(F.col("_answers").isNull(), placeholder[c])
            .otherwise(F.try_element_at(F.col("_answers"), F.lit(c)))
            .alias(c)
            for c in spec.columns
        ],
    )


def answers_to_codes(responses: DataFrame, template_cols: list[str] | None = None) -> DataFrame:
    """Responses to one integer code per label, in template column order. Two broadcast
    lookups and no shuffle."""
    spec = CODING_SPEC
    wide = answer_columns(responses, spec).withColumns({c: yes_no_code(F.col(c)) for c in spec.binary})
    wide = wide.withColumnsRenamed({LOCATION: "_loc_text", WEAPON: "_weap_text"})
    coded = weapon_code(location_code(wide, "_loc_text", LOCATION), "_weap_text", WEAPON)
    return coded.select("uid", *(template_cols or spec.columns))


def answer_codes_long(responses: DataFrame) -> DataFrame:
    """``uid, label, raw, code`` with a null code where the text has none (missing answers of
    short responses included). One pass over the responses."""
    wide = answer_columns(responses)
    coded = weapon_code(location_code(wide, LOCATION, "_loc", None), WEAPON, "_weap", None)
    codes = {LOCATION: F.col("_loc"), WEAPON: F.col("_weap")}
    rows = [
        F.struct(
            F.lit(c).alias("label"), F.col(c).alias("raw"), codes.get(c, yes_no_code(F.col(c), None)).alias("code")
        )
        for c in CODING_SPEC.columns
    ]
    return coded.select("uid", F.inline(F.array(*rows)))


def unexpected_values(codes_long: DataFrame) -> DataFrame:
    """Texts without a code, with their number of uses."""
    missing = codes_long.filter(F.col("code").isNull())
    return missing.groupBy("label", "raw").agg(F.count(F.lit(1)).alias("n"))


def unparsed_keys(responses: DataFrame) -> DataFrame:
    """Keys of responses that cannot be parsed."""
    return responses.filter(F.col("response").isNull()).select("uid")


def unparsed_count(responses: DataFrame) -> DataFrame:
    return responses.agg(F.count_if(F.col("response").isNull()).alias("n"))


def merge_vocab(entries: DataFrame, order: str = "src_pos") -> DataFrame:
    """Union of ``raw, code`` lists where a later entry replaces an earlier one."""
    return entries.groupBy("raw").agg(F.max_by("code", order).alias("code"))
