"""Adapters: the given tables as records, labels, scores, logits, evaluations and answers.

Each adapter has a Spark form (a function of session and folder) and the same definition as
SQL for the comparison engine (an entry of ``SQL``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narracode.functions.numeric import hash_uniform, hex_word
from narracode.operators.answers import decode_labels
from narracode.operators.labels import to_long
from narracode.spec import CODING_SPEC, LOCATION_NAMES, WEAPON_NAMES, LabelSpec

DOC_SPEC = LabelSpec(["quality", "toxic"], {"lang_code": 4, "source_code": 12})
LANGS = ["de", "en", "es", "fr"]
N_MODELS = 5
LOCATION, WEAPON = CODING_SPEC.categorical


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("uid"), "text")


def records(spark: SparkSession, sf: str) -> DataFrame:
    """A document's first half as one narrative, the rest as the other."""
    half = F.expr("cast(n_chars div 2 as int)")
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("uid"),
        F.substring("text", F.lit(1), half).alias("narrative_le"),
        F.substring("text", half + 1, F.length("text")).alias("narrative_cme"),
    )


def labels_wide(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.array_position(F.array(*[F.lit(x) for x in LANGS]), F.col("lang")).cast("int")
    source = (F.substring("source", 4, 10).cast("int") % 12 + 1).cast("int")
    coded = table(spark, sf, "documents").select("doc_id", lang.alias("lang_code"), source.alias("source_code"))
    return table(spark, sf, "labels").join(coded, "doc_id").select(
        F.col("doc_id").cast("string").alias("uid"), "quality", "toxic", "lang_code", "source_code"
    )


def labels_long(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("label").isin(DOC_SPEC.binary), "binary").otherwise("categorical")
    return to_long(labels_wide(spark, sf), DOC_SPEC.columns).select("uid", "label", kind.alias("kind"), "y")


def models() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(N_MODELS - 1))).alias("model")


def member_scores(spark: SparkSession, sf: str) -> DataFrame:
    """``model, uid, label, y, score`` of the binary labels."""
    rows = to_long(labels_wide(spark, sf).select("uid", *DOC_SPEC.binary), DOC_SPEC.binary).select("*", models())
    u = hash_uniform("m", F.col("model"), ":", F.col("label"), ":", F.col("uid"))
    return rows.select("model", "uid", "label", "y", (u * 0.6 + F.col("y") * 0.4).alias("score"))


def member_class_scores(spark: SparkSession, sf: str) -> DataFrame:
    """``model, uid, label, class_idx, score, y`` of the categorical labels, classes from 0."""
    cats = list(DOC_SPEC.categorical)
    rows = to_long(labels_wide(spark, sf).select("uid", *cats), cats).select("*", models())
    n = F.when(F.col("label") == cats[0], DOC_SPEC.categorical[cats[0]]).otherwise(DOC_SPEC.categorical[cats[1]])
    rows = rows.withColumn("class_idx", F.explode(F.sequence(F.lit(0), n - 1)))
    u = hash_uniform("c", F.col("model"), ":", F.col("label"), ":", F.col("class_idx"), ":", F.col("uid"))
    score = u + F.when(F.col("class_idx") == F.col("y") - 1, 0.4).otherwise(0.0)
    return rows.select("model", "uid", "label", "class_idx", score.alias("score"), "y")


def literal_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """``model, label, thresh`` on a literal grid for the labels that occur."""
    seen = member_scores(spark, sf).select("model", "label").distinct()
    return seen.withColumn("thresh", 0.3 + 0.05 * F.col("model"))


def member_preds(spark: SparkSession, sf: str) -> DataFrame:
    """``model, uid, label, kind, y, y_hat``: each member's own decisions, both label kinds."""
    binary = member_scores(spark, sf).select(
        "model", "uid", "label", F.lit("binary").alias("kind"), "y", (F.col("score") > 0.5).cast("int").alias("y_hat")
    )
    pick = F.max_by("class_idx", F.struct("score", -F.col("class_idx")))
    classes = (
        member_class_scores(spark, sf)
        .groupBy("model", "uid", "label", "y")
        .agg((pick + 1).cast("int").alias("y_hat"))
        .select("model", "uid", "label", F.lit("categorical").alias("kind"), "y", "y_hat")
    )
    return binary.unionByName(classes)


def vectors(spark: SparkSession, sf: str, offset: Column | int = 0) -> DataFrame:
    """``uid, logits (39), labels (23, zero-based)`` from the embeddings."""
    start = F.lit(offset) if isinstance(offset, int) else offset
    logits = F.transform(F.slice("embedding", start + 1, F.lit(39)), lambda v: v.cast("double") * 10.0)
    binary = F.transform(F.sequence(F.lit(1), F.lit(21)), lambda s: F.when((F.col("label") + s) % 3 == 0, 1).otherwise(0))
    codes = F.array((F.col("label") % 6).cast("int"), (F.col("label") % 12).cast("int"))
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("uid"), logits.alias("logits"), F.concat(binary, codes).alias("labels")
    )


def member_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """``model, uid, logits`` where each member reads the embedding at another offset."""
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("uid"), "embedding", models())
    logits = F.transform(F.slice("embedding", F.col("model") * 5 + 1, F.lit(39)), lambda v: v.cast("double") * 10.0)
    return emb.select("model", "uid", logits.alias("logits"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``uid, x (21), y (21)``."""
    return vectors(spark, sf).select("uid", F.slice("logits", 1, 21).alias("x"), F.slice("labels", 1, 21).alias("y"))


def evals(spark: SparkSession, sf: str) -> DataFrame:
    """``run, label, step, thresh, f1`` with many equal scores."""
    return table(spark, sf, "events").select(*eval_columns())


def eval_columns() -> list[Column]:
    return [
        (F.col("user_id") % 3).cast("int").alias("run"),
        F.col("event_type").alias("label"),
        F.col("event_id").alias("step"),
        ((F.col("event_id") % 101) * F.lit(0.01)).alias("thresh"),
        ((F.round(F.col("value") * 100).cast("bigint") % 101) / 100).alias("f1"),
    ]


def coded(spark: SparkSession, sf: str) -> DataFrame:
    """All 23 labels for every document, each from two hex digits of one digest."""
    keyed = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("uid"))
    hashed = keyed.withColumn("_h", F.md5(F.concat(F.lit("coded:"), F.col("uid"))))

    def digits(i: int) -> Column:
        return F.conv(F.substring("_h", i + 1, 2), 16, 10).cast("int")

    n_bin = len(CODING_SPEC.binary)
    return hashed.select(
        "uid",
        *[(digits(i) % 4 == 0).cast("int").alias(c) for i, c in enumerate(CODING_SPEC.binary)],
        *[(digits(n_bin + i) % n + 1).cast("int").alias(c) for i, (c, n) in enumerate(CODING_SPEC.categorical.items())],
    )


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """``uid, response``: written from the codes in several manners (short, padded, other
    wording, unknown texts, none at all), plus dialogue turns as junk."""
    decoded = decode_labels(coded(spark, sf)).withColumn("v", hex_word(F.concat(F.lit("v:"), F.col("uid"))) % 10)
    v = F.col("v")
    lines = []
    for c in CODING_SPEC.columns:
        text = F.col(c)
        if c == WEAPON:
            text = F.when(v == 2, "GSW to the head").when(v == 3, "Laser").otherwise(text)
        elif c != LOCATION:
            text = F.when((v == 2) & (text == "no"), "Not specified").otherwise(text)
        lines.append(F.when(v == 1, F.concat(F.lit("Q:\t"), F.upper(text), F.lit("  "))).otherwise(F.concat(F.lit("Q: "), text)))
    kept = F.when(v == 0, F.slice(F.array(*lines), 1, 10)).otherwise(F.array(*lines))
    text = F.when(v != 9, F.array_join(kept, "\n"))
    turns = table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    junk = turns.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("uid"),
        F.col("text").alias("response"),
    )
    return decoded.select("uid", text.alias("response")).unionByName(junk)


# ------------------------------------------------------------------------- SQL


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hex8(key: str) -> str:
    return f"CAST(CAST('0x' || substr(md5({key}), 1, 8) AS UBIGINT) AS BIGINT)"


def uniform(key: str) -> str:
    return f"(CAST({hex8(key)} AS DOUBLE) / CAST(4294967296 AS DOUBLE))"


def dbl(number: float | str) -> str:
    return f"CAST({number} AS DOUBLE)"


def _case(label: str, names: dict[int, str]) -> str:
    whens = " ".join(f"WHEN {k} THEN {quote(n)}" for k, n in names.items())
    return f"CASE {label} {whens} END"


def _response_sql() -> str:
    lines = []
    for c in CODING_SPEC.columns:
        if c == WEAPON:
            text = f"CASE v WHEN 2 THEN 'GSW to the head' WHEN 3 THEN 'Laser' ELSE {_case(c, WEAPON_NAMES)} END"
        elif c == LOCATION:
            text = _case(c, LOCATION_NAMES)
        else:
            text = f"CASE WHEN {c} = 1 THEN 'yes' WHEN v = 2 THEN 'Not specified' ELSE 'no' END"
        lines.append(f"CASE WHEN v = 1 THEN 'Q:' || chr(9) || upper({text}) || '  ' ELSE 'Q: ' || {text} END")
    full = " || chr(10) || ".join(lines)
    short = " || chr(10) || ".join(lines[:10])
    return (
        f"SELECT uid, CASE WHEN v = 9 THEN NULL WHEN v = 0 THEN {short} ELSE {full} END AS response "
        f"FROM (SELECT *, {hex8(chr(39) + 'v:' + chr(39) + ' || uid')} % 10 AS v FROM coded) "
        "UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations WHERE role = 'assistant'"
    )


_unpivot = " UNION ALL ".join(
    f"SELECT uid, '{c}' AS label, '{'binary' if c in DOC_SPEC.binary else 'categorical'}' AS kind, {c} AS y FROM labels_wide"
    for c in DOC_SPEC.columns
)


def _digits(i: int) -> str:
    return f"CAST(CAST('0x' || substr(h, {i + 1}, 2) AS UBIGINT) AS INT)"


_binary_codes = ", ".join(f"CAST({_digits(i)} % 4 = 0 AS INT) AS {c}" for i, c in enumerate(CODING_SPEC.binary))
_cat_codes = ", ".join(
    f"{_digits(len(CODING_SPEC.binary) + i)} % {n} + 1 AS {c}" for i, (c, n) in enumerate(CODING_SPEC.categorical.items())
)
_score_key = "'m' || model || ':' || label || ':' || uid"
_class_key = "'c' || model || ':' || label || ':' || class_idx || ':' || uid"

# name -> (names it reads, definition)
SQL: dict[str, tuple[list[str], str]] = {
    "docs": ([], "SELECT CAST(doc_id AS VARCHAR) AS uid, text FROM documents"),
    "records": (
        [],
        "SELECT CAST(doc_id AS VARCHAR) AS uid, substring(text, 1, n_chars // 2) AS narrative_le, "
        "substring(text, n_chars // 2 + 1) AS narrative_cme FROM documents",
    ),
    "labels_wide": (
        [],
        "SELECT CAST(l.doc_id AS VARCHAR) AS uid, l.quality, l.toxic, "
        "CASE d.lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 WHEN 'fr' THEN 4 END AS lang_code, "
        "CAST(substr(d.source, 4) AS INT) % 12 + 1 AS source_code "
        "FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
    ),
    "labels_long": (["labels_wide"], _unpivot),
    "models": ([], f"SELECT CAST(range AS INT) AS model FROM range({N_MODELS})"),
    "member_scores": (
        ["labels_long", "models"],
        f"SELECT model, uid, label, y, {uniform(_score_key)} * {dbl(0.6)} + y * {dbl(0.4)} AS score "
        "FROM labels_long, models WHERE kind = 'binary'",
    ),
    "member_class_scores": (
        ["labels_long", "models"],
        f"SELECT model, uid, label, class_idx, {uniform(_class_key)} + "
        f"CASE WHEN class_idx = y - 1 THEN {dbl(0.4)} ELSE {dbl(0.0)} END AS score, y FROM "
        "(SELECT uid, label, y, CAST(unnest(range(CASE label WHEN 'lang_code' THEN 4 ELSE 12 END)) AS INT) AS class_idx "
        "FROM labels_long WHERE kind = 'categorical'), models",
    ),
    "literal_thresholds": (
        ["member_scores"],
        f"SELECT DISTINCT model, label, {dbl(0.3)} + {dbl(0.05)} * model AS thresh FROM member_scores",
    ),
    "class_pick": (
        ["member_class_scores"],
        "SELECT model, uid, label, y, class_idx FROM (SELECT *, row_number() OVER "
        "(PARTITION BY model, uid, label ORDER BY score DESC, class_idx) AS rn FROM member_class_scores) WHERE rn = 1",
    ),
    "member_preds": (
        ["member_scores", "class_pick"],
        "SELECT model, uid, label, 'binary' AS kind, y, CAST(score > 0.5 AS INT) AS y_hat FROM member_scores "
        "UNION ALL SELECT model, uid, label, 'categorical', y, class_idx + 1 FROM class_pick",
    ),
    # long form of the embedding logits: slots from 1
    "slots": (
        [],
        "SELECT CAST(vec_id AS VARCHAR) AS uid, label AS code, CAST(s AS INT) AS slot, "
        "CAST(embedding[s] AS DOUBLE) * 10 AS x, CAST((label + s) % 3 = 0 AS INT) AS y "
        "FROM embeddings, range(1, 40) r(s)",
    ),
    "pairs": (["slots"], "SELECT uid, slot, x, y FROM slots WHERE slot <= 21"),
    "member_slots": (
        ["models"],
        "SELECT model, CAST(vec_id AS VARCHAR) AS uid, label AS code, CAST(s AS INT) AS slot, "
        "CAST(embedding[model * 5 + s] AS DOUBLE) * 10 AS x FROM embeddings, models, range(1, 40) r(s)",
    ),
    "evals": (
        [],
        "SELECT CAST(user_id % 3 AS INT) AS run, event_type AS label, event_id AS step, "
        f"(event_id % 101) * {dbl(0.01)} AS thresh, "
        f"CAST(CAST(round(value * 100) AS BIGINT) % 101 AS DOUBLE) / 100 AS f1 FROM events",
    ),
    "coded": ([], f"SELECT uid, {_binary_codes}, {_cat_codes} FROM (SELECT CAST(doc_id AS VARCHAR) AS uid, md5('coded:' || doc_id) AS h FROM documents)"),
    "responses": (["coded"], _response_sql()),
}


def with_tables(query: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a query with the definitions it needs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in SQL[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({SQL[n][1]})" for n in ordered]
    parts += [f"{n} AS ({body})" for n, body in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {query}" if parts else query
