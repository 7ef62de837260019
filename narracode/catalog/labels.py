"""Projections, predicates, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from narracode.catalog import tables as t
from narracode.catalog.registry import query
from narracode.catalog.sources import EXTERNAL_SQL, FOLDS_SQL, external_wide
from narracode.functions.numeric import array_sum
from narracode.functions.text import repair_sentence_gaps as repair
from narracode.operators import labels as L
from narracode.operators.answers import merge_vocab
from narracode.operators.corpus import stack_texts
from narracode.operators.features import fit_corpus
from narracode.operators.folds import kfold
from narracode.spec import CODING_SPEC, LOCATION_NAMES, WEAPON_NAMES, WEAPON_CODES, slot_names

REPAIR = r"regexp_replace({}, '\.([a-zA-Z])', '. \1', 'g')"


@query("corpus", t.with_tables("SELECT uid, md5(narrative_le || ' ' || narrative_cme) AS text_md5 FROM records", "records"))
def corpus(spark, sf):
    return L.corpus(t.records(spark, sf), repair=False).select("uid", F.md5("text").alias("text_md5"))


@query("repair_sentence_gaps", t.with_tables(f"SELECT uid, {REPAIR.format('text')} AS text FROM docs", "docs"))
def repair_sentence_gaps(spark, sf):
    return t.docs(spark, sf).select("uid", repair(F.col("text")).alias("text"))


@query(
    "rebase_codes",
    t.with_tables("SELECT uid, lang_code - 1 AS lang_code, source_code - 1 AS source_code FROM labels_wide", "labels_wide"),
)
def rebase_codes(spark, sf):
    cats = list(t.DOC_SPEC.categorical)
    return L.rebase_codes(t.labels_wide(spark, sf), cats, -1).select("uid", *cats)


@query(
    "pack_labels",
    t.with_tables(
        "SELECT uid, quality || ',' || toxic || ',' || lang_code || ',' || source_code AS labels FROM labels_wide", "labels_wide"
    ),
)
def pack_labels(spark, sf):
    packed = L.pack_labels(t.labels_wide(spark, sf), t.DOC_SPEC.columns)
    return packed.select("uid", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


_slot_rows = " UNION ALL ".join(
    [f"SELECT {i} AS idx, '{c}' AS name, '{c}' AS label, 1 AS code FROM (SELECT 1)" for i, c in enumerate(CODING_SPEC.binary)]
    + [
        f"SELECT {start + k} AS idx, '{label}_{str(k).zfill(len(str(n - 1)))}' AS name, '{label}' AS label, {k + 1} AS code FROM (SELECT 1)"
        for label, kind, start, n in CODING_SPEC.slot_ranges()
        if kind == "categorical"
        for k in range(n)
    ]
)
_coded_long = " UNION ALL ".join(f"SELECT '{c}' AS label, {c} AS code FROM coded" for c in CODING_SPEC.columns)


@query(
    "label_vocab",
    t.with_tables(
        "SELECT s.idx, s.name, count(c.code) AS n FROM slots39 s LEFT JOIN long c ON s.label = c.label AND s.code = c.code GROUP BY 1, 2",
        "coded",
        extra={"slots39": _slot_rows, "long": _coded_long},
    ),
)
def label_vocab(spark, sf):
    """The output slots, with the number of documents that carry each."""
    slots = slot_names(CODING_SPEC.frame(spark)).withColumn(
        "code", F.when(F.col("label").isin(CODING_SPEC.binary), 1).otherwise(F.col("class_idx") + 1)
    )
    used = L.to_long(t.coded(spark, sf), CODING_SPEC.columns, "code").groupBy("label", "code").count()
    joined = slots.join(used, ["label", "code"], "left")
    return joined.select("idx", "name", F.coalesce("count", F.lit(0)).cast("bigint").alias("n"))


@query("prune", t.with_tables("SELECT uid, toxic FROM labels_wide", "labels_wide"))
def prune(spark, sf):
    return L.prune(t.labels_wide(spark, sf), ["quality", "lang_code", "source_code"])


@query("project_template", t.with_tables("SELECT source_code, uid, toxic FROM labels_wide", "labels_wide"))
def project_template(spark, sf):
    return L.project_template(t.labels_wide(spark, sf), ["source_code", "uid", "toxic"])


@query("to_int", "SELECT event_id, CAST(round_even(value * 2, 0) AS INT) AS value FROM events")
def to_int(spark, sf):
    doubled = t.table(spark, sf, "events").select("event_id", (F.col("value") * 2).alias("value"))
    return L.to_int(doubled, ["value"])


@query(
    "fold_filter",
    t.with_tables(
        "SELECT CASE WHEN fold = 2 THEN 'dev' ELSE 'train' END AS split, fold, count(*) AS n, min(uid) AS first_uid "
        "FROM folds GROUP BY 1, 2",
        "records",
        extra={"folds": FOLDS_SQL},
    ),
)
def fold_filter(spark, sf):
    split = L.fold_split(kfold(t.records(spark, sf).select("uid"), 5, 7), 2)
    return split.groupBy("split", "fold").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("first_uid"))


@query(
    "binarize",
    t.with_tables("SELECT model, uid, label, CAST(score > 0.5 AS INT) AS y_hat FROM member_scores", "member_scores"),
)
def binarize(spark, sf):
    return t.member_scores(spark, sf).select(
        "model", "uid", "label", L.binarize(F.col("score"), F.lit(0.5)).alias("y_hat")
    )


@query(
    "split_scores",
    t.with_tables(
        "SELECT uid, round(sum(CASE WHEN slot <= 21 THEN x END), 5) + 0 AS bin, "
        "round(sum(CASE WHEN slot BETWEEN 22 AND 27 THEN x END), 5) + 0 AS location, "
        "round(sum(CASE WHEN slot >= 28 THEN x END), 5) + 0 AS weapon FROM slots GROUP BY uid",
        "slots",
    ),
)
def split_scores(spark, sf):
    cut = L.split_scores(t.vectors(spark, sf), CODING_SPEC, "logits")
    sums = {"bin": "bin", "location": t.LOCATION, "weapon": t.WEAPON}
    return cut.select("uid", *[(F.round(array_sum(F.col(c)), 5) + 0).alias(n) for n, c in sums.items()])


@query("to_long", t.with_tables("SELECT uid, label, y FROM labels_long", "labels_long"))
def to_long(spark, sf):
    return L.to_long(t.labels_wide(spark, sf), t.DOC_SPEC.columns)


@query(
    "validate",
    t.with_tables(
        "SELECT 'n_columns' AS \"check\", true AS ok UNION ALL SELECT 'same_columns', true UNION ALL SELECT 'integer_columns', true "
        "UNION ALL SELECT 'same_keys', (SELECT count(*) FROM coded WHERE uid NOT IN (SELECT uid FROM labels_wide)) = 0 "
        "UNION ALL SELECT 'no_nulls', true UNION ALL SELECT 'codes_in_range', true",
        "coded",
        "labels_wide",
    ),
)
def validate(spark, sf):
    """Codes of all documents against the labels of the labelled ones: the key check fails."""
    labels = t.labels_wide(spark, sf)
    preds = t.coded(spark, sf).select(
        "uid",
        *[F.col(a).alias(b) for a, b in zip(["Argument", "SuicideNote"], t.DOC_SPEC.binary, strict=True)],
        (F.col(t.LOCATION) % 4 + 1).alias("lang_code"),
        F.col(t.WEAPON).alias("source_code"),
    )
    return L.validate(preds, labels, t.DOC_SPEC)


@query(
    "validate_labels",
    t.with_tables(
        "SELECT 'unique_keys' AS \"check\", count(uid) = count(DISTINCT uid) AS ok FROM labels_wide UNION ALL "
        "SELECT 'classes_lang_code', count(DISTINCT lang_code) = 4 FROM labels_wide UNION ALL "
        "SELECT 'classes_source_code', count(DISTINCT source_code) = 12 FROM labels_wide",
        "labels_wide",
    ),
)
def validate_labels(spark, sf):
    return L.validate_labels(t.labels_wide(spark, sf), t.DOC_SPEC)


# ------------------------------------------------------------------------ joins


@query(
    "with_labels",
    t.with_tables(
        "SELECT COALESCE(r.uid, l.uid) AS uid, length(r.narrative_le) AS n_le, COALESCE(l.quality, -1) AS quality, COALESCE(l.toxic, -1) AS toxic "
        "FROM records r FULL JOIN labels_wide l ON r.uid = l.uid",
        "records",
        "labels_wide",
    ),
)
def with_labels(spark, sf):
    joined = L.with_labels(t.records(spark, sf), t.labels_wide(spark, sf))
    return joined.select("uid", F.length("narrative_le").cast("bigint").alias("n_le"), *[F.coalesce(c, F.lit(-1)).alias(c) for c in t.DOC_SPEC.binary])


@query("semi", t.with_tables("SELECT uid, length(text) AS n FROM docs WHERE uid IN (SELECT uid FROM labels_wide)", "docs", "labels_wide"))
def semi(spark, sf):
    kept = L.semi(t.docs(spark, sf), t.labels_wide(spark, sf).select("uid"))
    return kept.select("uid", F.length("text").cast("bigint").alias("n"))


@query(
    "exclude_seen",
    t.with_tables("SELECT uid, length(text) AS n FROM docs WHERE uid NOT IN (SELECT uid FROM labels_wide)", "docs", "labels_wide"),
)
def exclude_seen(spark, sf):
    kept = L.exclude_seen(t.docs(spark, sf), t.labels_wide(spark, sf).select("uid"))
    return kept.select("uid", F.length("text").cast("bigint").alias("n"))


@query(
    "align",
    t.with_tables(
        "SELECT o.uid, o.pos, round(e.quality, 6) AS quality, round(e.toxic, 6) AS toxic "
        "FROM (SELECT CAST(doc_id AS VARCHAR) AS uid, doc_id AS pos FROM documents) o LEFT JOIN ext e ON o.uid = e.uid",
        "member_scores",
        extra={"ext": EXTERNAL_SQL},
    ),
)
def align(spark, sf):
    order = t.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("uid"), F.col("doc_id").alias("pos"))
    aligned = L.align(external_wide(spark, sf), order)
    return aligned.select("uid", "pos", F.round("quality", 6).alias("quality"), F.round("toxic", 6).alias("toxic"))


@query(
    "assign",
    t.with_tables(
        "SELECT c.uid, COALESCE(w.quality, c.Argument) AS Argument, COALESCE(w.source_code, c.WeaponType1) AS WeaponType1, c.SuicideNote "
        "FROM coded c LEFT JOIN labels_wide w ON c.uid = w.uid",
        "coded",
        "labels_wide",
    ),
)
def assign(spark, sf):
    template = t.coded(spark, sf).select("uid", "Argument", "WeaponType1", "SuicideNote")
    preds = t.labels_wide(spark, sf).select("uid", F.col("quality").alias("Argument"), F.col("source_code").alias("WeaponType1"))
    return L.assign(template, preds, ["Argument", "WeaponType1"])


def codes_sql(codes: dict[str, int]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({t.quote(k)}, {v})" for k, v in codes.items()) + ") v(raw, code)"


@query(
    "encode_lookup",
    t.with_tables(
        "SELECT t.uid, COALESCE(v.code, 11) AS code FROM raw t LEFT JOIN vocab v ON lower(t.txt) = v.raw",
        "coded",
        extra={
            "raw": f"SELECT uid, CASE WHEN SuicideNote = 1 THEN upper({t._case('WeaponType1', WEAPON_NAMES)}) ELSE 'something else' END AS txt FROM coded",
            "vocab": codes_sql(WEAPON_CODES),
        },
    ),
)
def encode_lookup(spark, sf):
    named = L.decode_lookup(t.coded(spark, sf), "WeaponType1", WEAPON_NAMES, "name")
    raw = named.select("uid", F.when(F.col("SuicideNote") == 1, F.upper("name")).otherwise("something else").alias("txt"))
    return L.encode_lookup(raw, "txt", WEAPON_CODES, "code", 11).select("uid", "code")


@query(
    "decode_lookup",
    t.with_tables(f"SELECT uid, {t._case('InjuryLocationType', LOCATION_NAMES)} AS place FROM coded", "coded"),
)
def decode_lookup(spark, sf):
    return L.decode_lookup(t.coded(spark, sf), "InjuryLocationType", LOCATION_NAMES, "place").select("uid", "place")


@query(
    "attach_examples",
    t.with_tables("SELECT uid, (SELECT md5(min(text) || max(text)) FROM docs) AS block FROM docs", "docs"),
)
def attach_examples(spark, sf):
    docs = t.docs(spark, sf)
    block = docs.agg(F.md5(F.concat(F.min("text"), F.max("text"))).alias("block"))
    return L.attach_one(docs.select("uid"), block, "block")


@query(
    "scores_with_thresholds",
    t.with_tables(
        "SELECT s.model, s.uid, s.label, CAST(s.score > th.thresh AS INT) AS y_hat FROM member_scores s "
        "JOIN literal_thresholds th ON s.model = th.model AND s.label = th.label",
        "member_scores",
        "literal_thresholds",
    ),
)
def scores_with_thresholds(spark, sf):
    joined = L.scores_with_thresholds(t.member_scores(spark, sf), t.literal_thresholds(spark, sf), per_model=True)
    return joined.select("model", "uid", "label", L.binarize(F.col("score"), F.col("thresh")).alias("y_hat"))


# --------------------------------------------------------------- set operations


@query(
    "stack_texts",
    t.with_tables(
        "SELECT 0 AS part, uid, unnest(string_split(narrative_le, chr(10))) AS line FROM records "
        "UNION ALL SELECT 1, uid, unnest(string_split(narrative_cme, chr(10))) FROM records",
        "records",
    ),
)
def stack_texts_query(spark, sf):
    return stack_texts(t.records(spark, sf)).select("part", "uid", "line")


@query(
    "merge_vocab",
    "SELECT raw, max_by(code, pos) AS code FROM (SELECT regexp_extract(lower(text), '[\\p{L}\\p{N}_]+') AS raw, "
    "CAST(substr(source, 4) AS INT) AS code, doc_id AS pos FROM documents) GROUP BY raw",
)
def merge_vocab_query(spark, sf):
    """Each document maps its first word to its source; later documents win."""
    entries = t.table(spark, sf, "documents").select(
        F.regexp_extract(F.lower("text"), r"([\p{L}\p{N}_]+)", 1).alias("raw"),
        F.substring("source", 4, 10).cast("int").alias("code"),
        F.col("doc_id").alias("src_pos"),
    )
    return merge_vocab(entries)


@query(
    "fit_corpus",
    t.with_tables(
        "SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT text FROM docs UNION ALL "
        "SELECT narrative_le FROM records UNION ALL SELECT narrative_cme FROM records)",
        "docs",
        "records",
    ),
)
def fit_corpus_query(spark, sf):
    records = t.records(spark, sf)
    parts = [t.docs(spark, sf).select("text")] + [records.select(F.col(c).alias("text")) for c in ("narrative_le", "narrative_cme")]
    return fit_corpus(*parts).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
