"""Scalar functions, one query per function, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from narracode.catalog import tables as t
from narracode.catalog.metrics import rounded
from narracode.catalog.registry import query
from narracode.functions import numeric as N
from narracode.functions import text as X


@query(
    "scalar_f01",
    t.with_tables(r"SELECT uid, md5(regexp_replace(text, '\.([a-zA-Z])', '. \1', 'g')) AS a, md5(regexp_replace(text, 'the[^\n]*', '', 'g')) AS b FROM docs", "docs"),
)
def scalar_f01(spark, sf):
    text = F.col("text")
    return t.docs(spark, sf).select(
        "uid", F.md5(X.repair_sentence_gaps(text)).alias("a"), F.md5(F.regexp_replace(text, r"the[^\n]*", "")).alias("b")
    )


@query("scalar_f02", t.with_tables("SELECT uid, md5(lower(text)) AS text FROM docs", "docs"))
def scalar_f02(spark, sf):
    return t.docs(spark, sf).select("uid", F.md5(F.lower("text")).alias("text"))


@query(
    "scalar_f03",
    t.with_tables(
        r"SELECT uid, md5(regexp_replace(p, '^\s+|\s+$', '', 'g')) AS both, md5(regexp_replace(p, '\s+$', '')) AS tail "
        "FROM (SELECT uid, chr(9) || ' ' || text || ' ' || chr(10) AS p FROM docs)",
        "docs",
    ),
)
def scalar_f03(spark, sf):
    padded = F.concat(F.lit("\t "), F.col("text"), F.lit(" \n"))
    return t.docs(spark, sf).select("uid", F.md5(X.strip(padded)).alias("both"), F.md5(X.rstrip(padded)).alias("tail"))


@query(
    "scalar_f04",
    t.with_tables(
        "SELECT uid, len(l) AS n, l[1] AS head FROM (SELECT uid, list_filter(regexp_split_to_array(text, "
        r"'\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'), lambda x: x <> '') AS l FROM "
        "(SELECT uid, replace(replace(text, ' der ', chr(28)), ' the ', chr(30)) AS text FROM docs))",
        "docs",
    ),
)
def scalar_f04(spark, sf):
    """Line ends of any kind, the separators of files and records among them."""
    text = F.replace(F.replace("text", F.lit(" der "), F.lit("\x1c")), F.lit(" the "), F.lit("\x1e"))
    lines = X.nonempty_lines(text)
    return t.docs(spark, sf).select("uid", F.size(lines).cast("bigint").alias("n"), F.get(lines, F.lit(0)).alias("head"))


@query("scalar_f05", "SELECT page_id, string_split(url, ':')[-1] AS last FROM pages")
def scalar_f05(spark, sf):
    return t.table(spark, sf, "pages").select("page_id", X.last_field(F.col("url")).alias("last"))


@query("scalar_f06", t.with_tables("SELECT uid, md5(substring(narrative_le || narrative_cme, length(narrative_le) + 1)) AS rest FROM records", "records"))
def scalar_f06(spark, sf):
    whole = F.concat("narrative_le", "narrative_cme")
    return t.records(spark, sf).select("uid", F.md5(X.after_prefix(whole, F.col("narrative_le"))).alias("rest"))


@query("scalar_f07", t.with_tables("SELECT uid, contains(lower(text), 'the') AS hit FROM docs", "docs"))
def scalar_f07(spark, sf):
    return t.docs(spark, sf).select("uid", X.contains_word(F.col("text"), "the").alias("hit"))


@query("scalar_f08", t.with_tables("SELECT uid, length(narrative_le) + length(narrative_cme) AS n FROM records", "records"))
def scalar_f08(spark, sf):
    length = X.record_length(F.col("narrative_le"), F.col("narrative_cme"))
    return t.records(spark, sf).select("uid", length.cast("bigint").alias("n"))


@query("scalar_f09", "SELECT conv_id, turn, md5('Q' || turn || '. ' || role || chr(10) || text) AS line FROM conversations")
def scalar_f09(spark, sf):
    head = F.format_string("Q%d. %s", F.col("turn"), F.col("role"))
    return t.table(spark, sf, "conversations").select("conv_id", "turn", F.md5(F.concat_ws("\n", head, "text")).alias("line"))


@query("scalar_f10", "SELECT event_id, 'eval_zthresh_' || lpad(CAST(event_id % 23 AS VARCHAR), 2, '0') AS key FROM events")
def scalar_f10(spark, sf):
    key = X.numbered_key("eval_zthresh_", (F.col("event_id") % 23).cast("int"))
    return t.table(spark, sf, "events").select("event_id", key.alias("key"))


@query("scalar_f11", t.with_tables("SELECT uid, slot, round(1 / (1 + exp(-x)), 6) AS p FROM pairs", "pairs"))
def scalar_f11(spark, sf):
    rows = t.pairs(spark, sf).select("uid", F.posexplode("x").alias("slot", "x"))
    return rounded(rows.select("uid", (F.col("slot") + 1).alias("slot"), N.sigmoid(F.col("x")).alias("p")), "p")


@query(
    "scalar_f12",
    t.with_tables(
        "SELECT uid, slot - 28 AS class, round(exp(x) / sum(exp(x)) OVER (PARTITION BY uid), 6) AS p FROM slots WHERE slot >= 28", "slots"
    ),
)
def scalar_f12(spark, sf):
    rows = t.vectors(spark, sf).select("uid", F.posexplode(N.softmax(F.slice("logits", 28, 12))).alias("class", "p"))
    return rounded(rows, "p")


@query(
    "scalar_f13",
    t.with_tables(
        "SELECT uid, slot, round(greatest(x, 0), 6) + 0 AS relu, round(abs(x), 6) AS abs, round(exp(-abs(x)), 6) AS exp, "
        "round(ln(1 + abs(x)), 6) AS log, round(pow(x, 2), 6) AS pow FROM pairs",
        "pairs",
    ),
)
def scalar_f13(spark, sf):
    rows = t.pairs(spark, sf).select("uid", F.posexplode("x").alias("slot", "x"))
    x = F.col("x")
    out = rows.select(
        "uid",
        (F.col("slot") + 1).alias("slot"),
        N.relu(x).alias("relu"),
        F.abs(x).alias("abs"),
        F.exp(-F.abs(x)).alias("exp"),
        F.log1p(F.abs(x)).alias("log"),
        F.pow(x, F.lit(2.0)).alias("pow"),
    )
    return rounded(out, "relu", "abs", "exp", "log", "pow")


@query(
    "scalar_f14",
    t.with_tables(
        "SELECT uid, quality || '-' || lang_code || '-' || source_code AS cut, source_code AS picked FROM labels_wide", "labels_wide"
    ),
)
def scalar_f14(spark, sf):
    """Concatenate two arrays, cut a range, zip names with values and look one up."""
    packed = F.concat(F.array("quality", "toxic"), F.array("lang_code", "source_code"))
    names = F.array(*[F.lit(c) for c in t.DOC_SPEC.columns])
    cut = F.concat(F.slice(packed, 1, 1), N.cut(packed, 2, 2)).cast("array<string>")
    picked = F.try_element_at(F.map_from_arrays(names, packed), F.lit("source_code"))
    return t.labels_wide(spark, sf).select("uid", F.array_join(cut, "-").alias("cut"), picked.alias("picked"))


@query("scalar_f15", "SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN 2 ELSE 9 END AS code FROM events")
def scalar_f15(spark, sf):
    known = F.create_map(F.lit("view"), F.lit(1), F.lit("error"), F.lit(2))
    return t.table(spark, sf, "events").select("event_id", N.map_get(known, F.col("event_type"), F.lit(9)).alias("code"))


@query("scalar_f16", "SELECT event_id, COALESCE(CASE WHEN value > 50 THEN value END, 0) AS value FROM events")
def scalar_f16(spark, sf):
    value = F.when(F.col("value") > 50, F.col("value"))
    return t.table(spark, sf, "events").select("event_id", F.coalesce(value, F.lit(0.0)).alias("value"))


@query("scalar_f17", f"SELECT event_id, round_even(event_id * {t.dbl(0.5)}, 0) AS value FROM events")
def scalar_f17(spark, sf):
    return t.table(spark, sf, "events").select("event_id", N.half_even(F.col("event_id") * F.lit(0.5)).alias("value"))
