"""Ranks, folds, batches and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from narracode.catalog import tables as t
from narracode.catalog.registry import query
from narracode.catalog.sources import STRATIFIED_SQL, VOCAB_SQL
from narracode.functions.numeric import hex_word
from narracode.functions.text import record_length
from narracode.operators import ordering as O
from narracode.operators.answers import first_examples
from narracode.operators.features import term_totals, top_terms, word_terms
from narracode.operators.folds import batch_ids, global_rank, hash_key, kfold, stratified_kfold
from narracode.session import write_table


@query(
    "global_rank",
    "SELECT CAST(event_id AS VARCHAR) AS uid, CAST(row_number() OVER (ORDER BY event_type, md5('3|' || event_id)) - 1 AS BIGINT) AS rank, "
    "count(*) OVER () AS n FROM events",
)
def global_rank_query(spark, sf):
    events = t.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("uid"), "event_type")
    return global_rank(events, hash_key(3, "uid"), coarse=F.col("event_type")).select("uid", "rank", "n")


@query("kfold", "SELECT CAST(doc_id AS VARCHAR) AS uid, CAST(ntile(7) OVER (ORDER BY md5('42|' || doc_id)) - 1 AS INT) AS fold FROM documents")
def kfold_query(spark, sf):
    return kfold(t.docs(spark, sf).select("uid"), 7, 42)


@query("stratified_kfold", t.with_tables("SELECT uid, label, y, fold FROM folds", "labels_long", extra={"folds": STRATIFIED_SQL}))
def stratified_kfold_query(spark, sf):
    return stratified_kfold(t.labels_long(spark, sf), 4, 11).select("uid", "label", "y", "fold")


@query(
    "batch_ids",
    t.with_tables(
        "SELECT uid, CAST(ntile((SELECT greatest(count(*) // 16, 1) FROM records)) OVER "
        "(ORDER BY length(narrative_le) + length(narrative_cme) DESC, md5('|' || uid)) - 1 AS BIGINT) AS batch FROM records",
        "records",
    ),
)
def batch_ids_query(spark, sf):
    lengths = t.records(spark, sf).select("uid", record_length(F.col("narrative_le"), F.col("narrative_cme")).alias("len"))
    return batch_ids(lengths, 16, F.col("len")).select("uid", "batch")


@query(
    "order_by_length",
    t.with_tables("SELECT uid, length(narrative_le) + length(narrative_cme) AS str_len FROM records ORDER BY str_len DESC, uid", "records"),
)
def order_by_length(spark, sf):
    ordered = O.order_by_length(t.records(spark, sf))
    return ordered.select("uid", F.col("str_len").cast("bigint").alias("str_len"))


@query("order_by_text", t.with_tables("SELECT uid, md5(text) AS text_md5 FROM docs ORDER BY text DESC, uid", "docs"))
def order_by_text(spark, sf):
    return O.order_by_text(t.docs(spark, sf)).select("uid", F.md5("text").alias("text_md5"))


@query("first_examples", "SELECT CAST(doc_id AS VARCHAR) AS uid, md5(text) AS text_md5 FROM documents ORDER BY doc_id LIMIT 3")
def first_examples_query(spark, sf):
    pos = t.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("uid"), "text", F.col("doc_id").alias("pos"))
    return first_examples(pos, "pos", 3).select("uid", F.md5("text").alias("text_md5"))


@query(
    "top_terms",
    t.with_tables("SELECT term, df, tf FROM totals ORDER BY tf DESC, term LIMIT 300", "docs", extra={k: VOCAB_SQL[k] for k in ("terms", "totals")}),
)
def top_terms_query(spark, sf):
    totals = write_table(term_totals(word_terms(t.docs(spark, sf), 1, 1)), "term_totals")
    return top_terms(totals, 300)


@query(
    "layout_by_length",
    t.with_tables(
        f"SELECT count(*) AS n, max(length(narrative_le) + length(narrative_cme)) AS longest, CAST(sum({t.hex8('uid')}) AS BIGINT) AS keys FROM records",
        "records",
    ),
)
def layout_by_length(spark, sf):
    """The layout in front of the batched hooks keeps every record."""
    laid_out = O.layout_by_length(O.with_length(t.records(spark, sf)))
    return laid_out.agg(
        F.count(F.lit(1)).alias("n"),
        F.max("str_len").cast("bigint").alias("longest"),
        F.sum(hex_word(F.col("uid"))).alias("keys"),
    )
