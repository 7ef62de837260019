"""Every operator and stage over missing, empty, long, tied and repeated rows, and no rows."""

from __future__ import annotations

import pytest

import corpus_pipeline
from narracode.llm import embeddings, language, lines, minhash, packing, personal, pieces, quality, sharding, toxicity
from narracode.llm.queries import byte_bpe, piece_bpe
from tests.llm.conftest import SENTENCE

ROWS = 11


def labels(spark, rows=((4, 0, 1), (5, 1, 0), (8, 1, None), (None, 0, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


PER_ROW = {
    "toxicity": lambda s, d: toxicity.score_toxicity(d, labels(s)),
    "language": lambda s, d: language.identify(d),
    "personal": lambda s, d: personal.find_personal(d),
    "quality": lambda s, d: quality.judge(d),
    "sharding": lambda s, d: sharding.place(d),
    "minhash": lambda s, d: minhash.find_duplicates(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_answer_per_row(spark, odd_docs, no_docs, name):
    got = PER_ROW[name](spark, odd_docs)
    assert got.count() == ROWS
    assert PER_ROW[name](spark, no_docs).collect() == []


def test_quality_of_odd_rows(odd_docs):
    got = {(r.doc_id, r.n_words): r for r in quality.judge(odd_docs).collect()}
    assert got[1, 0].base_failed and not got[1, 0].kept
    assert got[3, 0].word_chars == 0
    # every window of a text repeated four times occurs again
    n = 4 * len(SENTENCE.split())
    assert got[4, n].n_repeat_words == n and got[4, n].base_failed


def test_minhash_of_odd_rows(odd_docs):
    got = minhash.find_duplicates(odd_docs).collect()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[1].kept and by_id[2].kept and by_id[3].kept
    assert by_id[6].class_id == 5 and not by_id[6].kept
    # the document without an id comes first in its class
    assert by_id[4].class_id is None and not by_id[4].kept


def test_personal_of_odd_rows(odd_docs):
    got = {r.doc_id: r for r in personal.find_personal(odd_docs).collect()}
    assert (got[8].n_email, got[8].n_ip, got[8].n_card, got[8].n_phone) == (1, 1, 1, 1)
    assert got[1].spans == "" and got[1].base_sha256.startswith("e3b0c442")


def test_language_of_odd_rows(odd_docs):
    got = {r.doc_id: r for r in language.identify(odd_docs).collect() if r.doc_id is not None}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert got[8].lang_pred in ("en", "de")


def test_packing_of_odd_rows(odd_docs, no_docs):
    got = packing.pack(odd_docs, byte_bpe()).toPandas()
    ends = got.offset + got.length
    assert (ends.groupby(got.sequence_id).max() == got.groupby("sequence_id").length.sum()).all()
    assert got[got.doc_id == 1].doc_tokens.tolist() == [1]
    # both copies of a repeated row are packed
    copies = got[got.doc_id == 4]
    assert copies.length.sum() == 2 * copies.doc_tokens.iloc[0]
    assert packing.pack(no_docs, byte_bpe()).collect() == []


def test_pieces_of_odd_rows(odd_docs, no_docs):
    got = pieces.encode(odd_docs, piece_bpe()).toPandas()
    assert got.round_trip[got.doc_id != 8].all()
    assert got[got.doc_id == 5].chunk.max() > 0
    assert got[got.doc_id == 1].n_ids.tolist() == [0]
    assert pieces.encode(no_docs, piece_bpe()).collect() == []


def test_lines_of_odd_rows(odd_docs, no_docs):
    got = lines.find_repeats(odd_docs).collect()
    assert {r.doc_id for r in got if r.kept} >= {5, 6, 7, 8}
    # the same line under two ids, one of them missing; the missing one comes first
    assert [r.class_doc_id for r in got if r.doc_id == 4] == [None, None]
    assert lines.find_repeats(no_docs).collect() == []


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, []), (7, [0.0, 0.0]),
        (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [None, 1.0]), (11, [1.0, 0.0, 0.0]), (3, [1.0, 0.0]), (None, [0.0, 3.0]),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS _c", "2 AS label")
    got = embeddings.link_vectors(vectors).collect()
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert len(got) == len(rows)
    assert by[1] == (3, 1, True) and by[2] == (3, 1, False) and by[3] == (3, 1, False)
    assert by[4] == (1, 4, True) and by[None] == (1, 4, False)
    assert all(by[i] == (0, i, True) for i in (5, 6, 7, 8, 9, 10, 11))
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.link_vectors(empty).collect() == []


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, odd_docs, no_docs, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, odd_docs, sf)
    if name != "packing":
        assert got.columns == odd_docs.columns
    rows = got.collect()
    # every host of the odd rows has mostly failures
    assert bool(rows) == (name != "quality_rules")
    assert stage(spark, no_docs, sf).collect() == []
    if name == "near_dedup":
        # one of the three copies, and one of the two long texts
        assert sum((r.text or "").startswith("the quick") for r in rows) == 1
        assert sum((r.text or "").startswith("alpha") for r in rows) == 1
    if name == "personal_data":
        assert [r.text for r in rows if r.doc_id == 8][0].endswith("[EMAIL] and [PHONE] or [IP] or [CARD]")
        assert [r.n_chars for r in rows if r.doc_id == 5] == [len(r.text) for r in rows if r.doc_id == 5]


def test_kept_documents_are_those_that_the_judge_keeps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("lang", "_host")
    kept = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    rows = quality.keep_good(docs)
    assert rows.columns == docs.columns and {r.doc_id for r in rows.collect()} == kept and kept


def test_write_shards(spark, odd_docs, tmp_path):
    sharding.write_shards(odd_docs, str(tmp_path / "out"), ["a", "b", "c"])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == ROWS and "_shard" in back.columns and "shard" in back.columns
