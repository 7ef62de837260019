"""Named queries of the training-data operators over the given tables, with SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from narracode.llm import embeddings, language, lexical, lines, minhash, mixing, packing, personal, pieces, quality, sharding, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def byte_bpe() -> str:
    """The file of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query("op4_packing")
def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_table(spark, sf, "documents"), byte_bpe())


@_query("op10_sharding")
def op10_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.place(_table(spark, sf, "documents"))


@_query("op6_quality_rules", quality.ORACLE)
def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(_table(spark, sf, "documents"))


@_query("op9_line_dedup", lines.ORACLE)
def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.find_repeats(_table(spark, sf, "documents"))


@_query("op3_minhash")
def op3_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.find_duplicates(_table(spark, sf, "documents"))


@_query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


@_query("op7_language")
def op7_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(_table(spark, sf, "documents"))


@_query("op8_personal_data")
def op8_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return personal.find_personal(_table(spark, sf, "documents"))


@_query("op1_embedding_dedup")
def op1_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings.link_vectors(_table(spark, sf, "embeddings"))


def piece_bpe() -> str:
    """The file of the public piece vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@_query("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.encode(_table(spark, sf, "documents"), piece_bpe())


@_query("op11_lexical_search", lexical.ORACLE)
def op11_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


@_query("op12_mixing")
def op12_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_table(spark, sf, "documents"))


@_query("op13_whitening")
def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf, "embeddings"))
