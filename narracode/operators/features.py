"""Word and character n-gram features.

A record's n-grams are many times larger than its text, so the text is moved by record key and
counted on that partitioning. Each kind of n-gram moves it once to fit a vocabulary and once to
apply it; term totals are shuffled by term, after map-side sums.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from narracode.functions.text import word_tokens
from narracode.operators import grams as G
from narracode.session import scratch_path, write_table


#: Candidate terms that are broadcast at most; they are counted before.
BROADCAST_TERMS = 2_000_000
#: Bytes of the texts whose word or character n-grams a task counts, about.
WORD_BYTES, CHAR_BYTES = 4 << 20, 2 << 20
#: Bytes of the texts whose n-grams a task adds up or weighs by numbers, about.
TOTAL_BYTES = 4 << 20


def english_stop_words() -> list[str]:
    """Spark's own English list."""
    return StopWordsRemover.loadDefaultStopWords("english")


def text_parts(docs: DataFrame, task_bytes: int) -> int:
    """Parts of about ``task_bytes`` of text, at least as many as the session's partitions."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // task_bytes))


def by_record(docs: DataFrame, keys: tuple[str, ...] = ("uid",), task_bytes: int = CHAR_BYTES) -> DataFrame:
    """The texts, hash-partitioned by record, or by bucket of records where ``keys`` has ``_b``.

    Their n-grams are a hundred times larger and are counted where the text stands, so a task's
    memory follows the bytes of its texts: a partition gets about ``task_bytes``, and their number
    grows with the corpus. It is at least that of the session."""
    parts = text_parts(docs, task_bytes)
    bucket = F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int")
    return docs.select("uid", "text", bucket.alias("_b")).repartition(parts, "_b" if "_b" in keys else "uid")


def word_occurrences(
    docs: DataFrame, low: int = 1, high: int = 3, stop_words: list[str] | None = None, keys: tuple[str, ...] = ("uid",), task_bytes: int = WORD_BYTES
) -> DataFrame:
    """The rows that ``word_terms`` adds up: every occurrence, with ``tf`` one."""
    listed = by_record(docs, keys, task_bytes).select(*keys, kept_words(F.col("text"), stop_words).alias("_t"))
    # no filter on empty lists: it would move below the exchange and tokenise twice
    starts = F.when(F.size("_t") > 0, F.sequence(F.lit(0), F.size("_t") - 1))
    at = listed.select(*keys, "_t", F.explode(starts).alias("_i"))
    runs = [
        F.when(F.col("_i") + n <= F.size("_t"), F.concat_ws(" ", *[F.get("_t", F.col("_i") + k) for k in range(n)]))
        for n in range(low, high + 1)
    ]
    terms = at.select(*keys, F.explode(F.array(*runs)).alias("term")).filter(F.col("term").isNotNull())
    return terms.withColumn("tf", F.lit(1).cast("bigint"))


def word_terms(
    docs: DataFrame, low: int = 1, high: int = 3, stop_words: list[str] | None = None, keys: tuple[str, ...] = ("uid",)
) -> DataFrame:
    """``uid, term, tf`` of word n-grams: runs of ``low`` to ``high`` neighbouring tokens
    joined by a blank. Stop words leave before the runs are formed. ``keys`` may add the bucket of
    records ``_b``."""
    return word_occurrences(docs, low, high, stop_words, keys).groupBy(*keys, "term").agg(F.sum("tf").alias("tf"))


def char_occurrences(docs: DataFrame, low: int = 3, high: int = 6, keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """The rows that ``char_terms`` adds up: the n-grams of each different word of a record, with
    the count of the word. The expansion is two generators and a substring, which stay in generated
    code."""
    words = by_record(docs, keys).select(*keys, F.explode(F.split(F.lower("text"), r"(?U)\s+")).alias("word"))
    counted = words.filter(F.col("word") != "").groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("tf"))
    size = F.length("word") + 2
    lengths = F.sequence(F.lit(low), F.greatest(F.lit(low), F.least(F.lit(high), size)))
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    per_length = counted.select(*keys, "tf", padded.alias("_p"), size.alias("_s"), F.explode(lengths).alias("_k"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("_s") - F.col("_k") + 1))
    per_start = per_length.select(*keys, "tf", "_p", "_k", F.explode(starts).alias("_i"))
    return per_start.select(*keys, F.substring("_p", F.col("_i"), F.col("_k")).alias("term"), "tf")


def char_terms(docs: DataFrame, low: int = 3, high: int = 6, keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """``uid, term, tf`` of character n-grams inside blank-padded words; a padded word no
    longer than n is taken once as it is. Words are counted before they are expanded."""
    return char_occurrences(docs, low, high, keys).groupBy(*keys, "term").agg(F.sum("tf").alias("tf"))


def char_words(text: Column) -> Column:
    """The words of ``char_terms``: lower-cased, cut at white space."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")


def dealt_tokens(docs: DataFrame, task_bytes: int, **lists: Column) -> DataFrame:
    """``uid`` and lists of tokens, dealt and sorted by record."""
    dealt = by_record(docs, task_bytes=task_bytes).sortWithinPartitions("uid")
    return dealt.select("uid", *[c.alias(name) for name, c in lists.items()])


def kept_words(text: Column, stop_words: list[str] | None = None) -> Column:
    """The tokens of ``word_terms``."""
    tokens = word_tokens(text)
    return F.filter(tokens, lambda w: ~w.isin(stop_words)) if stop_words else tokens


def word_totals(docs: DataFrame, low: int = 1, high: int = 3, stop_words: list[str] | None = None, cells=None) -> DataFrame:
    """``term, df, tf`` of the rows of ``word_terms``, added up where the texts stand; of all terms, or of
    those in marked cells."""
    return G.word_totals(_word_lists(docs, stop_words), low, high, text_parts(docs, TOTAL_BYTES), cells)


def _word_lists(docs: DataFrame, stop_words: list[str] | None) -> DataFrame:
    return dealt_tokens(docs, TOTAL_BYTES, tokens=kept_words(F.col("text"), stop_words))


def fit_word_vocab(
    docs: DataFrame, n_records: int, low: int, high: int, stop_words: list[str] | None, min_df: int, max_df: float, max_features: int | None
) -> DataFrame:
    """``fit_vocab`` of word n-grams. A cell's occurrences are a bound for each of its terms, so terms of
    cells below a count are not among those that reach it. If enough terms in the limits reach a count,
    they are the vocabulary, and the rest never left their task; if not, more cells are taken, then all."""
    limits = n_records, min_df, max_df, max_features
    if max_features is not None:
        cells = G.word_cells(_word_lists(docs, stop_words), low, high)
        ranked = np.sort(cells)[::-1]
        for share in (3, 9):
            place = share * max_features
            if place >= len(cells) // 4 or ranked[place] <= 1:
                break
            reached = ranked[place] + 1
            totals = write_table(within(word_totals(docs, low, high, stop_words, cells >= reached), *limits[:3]), "term_totals")
            if totals.filter(F.col("tf") >= int(reached)).count() >= max_features:
                return fit_vocab(totals, *limits)
    return fit_vocab(word_totals(docs, low, high, stop_words), *limits)


def within(totals: DataFrame, n_records: int, min_df: int, max_df: float) -> DataFrame:
    """The terms within the limits of document frequency."""
    return totals.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.lit(n_records)))


def char_totals(docs: DataFrame, low: int = 3, high: int = 6) -> DataFrame:
    """``term, df, tf`` of the rows of ``char_terms``, added up where the texts stand."""
    parts = text_parts(docs, TOTAL_BYTES)
    return G.char_totals(dealt_tokens(docs, TOTAL_BYTES, words=char_words(F.col("text"))), low, high, parts)


def term_totals(terms: DataFrame) -> DataFrame:
    """``term, df, tf``: records with the term and its total count."""
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def top_terms(totals: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent terms, ties in term order.

    The count that the k-th term has is read off the table of distinct counts first; the
    sorted limit then sees only terms that reach it.
    """
    by_count = totals.groupBy("tf").agg(F.count(F.lit(1)).alias("_terms"))
    above = Window.orderBy(F.desc("tf")).rowsBetween(Window.unboundedPreceding, -1)
    reached = by_count.withColumn("_above", F.coalesce(F.sum("_terms").over(above), F.lit(0))).filter(F.col("_above") < k)
    floor = reached.agg(F.min("tf").alias("floor"))
    return totals.filter(F.col("tf") >= floor.scalar()).orderBy(F.desc("tf"), "term").limit(k)


def bucket_totals(terms: DataFrame) -> DataFrame:
    """``_b, term, df, tf``: the totals inside each bucket of records. The n-grams already stand by
    bucket, so nothing is shuffled."""
    return terms.groupBy("_b", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def frequent_totals(
    by_bucket: DataFrame, n_records: Column, min_df: int, max_df: float, k: int, broadcast_terms: int = BROADCAST_TERMS
) -> DataFrame | None:
    """``term, df, tf`` of all terms that can be among the ``k`` most frequent within the limits, or
    None where bounds cannot tell.

    The ``k`` largest terms of each bucket are a summary of it; their exact totals give a count
    that the k-th term is sure to reach. A term that reaches it must reach the share of one bucket
    in some bucket, so only such terms are counted exactly. What moves between tasks is bounded by
    buckets times ``k`` and by these terms; all others, most of them rare, never leave their bucket.
    Without ``k`` terms in the limits, with a share of one, with buckets that are hardly larger than
    their summaries, or with more candidates than ``broadcast_terms``, all totals have to be added up."""

    def exact(candidates: DataFrame) -> DataFrame:
        known = by_bucket.join(F.broadcast(candidates), "term", "left_semi")
        return known.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))

    buckets = by_bucket.agg(F.count_distinct("_b")).first()[0]
    if by_bucket.count() <= 2 * buckets * k:
        return None  # the summaries would hold most of the buckets' rows
    place = F.row_number().over(Window.partitionBy("_b").orderBy(F.desc("tf"), "term"))
    summary = by_bucket.withColumn("_place", place).filter(F.col("_place") <= k).select("term").distinct()
    summary = write_table(summary, "frequent_terms")
    if summary.count() > broadcast_terms:
        return None
    allowed = (F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n_records)
    floor = exact(summary).filter(allowed).orderBy(F.desc("tf")).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("tf").alias("tf")).first()
    if floor["n"] < k or floor["tf"] <= buckets:
        return None
    share = -(-floor["tf"] // buckets)
    candidates = write_table(by_bucket.filter(F.col("tf") >= share).select("term").distinct(), "frequent_terms")
    return exact(candidates) if candidates.count() <= broadcast_terms else None


def fit_vocab(
    terms: DataFrame,
    n_records: int | DataFrame,
    min_df: int = 1,
    max_df: float = 1.0,
    max_features: int | None = None,
) -> DataFrame:
    """``term, term_id, df, idf``: document-frequency limits, the most frequent terms, ids in
    term order, idf ``ln((1 + n) / (1 + df)) + 1``.

    ``n_records`` is the number of records or a one-row table with it. The term totals within the
    limits are written once, since the ids read them more than once and the n-grams behind them are
    the expensive part. ``terms`` may be totals already (``term, df, tf``). Terms with their bucket of
    records ``_b`` are added up inside the buckets, and only those that can be among the most frequent
    are added up over all of them.
    """
    count = n_records.first()[0] if isinstance(n_records, DataFrame) else n_records
    n = F.lit(count)
    if "df" in terms.columns:
        totals = terms
    elif "_b" in terms.columns:
        by_bucket = write_table(bucket_totals(terms), "bucket_totals")
        totals = frequent_totals(by_bucket, n, min_df, max_df, max_features) if max_features is not None else None
        if totals is None:
            totals = by_bucket.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    else:
        totals = G.add_up(terms, int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # most terms are rare: only those within the limits are written
    kept = write_table(within(totals, count, min_df, max_df), "term_totals")
    if max_features is not None:
        kept = top_terms(kept, max_features)
    return number_terms(kept).select(
        "term", "term_id", "df", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf")
    )


def number_terms(totals: DataFrame) -> DataFrame:
    """Dense ids in term order. Terms are dealt over ranges whose limits Spark samples, so a
    frequent beginning is cut like any other; the ranges are written, numbered inside, and
    shifted by the sizes of the ranges before."""
    ranged = totals.repartitionByRange("term").withColumn("_range", F.spark_partition_id())
    ranged = write_table(ranged, "term_ranges")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("term")) - 1
    numbered = ranged.withColumn("_place", place).join(starts, "_range")
    return numbered.withColumn("term_id", (F.col("_start") + F.col("_place")).cast("int")).drop("_range", "_start", "_place")


def sent_if_small(written: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its rows are few enough, so that what it is joined to stays."""
    return F.broadcast(written) if written.count() <= BROADCAST_TERMS else written


def known_terms(occurrences: DataFrame, vocab: DataFrame) -> DataFrame:
    """``uid, term_id, idf, tf``: the terms of the vocabulary, looked up before they are added up, so
    that only numbers are held and no term that it lacks."""
    found = occurrences.join(vocab.select("term", "term_id", "idf"), "term")
    return found.groupBy("uid", "term_id", "idf").agg(F.sum("tf").alias("tf"))


def packed_weights(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """``uid, entries`` with the known terms of each record as ``(term_id, w)`` in id order:
    ``(1 + ln tf) · idf`` scaled to length one. The terms of a record are put together by one
    aggregation, which takes the length too."""
    return pack_blocks(terms.join(vocab.select("term", "term_id", "idf"), "term")).drop("rows")


def pack_blocks(known: DataFrame, *cuts: int) -> DataFrame:
    """``uid, entries, rows`` from ``uid, term_id, idf, tf``. Ids from one of ``cuts`` to the next are
    a block, which is scaled to length one by itself. Rows without an id give their record no entry;
    ``rows`` is their number."""
    weight = (1 + F.log("tf")) * F.col("idf")
    limits = [None, *cuts, None]

    def inside(i: Column, block: int) -> Column:
        low, high = limits[block : block + 2]
        return (F.lit(True) if low is None else i >= low) & (F.lit(True) if high is None else i < high)

    blocks = range(len(cuts) + 1)
    packed = known.groupBy("uid").agg(
        F.array_sort(F.collect_list(F.when(F.col("term_id").isNotNull(), F.struct("term_id", weight.alias("w"))))).alias("_e"),
        F.count_if(F.col("term_id").isNull()).alias("rows"),
        *[F.sqrt(F.sum(F.when(inside(F.col("term_id"), k), weight * weight))).alias(f"_norm{k}") for k in blocks],
    )

    def scaled(x: Column) -> Column:
        norm = F.col(f"_norm{blocks[-1]}")
        for k in reversed(blocks[:-1]):
            norm = F.when(inside(x["term_id"], k), F.col(f"_norm{k}")).otherwise(norm)
        return F.struct(x["term_id"].alias("term_id"), (x["w"] / norm).alias("w"))

    return packed.select("uid", F.transform("_e", scaled).alias("entries"), "rows")


def tfidf(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """``uid, term_id, w`` of ``packed_weights``, one row per record and term."""
    return packed_weights(terms, vocab).select("uid", F.inline("entries"))


def to_vector(packed: DataFrame, dim: int, docs: DataFrame | None = None, name: str = "features") -> DataFrame:
    """``uid`` and a sparse vector from ``uid, entries``. Records of ``docs`` without any known
    term get the zero vector.

    The vector is built as the struct by which Spark stores vectors, written, and read back
    with the vector type, so no record passes through Python.
    """
    if docs is not None:
        packed = docs.select("uid").join(packed, "uid", "left")
    entries = F.coalesce("entries", F.expr("cast(array() as array<struct<term_id:int,w:double>>)"))
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(dim).alias("size"),
        F.transform(entries, lambda x: x["term_id"].cast("int")).alias("indices"),
        F.transform(entries, lambda x: x["w"]).alias("values"),
    )
    path = scratch_path(packed.sparkSession, name)
    packed.select("uid", vector.alias(name)).write.parquet(path)
    schema = StructType([packed.schema["uid"], StructField(name, VectorUDT())])
    return packed.sparkSession.read.schema(schema).parquet(path)


def required(value: Column, name: str) -> Column:
    """The value, or a failed job that names the record and what it lacks."""
    missing = F.raise_error(F.concat(F.lit(f"no {name} for record "), F.coalesce(F.col("uid").cast("string"), F.lit("null"))))
    return F.coalesce(value, missing.cast("double"))


def stack_features(*blocks: DataFrame) -> DataFrame:
    """Put feature blocks side by side by record key, not by row position. The records are
    those of the first block; one that another block lacks fails the job."""

    def put(left: DataFrame, right: DataFrame) -> DataFrame:
        joined = left.join(right.withColumn("_there", F.lit(1.0)), "uid", "left")
        return joined.filter(required(F.col("_there"), "feature block") > 0).drop("_there")

    return reduce(put, blocks)


def fit_corpus(*parts: DataFrame) -> DataFrame:
    """All text sources a vocabulary is fitted on."""
    return reduce(lambda a, b: a.unionByName(b), parts)
