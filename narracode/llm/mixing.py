"""Mixing of sources to target weights by Pareto order sampling.

A source's target is its share of all words, at most ``MOST`` times its own; what is over goes to
the other sources by weight until none is over. Inside a source a document is expected
``e = min(MOST, rate * c / (c + HALF))`` times, ``c`` being its words up to ``LEVEL``, with the rate
at which the expected words are the target: documents of a few words are wanted less often than
others, and none is over ``MOST`` copies. The whole part of ``e`` are certain copies. The rest ``p``
is the probability of one more copy, unequal between documents, and these copies are drawn by
Pareto order sampling: every document gets random odds ``u / (1 - u)`` divided by its odds of
inclusion ``p / (1 - p)``, and those with the least quotients are taken. The sample's size is fixed
in words: documents are taken in that order as long as they fit into what the certain copies leave
of the target. A very long document can end this early, so the order is gone through again for what
is left, past the documents that are longer, and one last document closes the gap if it helps.

The place where a source's sample ends is found without sorting it: the words in 4 096 ranges of
the order give the range that holds the end, which is cut again until few rows are left. So a
source with a third of all rows costs partial sums, like any other.

Rows: a missing text has no words, and a document without words is taken 0 words. Rows without a
source are a source of their own, the last. The draw hangs on the seed, the id and the text alone;
rows that are equal in all three are copies and can stand for each other, so a rerun returns the
same rows whatever the partitions. Only ``doc_id``, ``source`` and ``text`` are read, whatever
other columns there are. No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narracode.session import write_table

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: Most times that the mix takes a source's words, or a document's.
MOST = 3
#: A document of so many words is wanted half as often as a very long one.
HALF = 32
#: Documents of more words are all wanted alike.
LEVEL = 1024
#: Times that the order is gone through.
ROUNDS = 3
#: Rows of a source's range that are put in order by one task.
WINDOW_ROWS = 50_000
#: Sources up to which the table of sources is broadcast; its rows are counted.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"

_BITS, _DIGIT = 48, 12


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """``doc_id, source, size, _c, _u, _b, _n``: words, their level, the draw in (0, 1), and a
    random order and a number by which equal draws are told apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text))
    draw = (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        draw.alias("_u"),
        F.monotonically_increasing_id().alias("_n"),
    )
    rows = rows.withColumn("_c", F.least("size", F.lit(LEVEL)))
    return write_table(rows.withColumn("_b", F.shiftrightunsigned(F.xxhash64("_n"), 64 - _BITS)), "sized")


def source_weights(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add ``_w``, the repeating weight by the place of ``source`` in the order of code points, a
    missing one last. Places are counted inside ranges of sources; the ranges' sizes shift them."""
    ranged = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ranged = ranged.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()})
    ranged = write_table(ranged.withColumn("_i", F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))), "sources")
    parts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_p")) - F.col("_rows")
    shifted = ranged.join(F.broadcast(parts.select("_p", before.alias("_before"))), "_p")  # a row for each task
    place = F.col("_i") + F.col("_before")
    return shifted.withColumn("_w", F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(place, F.lit(len(weights))).cast("int"))).drop("_p", "_i", "_before")


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Add ``target`` to ``source, source_size, _w``. Each round reads a few sums of the table."""
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    rate, n_over = 0.0, -1
    while True:
        over = F.lit(rate) * F.col("_w") > most * F.col("source_size")
        full, rest, n = sources.agg(
            F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)), F.sum(F.when(~over, F.col("_w"))), F.coalesce(F.sum(over.cast("long")), F.lit(0))
        ).first()
        if n == n_over or not rest:
            break
        rate, n_over = (total - most * full) / rest, n
    over = F.lit(rate) * F.col("_w") > most * F.col("source_size")
    return sources.withColumn("target", F.when(over, (most * F.col("source_size")).cast("double")).otherwise(F.lit(rate) * F.col("_w")))


def rates(words: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """Add ``_rate`` and ``_rest`` to the sources: the rate at which the expected words are the
    target, and the words that certain copies leave. ``words`` has a row for each source and
    level. Levels are filled up from the highest; the rate is that of the first that is not."""
    by = Window.partitionBy("source").orderBy("_c")
    wanted = F.col("_words") * F.col("_c") / (F.col("_c") + HALF)
    rows = words.filter("_c > 0").join(sources.select(F.col("source").alias("_s"), "target"), F.col("source").eqNullSafe(F.col("_s")))
    rows = rows.withColumns({"_below": F.sum(wanted).over(by), "_to": F.sum("_words").over(by), "_all": F.sum("_words").over(Window.partitionBy("source"))})
    rate = (F.col("target") - most * (F.col("_all") - F.col("_to"))) / F.col("_below")
    rows = rows.withColumn("_r", rate).withColumn("_open", F.col("_r") * F.col("_c") / (F.col("_c") + HALF) <= most * (1 + 1e-12))
    best = rows.groupBy("source").agg(F.max_by("_r", F.when(F.col("_open"), F.col("_c"))).alias("_rate"))
    best = best.select(F.col("source").alias("_s"), "_rate")
    certain = words.join(best, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_k", F.col("_words") * copies(F.col("_c"), F.col("_rate"), most)[0])
    certain = certain.groupBy("_s", "_rate").agg(F.sum("_k").alias("_certain"))
    joined = sources.join(certain, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    rest = F.greatest(F.col("target") - F.coalesce("_certain", F.lit(0)), F.lit(0.0))
    return joined.withColumns({"_rest": rest}).drop("_certain")


def copies(c: Column, rate: Column, most: int = MOST) -> tuple[Column, Column]:
    """Certain copies and the probability of one more, for a level and a rate."""
    e = F.least(F.lit(float(most)), F.coalesce(rate, F.lit(0.0)) * c / (c + HALF))
    whole = F.floor(e + 1e-9)
    return whole, F.when(e - whole > 1e-9, e - whole).otherwise(F.lit(0.0))


def _place(rows: DataFrame, most: int) -> DataFrame:
    """Add ``_k`` certain copies and ``_a``, the place in the Pareto order as a 48-bit number, null
    where no more copy is possible. ``r = q / (1 + q)`` of the quotient ``q`` has its order."""
    whole, p = copies(F.col("_c"), F.col("_rate"), most)
    rows = rows.withColumns({"_k": whole, "_p": p})
    down = F.col("_u") * (1 - F.col("_p"))
    r = down / (down + (1 - F.col("_u")) * F.col("_p"))
    at = F.least(F.floor(r * float(1 << _BITS)), F.lit((1 << _BITS) - 1)).cast("long")
    return rows.withColumn("_a", F.when((F.col("_p") > 0) & (F.col("size") > 0), at)).drop("_p")


def _of_source(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    side = sources.withColumnRenamed("source", "_s")
    side = F.broadcast(side) if n_sources <= BROADCAST_SOURCES else side
    return rows.join(side, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def sample_ends(drawn: DataFrame, sources: DataFrame, n_sources: int, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``source, _last, _got``: the last place of every source's sample and its words.

    ``drawn`` has ``source, size, _a, _b, _n``, ``sources`` the words ``_rest`` that the sample may
    have. A place is the Pareto order, then a random order of equal draws. Its digits are read from
    the front: ``_end`` is the range that holds the end, ``_got`` the words before it."""
    digits = _BITS // _DIGIT

    def prefix(level: int) -> Column:
        # the first ``level`` digits of the two 48-bit orders, as a pair
        a = F.shiftright("_a", _BITS - _DIGIT * min(level, digits))
        b = F.shiftright("_b", _BITS - _DIGIT * max(level - digits, 0)) if level > digits else F.lit(0).cast("long")
        return F.struct(a.alias("a"), b.alias("b"))

    state = sources.select(
        "source", "_rest", F.lit(0.0).alias("_got"), F.struct(*[F.lit(0).cast("long").alias(x) for x in "ab"]).alias("_end"), F.lit(False).alias("_all")
    )
    for level in range(1, 2 * digits + 1):
        inside = _of_source(drawn, state, n_sources).filter(~F.col("_all") & (prefix(level - 1) == F.col("_end")))
        sums = inside.groupBy("source", "_rest", "_got", prefix(level).alias("_at")).agg(F.sum("size").alias("_words"), F.count(F.lit(1)).alias("_rows"))
        upto = F.sum("_words").over(Window.partitionBy("source").orderBy("_at"))
        sums = sums.withColumn("_upto", F.col("_got") + upto)
        over = F.col("_upto") > F.col("_rest")
        least = sums.groupBy(F.col("source").alias("_s")).agg(
            F.min(F.when(over, F.struct("_at", "_rows", (F.col("_upto") - F.col("_words")).alias("_before")))).alias("_cut"), F.max("_upto").alias("_sum")
        )
        state = state.join(least, F.col("source").eqNullSafe(F.col("_s")), "left")
        none = F.col("_all") | F.col("_cut").isNull()  # all that could be drawn fits
        state = state.select(
            "source",
            "_rest",
            F.when(F.col("_all"), F.col("_got")).when(F.col("_cut").isNull(), F.coalesce("_sum", "_got")).otherwise(F.col("_cut._before")).alias("_got"),
            F.when(none, F.col("_end")).otherwise(F.col("_cut._at")).alias("_end"),
            none.alias("_all"),
            F.when(~none, F.col("_cut._rows")).alias("_rows"),
        )
        state = write_table(state, "sample_ends")
        most_rows = state.agg(F.max("_rows")).first()[0] or 0
        state = state.drop("_rows")
        if most_rows <= window_rows:
            break
    inside = _of_source(drawn, state, n_sources).filter(~F.col("_all") & (prefix(level) == F.col("_end")))
    upto = F.col("_got") + F.sum("size").over(Window.partitionBy("source").orderBy("_a", "_b", "_n"))
    inside = inside.withColumn("_upto", upto).filter(F.col("_upto") <= F.col("_rest"))
    last = inside.groupBy(F.col("source").alias("_s")).agg(F.max(F.struct("_a", "_b", "_n")).alias("_last"), F.max("_upto").alias("_sum"))
    state = state.join(last, F.col("source").eqNullSafe(F.col("_s")), "left")
    top = F.lit((1 << _BITS) - 1).cast("long")
    start = F.shiftleft(F.col("_end.a"), _BITS - _DIGIT * min(level, digits))
    deep = F.shiftleft(F.col("_end.b"), _BITS - _DIGIT * max(level - digits, 0)) if level > digits else F.lit(0).cast("long")
    # without a last row the sample ends before the range
    end = F.when(F.col("_all"), F.struct(top.alias("_a"), top.alias("_b"), F.lit((1 << 63) - 1).alias("_n")))
    end = end.when(F.col("_last").isNotNull(), F.col("_last")).otherwise(F.struct(start.alias("_a"), deep.alias("_b"), F.lit(-1).cast("long").alias("_n")))
    return state.select("source", end.alias("_last"), F.coalesce("_sum", "_got").alias("_got"))


def _taken(rounds: int) -> Column:
    """Whether a row is in the sample of one of the first rounds."""
    place = F.struct("_a", "_b", "_n")
    found = F.lit(False)
    for i in range(rounds):
        found = found | ((F.col("size") <= F.col(f"_gap{i}")) & (place <= F.col(f"_last{i}")))
    return F.col("_a").isNotNull() & found


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` of every document.

    ``size`` counts words, ``target`` is the source's, ``taken`` the words that the mix takes of
    the document: its size times the whole number ``copies``, at most ``most``.
    """
    rows = sized(docs, seed)
    words = write_table(rows.groupBy("source", "_c").agg(F.sum("size").alias("_words")), "source_levels")
    sources = words.groupBy("source").agg(F.sum("_words").alias("source_size"))
    sources = targets(write_table(source_weights(sources, weights), "source_weights"), most)
    sources = write_table(rates(words, sources, most), "source_rates")
    n_sources = sources.count()
    placed = _place(_of_source(rows, sources.select("source", "_rate"), n_sources), most)
    state = sources.select("source", "source_size", "target", F.col("_rest").alias("_gap0"))
    for i in range(ROUNDS + 1):
        left = _of_source(placed.filter(F.col("_a").isNotNull()), state, n_sources).filter(~_taken(i))
        if i < ROUNDS:
            drawn = left.filter(F.col("size") <= F.col(f"_gap{i}")).select("source", "size", "_a", "_b", "_n")
            found = sample_ends(drawn, state.select("source", F.col(f"_gap{i}").alias("_rest")), n_sources, window_rows)
            found = found.select(F.col("source").alias("_s"), F.col("_last").alias(f"_last{i}"), "_got")
        else:
            off = F.abs(F.col("size") - F.col(f"_gap{i}"))
            found = left.filter(off < F.col(f"_gap{i}")).groupBy(F.col("source").alias("_s"))
            found = found.agg(F.min_by("_n", F.struct(off, "_a", "_b")).alias("_closing"), F.lit(0).alias("_got"))
        state = state.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        state = write_table(state.withColumn(f"_gap{i + 1}", F.col(f"_gap{i}") - F.coalesce("_got", F.lit(0))).drop("_got"), "sampled")
    out = _of_source(placed, state, n_sources)
    more = F.when(_taken(ROUNDS) | F.coalesce(F.col("_n") == F.col("_closing"), F.lit(False)), 1).otherwise(0)
    out = out.withColumn("copies", (F.col("_k") + more).cast("int"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
