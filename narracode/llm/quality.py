"""Quality rules that judge hosts: rule failures per host, shrunk rates, and verdicts joined back.

Only SQL functions run here. A document's counts come from its own row; what is shuffled are
sums per host. A host with few documents says little about itself, so its failure rate is
pulled towards the rate of all hosts by a beta prior whose two moments are those of the hosts'
rates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narracode.session import write_table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Hash of the window that begins with word ``x`` at ``i`` of ``_w``.
WINDOW_HASH = "xxhash64(x, get(_w, i + 1), get(_w, i + 2))"
#: A host is rejected if the shrunk failure rate of any rule is above this.
MAX_FAILURE_RATE = 0.5
#: Limits of the prior's strength, in documents.
MIN_STRENGTH, MAX_STRENGTH = 1.0, 10_000.0
#: Rejected hosts, and bytes of their names, that are broadcast if a count shows no more.
BROADCAST_HOSTS, BROADCAST_BYTES = 500_000, 32 << 20
#: Pieces into which the rows of each host are dealt where the rejected hosts are too many.
PIECES = 64

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RULES = ["too_short", "repetitive", "symbols", "odd_words", "repeated_lines"]


def text_counts(rows: DataFrame, text: str = "_text") -> DataFrame:
    """Add the counts of ``BASE`` and ``_n_lines`` to rows with a text column; a missing text
    counts as none.

    A three-word window is a hash with its position in the low bits, so one sort of numbers per
    text finds the windows that may occur twice. Only these are then sorted by their words, and
    equal neighbours are repeats: the count is exact whatever the hashes.
    """
    rows = rows.withColumn("_s", F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumn("_w", F.regexp_extract_all("_s", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("_lines", F.filter(F.split("_s", "\n", -1), lambda s: s.rlike(WORD)))
    rows = rows.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.regexp_count("_s", F.lit(SYMBOL)).cast("long"),
            "_n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_bits": F.ceil(F.log2(F.size("_w") + 2)).cast("int"),
        }
    )
    rows = rows.withColumn(
        "_keys",
        F.expr(f"sort_array(transform(slice(_w, 1, greatest(size(_w) - 2, 0)), (x, i) -> shiftleft({WINDOW_HASH}, _bits) | i))"),
    )
    same = "shiftrightunsigned(x, _bits) = shiftrightunsigned(get(_keys, {}), _bits)"
    twice = f"filter(_keys, (x, i) -> coalesce({same.format('i + 1')}, false) or coalesce({same.format('i - 1')}, false))"
    place = "cast(x & (shiftleft(1L, _bits) - 1) as int)"
    words = f"transform({twice}, x -> named_struct('a', get(_w, {place}), 'b', get(_w, {place} + 1), 'c', get(_w, {place} + 2), 'p', {place}))"
    equal = "coalesce(y.a = get(s, {0}).a and y.b = get(s, {0}).b and y.c = get(s, {0}).c, false)"
    sure = f"filter(s, (y, i) -> {equal.format('i + 1')} or {equal.format('i - 1')})"
    # a one-element array names the sorted windows
    rows = rows.withColumn("_at", F.expr(f"sort_array(get(transform(array(sort_array({words})), s -> transform({sure}, y -> y.p)), 0))"))
    covered = "transform(_at, (p, i) -> least(3, coalesce(get(_at, i + 1) - p, 3)))"
    rows = rows.withColumn("n_repeat_words", F.expr(f"aggregate({covered}, 0L, (a, x) -> a + x)"))
    return rows.drop("_s", "_w", "_lines", "_bits", "_keys", "_at")


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_failures() -> dict[str, Column]:
    """Whether a document fails each rule. Hosts are judged by all of them."""
    words = F.col("n_words")
    return {
        "too_short": words < 50,
        "repetitive": 100 * F.col("n_repeat_words") > 50 * words,
        "symbols": 10 * F.col("n_symbols") > words,
        "odd_words": (F.col("word_chars") < 3 * words) | (F.col("word_chars") > 10 * words),
        "repeated_lines": 10 * F.col("n_dup_lines") > 3 * F.col("_n_lines"),
    }


def host_verdicts(features: DataFrame, max_rate: float = MAX_FAILURE_RATE) -> DataFrame:
    """``_host, _rejected`` for every host. ``features`` has ``_host`` and the counts."""
    failed = {r: F.sum(c.cast("long")).alias(r) for r, c in rule_failures().items()}
    hosts = features.filter(F.col("_host").isNotNull()).groupBy("_host").agg(F.count(F.lit(1)).alias("_n"), *failed.values())
    moments = []
    for r in RULES:
        rate = F.col(r) / F.col("_n")
        moments += [F.avg(rate).alias(f"m_{r}"), F.var_pop(rate).alias(f"v_{r}")]
    prior = hosts.agg(F.struct(*moments).alias("_prior")).scalar()
    hosts = hosts.withColumn("_prior", prior)
    bad = F.lit(False)
    for r in RULES:
        mean, spread = F.col(f"_prior.m_{r}"), F.col(f"_prior.v_{r}")
        strength = F.when(spread > 0, mean * (1 - mean) / spread - 1).otherwise(F.lit(MAX_STRENGTH))
        strength = F.least(F.greatest(strength, F.lit(MIN_STRENGTH)), F.lit(MAX_STRENGTH))
        bad = bad | ((F.col(r) + mean * strength) / (F.col("_n") + strength) > max_rate)
    return hosts.select("_host", bad.alias("_rejected"))


def judge(docs: DataFrame, max_rate: float = MAX_FAILURE_RATE) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``host_rejected`` and ``kept`` for every row.

    A document is kept if it passes the base rules and its host (``source``) is not rejected. A
    document without a host is judged by the base rules alone; a missing or empty text has no
    words and fails. Repeated rows count as often as they occur. The counts are written once:
    hosts are summed from them and joined back to them, and the text is read once.
    """
    rows = docs.select("doc_id", F.col("source").alias("_host"), F.col("text").alias("_text"))
    features = write_table(text_counts(rows).drop("_text"), "quality")
    verdicts = host_verdicts(features, max_rate).withColumnRenamed("_host", "_judged")
    joined = features.join(verdicts, F.col("_host") == F.col("_judged"), "left")
    rejected = F.coalesce(F.col("_rejected"), F.lit(False))
    return joined.select(
        "doc_id",
        *BASE,
        base_failed().alias("base_failed"),
        rejected.alias("host_rejected"),
        (~base_failed() & ~rejected).alias("kept"),
    )


def keep_good(docs: DataFrame, max_rate: float = MAX_FAILURE_RATE) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Rows are written once beside their counts; hosts are summed from the counts alone. The
    rejected hosts are counted in their written table: up to ``BROADCAST_HOSTS`` are broadcast
    and no text moves; more are joined with every host dealt into ``PIECES``, so a host with
    a third of all rows is never one task.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.col("source").alias("_host"), F.col("text").alias("_text"))
    counted = write_table(text_counts(rows).drop("_text"), "quality")
    bad = host_verdicts(counted, max_rate).filter("_rejected").select(F.col("_host").alias("_judged"))
    bad = write_table(bad, "rejected_hosts")
    return _without_hosts(counted.filter(~base_failed()), bad).select("_row.*")


def _without_hosts(rows: DataFrame, bad: DataFrame, most: int = BROADCAST_HOSTS) -> DataFrame:
    """Rows whose ``_host`` is not in ``_judged`` of the written table ``bad``; no host is no match."""
    same = F.col("_host") == F.col("_judged")
    hosts, size = bad.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_judged")), F.lit(0))).first()
    if hosts <= most and size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(bad), same, "left_anti")
    rows = rows.withColumn("_piece", F.pmod(F.monotonically_increasing_id(), F.lit(PIECES)))
    bad = bad.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    return rows.join(bad, same & (F.col("_piece") == F.col("_of")), "left_anti").drop("_piece")


#: The same counts and verdicts in SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS s FROM documents),
w AS (SELECT doc_id, source, s, regexp_extract_all(s, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
t AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k FROM g),
r AS (SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, k) >= 2),
p AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
c AS (SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(s, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN p ON w.doc_id = p.doc_id),
f AS (SELECT *, [n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words,
        word_chars < 3 * n_words OR word_chars > 10 * n_words, 10 * n_dup_lines > 3 * n_lines] AS failed FROM c),
u AS (SELECT source, unnest(failed) AS bad, unnest([1, 2, 3, 4, 5]) AS rule FROM f WHERE source IS NOT NULL),
h AS (SELECT source, rule, count(*) AS n, CAST(sum(CAST(bad AS INT)) AS DOUBLE) AS k FROM u GROUP BY ALL),
m AS (SELECT rule, avg(k / n) AS m, var_pop(k / n) AS v FROM h GROUP BY rule),
q AS (SELECT rule, m, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 10000.0 END, 1.0), 10000.0) AS z FROM m),
b AS (SELECT source, bool_or((k + m * z) / (n + z) > 0.5) AS rejected FROM h JOIN q USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed[1] OR failed[2] AS base_failed,
  coalesce(rejected, false) AS host_rejected,
  NOT (failed[1] OR failed[2]) AND NOT coalesce(rejected, false) AS kept
FROM f LEFT JOIN b ON f.source = b.source
"""
