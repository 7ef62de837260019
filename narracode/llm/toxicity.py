"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

Toxic and ordinary training texts each have a model of the next character within a word. Runs
of six characters count as often as they occur, shorter ones by the number of different
characters before them, and each order gives its discount to the next shorter one. The two
shortest orders are shared by both classes: a rare expression that neither class knows falls
back to the same counts and costs both the same. A text is scored by the difference of the
log-likelihoods: normalised by length for the whole text, and for its three most suspicious
words, since a few words make a text toxic. A logistic curve, fitted on rows the models have not
seen, turns these numbers into a score.

The counts come from all training rows that are not set aside for that curve. They stand by the
run itself in a table that grows with the corpus. What a character adds to a word's score depends
on the run it ends alone, so the different runs of the texts are joined to the counts, one order
after the other, and their scores go to the texts by parts of the corpus; nothing is broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narracode.llm.words import WordRows, blocks, segments
from narracode.session import write_table

#: Longest run of characters, and the orders that both classes share.
ORDER, SHARED = 6, 2
DISCOUNT = 0.75
#: Words of a text that are looked at by themselves.
WORST = 3
#: One training row in so many is set aside for the curve, and at most so many of them are used.
ASIDE, CURVE_ROWS = 5, 20_000
THRESHOLD = 0.7
#: Steepness of the score in the normalised difference where there is nothing to fit the curve on.
STEEP = 4.0
#: Different words of the texts that a task holds before it lets go of their runs.
HELD_WORDS = 1_200_000
#: Different words, and characters of them, whose runs are numbered at once.
BLOCK_WORDS, PIECE_CHARS = 50_000, 1 << 19
#: Bytes of texts that a task packs at once, and rows that are unpacked at once.
PACKED_BYTES, PACKED_ROWS = 32 << 20, 1_000
#: Different words whose scores a part holds.
PART_WORDS = 1_000_000
#: Parts up to which each gets a task of its own.
SPREAD_PARTS = 4_096
#: Characters of the texts whose runs and scores meet in one task, and the least number of such parts.
PART_CHARS, MIN_PARTS = 64 << 20, 8

_START, _END = "\x02", "\x03"
_FEATURES = 2 + WORST


def id_hash(doc_id: Column) -> Column:
    """CRC-32 of the id as text; a missing id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return id_hash(doc_id) % 3 == 1


# ---------------------------------------------------------------- runs of characters


def longest_runs(word: str) -> list[str]:
    """For each character of a marked word, the run of at most ``ORDER`` characters it ends."""
    marked = _START + word + _END
    return [marked[max(0, i + 1 - ORDER) : i + 1] for i in range(1, len(marked))]


def marked_pieces(words: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Marked words in blocks: pieces, how many characters of each are context only, and the
    number of its word. A very long word is cut into pieces that overlap by a run's context."""
    for first in range(0, len(words), BLOCK_WORDS):
        marked = [_START + w + _END for w in words[first : first + BLOCK_WORDS]]
        if sum(map(len, marked)) <= 2 * PIECE_CHARS:
            yield marked, np.ones(len(marked), np.int64), np.arange(first, first + len(marked))
            continue
        pieces, skips, owners, held = [], [], [], 0
        for k, word in enumerate(marked, first):
            for i in range(0, len(word), PIECE_CHARS):
                pieces.append(word[max(0, i - ORDER + 1) : i + PIECE_CHARS])
                skips.append(ORDER - 1 if i else 1)
                owners.append(k)
                held += len(pieces[-1])
                if held >= PIECE_CHARS:
                    yield pieces, np.array(skips), np.array(owners)
                    pieces, skips, owners, held = [], [], [], 0
        if pieces:
            yield pieces, np.array(skips), np.array(owners)


def distinct_runs(pieces: list[str], skips: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different longest runs of marked pieces, the number of the run that each predicted
    character ends, and where the characters of each piece begin."""
    joined = "".join(pieces)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(0x110000, bool)
    seen[code] = True
    number = np.cumsum(seen)
    bits, rank = int(number[-1]).bit_length(), number[code]
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts = np.cumsum(lengths) - lengths
    at = np.arange(len(code)) - np.repeat(starts, lengths)

    def packed(back: range) -> np.ndarray:
        key = np.zeros(len(code), np.int64)
        for j in range(back.start, min(back.stop, len(code))):
            before = np.where(at[j:] >= j, rank[: len(code) - j], 0)
            key[j:] |= before << (bits * (j - back.start))
        return key

    half = ORDER // 2
    low, high = packed(range(half)), packed(range(half, ORDER))
    if bits * ORDER <= 63:
        key = low | high << (bits * half)
    else:  # large alphabets: halves are numbered before they are put together
        (kinds, low), high = np.unique(low, return_inverse=True), np.unique(high, return_inverse=True)[1]
        key = high * len(kinds) + low
    places = np.flatnonzero(at >= np.repeat(skips, lengths))
    key = key[places]
    order = np.argsort(key)
    ordered = key[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    which = np.empty(len(key), np.int64)
    which[order] = np.cumsum(new) - 1
    ends = places[order[new]]
    begins = ends - np.minimum(at[ends], ORDER - 1)
    runs = [joined[i:j] for i, j in zip(begins.tolist(), (ends + 1).tolist(), strict=True)]
    predicted = lengths - skips
    return runs, which, np.cumsum(predicted) - predicted


def _counted(words: Counter[str], cls: int) -> Iterator[pa.RecordBatch]:
    times = np.fromiter(words.values(), np.int64, len(words))
    for pieces, skips, owners in marked_pieces(list(words)):
        runs, which, begins = distinct_runs(pieces, skips)
        each = np.repeat(times[owners], np.diff(np.r_[begins, len(which)]))
        n = np.bincount(which, each, len(runs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(runs), pa.array([cls] * len(runs), pa.int32()), pa.array(n)], names=["run", "class", "n"])


def count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs per class, added up in blocks of the task's different words. Rows are text and class."""
    words: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
    for batch in batches:
        for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for piece in segments(t or ""):
                words[c].update(piece.lower().split())
                if sum(map(len, words)) > HELD_WORDS:
                    for cls in (0, 1):
                        yield from _counted(words[cls], cls)
                        words[cls].clear()
    for cls in (0, 1):
        yield from _counted(words[cls], cls)


def fit_counts(rows: DataFrame) -> DataFrame:
    """``run, n0, n1`` from ``text, class``: the counts of every run of every order in ordinary
    and in toxic texts. The orders that both classes share have one count, given twice."""
    runs = rows.select("text", F.col("class").cast("int")).mapInArrow(count_runs, "run string, class int, n long")
    sums = [F.sum(F.when(F.col("class") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)]
    longest = write_table(runs.groupBy("run").agg(*sums), "character_runs")
    above = out = longest.filter(F.length("run") == ORDER)
    for n in range(ORDER - 1, 0, -1):
        # a run at the beginning of a word counts as it occurs, any other by what stands before it
        kinds = [(F.col(f"n{c}") > 0).cast("long").alias(f"n{c}") for c in (0, 1)]
        starts = [F.col(f"n{c}") for c in (0, 1)]
        if n <= SHARED:
            kinds, starts = ([x.alias(f"n{c}") for c in (0, 1)] for x in (F.lit(1), F.col("n0") + F.col("n1")))
        here = above.select(F.substring("run", 2, n).alias("run"), *kinds).unionByName(longest.filter(F.length("run") == n).select("run", *starts))
        above = write_table(here.groupBy("run").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), f"run_counts_{n}")
        out = out.unionByName(above)
    return out


def run_scores(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """``run, score``: toxic less ordinary log-likelihood of the last character of each
    different run in ``runs``, given the characters before it."""
    ends = F.expr("explode(transform(sequence(1, length(run)), i -> right(run, i)))").alias("run")
    every = write_table(runs.select(ends).distinct(), "asked_runs")
    total = counts.filter(F.length("run") == 1).agg(F.sum("n0")).first()[0] or 0
    p = (F.coalesce("n0", F.lit(0)) + 0.5) / (total + 128.0)
    ones = every.filter(F.length("run") == 1).join(counts.filter(F.length("run") == 1), "run", "left")
    shorter = ones.select(F.col("run").alias("tail"), p.alias("p0"), p.alias("p1"))
    out = None
    for n in range(2, ORDER + 1):
        # asked and counted runs meet by the characters before the last one
        asked = every.filter(F.length("run") == n).select("run", F.lit(0).alias("n0"), F.lit(0).alias("n1"), F.lit(True).alias("asked"))
        own = counts.filter(F.length("run") == n).withColumn("asked", F.lit(False))
        both = asked.unionByName(own).withColumn("before", F.substring("run", 1, n - 1)).repartition("before")
        both = both.groupBy("before", "run").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.max("asked").alias("asked"))
        same = Window.partitionBy("before")
        for c in (0, 1):
            both = both.withColumn(f"t{c}", F.sum(f"n{c}").over(same)).withColumn(f"k{c}", F.count_if(F.col(f"n{c}") > 0).over(same))
        here = both.filter("asked").withColumn("tail", F.substring("run", 2, n - 1)).join(shorter, "tail")
        ps = []
        for c in (0, 1):
            less = F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0))
            q = (less + DISCOUNT * F.col(f"k{c}") * F.col(f"p{c}")) / F.col(f"t{c}")
            ps.append(F.when(F.col(f"t{c}") > 0, F.least(q, F.lit(1.0))).otherwise(F.col(f"p{c}")).alias(f"p{c}"))
        here = write_table(here.select("run", *ps), f"run_chances_{n}")
        shorter = here.withColumnRenamed("run", "tail")
        whole = here if n == ORDER else here.filter(F.col("run").startswith(_START))
        out = whole if out is None else out.unionByName(whole)
    log = lambda c: F.log(F.greatest(F.col(c), F.lit(1e-12)))
    return out.select("run", (log("p1") - log("p0")).cast("float").alias("score"))


def word_scores(words: list[str], scores: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Toxic less ordinary log-likelihood of each word, and its number of predicted characters."""
    small = [w.lower() for w in words]
    total = np.zeros(len(words))
    for pieces, skips, owners in marked_pieces(small):
        runs, which, begins = distinct_runs(pieces, skips)
        score = np.fromiter(map(scores.__getitem__, runs), np.float64, len(runs))
        np.add.at(total, owners, np.add.reduceat(score[which], begins))
    return total, np.fromiter(map(len, small), np.float64, len(words)) + 1


# ---------------------------------------------------------------- texts


def text_features(score: np.ndarray, chars: np.ndarray) -> list[float]:
    """Normalised difference of the whole text, the greatest differences of single words, and
    the log of the number of words."""
    out = np.zeros(_FEATURES)
    if len(score):
        worst = np.sort(score)[::-1][:WORST]
        out[0] = score.sum() / chars.sum()
        out[1 : 1 + len(worst)] = worst
        out[-1] = np.log1p(len(score))
    return out.tolist()


def _runs(words: set[str]) -> list[str]:
    found: set[str] = set()
    for pieces, skips, _ in marked_pieces(list({w.lower() for w in words})):
        found.update(distinct_runs(pieces, skips)[0])
    return list(found)


def _runs_of(batches: Iterator[tuple[int, list[str | None]]]) -> Iterator[pa.RecordBatch]:
    """Different longest runs of texts by part. A run comes again after so many words that the
    task has to let go of those it holds."""
    words: dict[int, set[str]] = {}

    def put():
        for part, found in words.items():
            runs = _runs(found)
            for i in range(0, len(runs), 100_000):
                some = runs[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(some), pa.int32()), pa.array(some)], names=["part", "run"])
        words.clear()

    for part, texts in batches:
        mine = words.setdefault(part, set())
        for t in texts:
            for piece in segments(t or ""):
                mine.update(piece.split())
                if sum(map(len, words.values())) > HELD_WORDS:
                    yield from put()
                    mine = words.setdefault(part, set())
    yield from put()


def _asked_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different longest runs of the task's texts. Rows are text."""
    yield from (b.select(["run"]) for b in _runs_of((0, b.column(0).to_pylist()) for b in batches))


def _part_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different longest runs of the parts' texts. Rows are part and packed rows."""
    yield from _runs_of((p, t) for b in batches for p, rows in zip(*map(pa.Array.to_pylist, b.columns), strict=True) for t in _texts(rows))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of id, text and part, as compressed Arrow streams of id and text, one for each part
    and so many bytes."""
    held: list[pa.RecordBatch] = []

    def put():
        table = pa.Table.from_batches(held).sort_by("part")
        part = table.column("part").to_numpy()
        cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)].tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            sink = pa.BufferOutputStream()
            rows = table.select(["doc_id", "text"]).slice(a, b - a)
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows, max_chunksize=PACKED_ROWS)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part[a]], pa.int32()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
        held.clear()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) > PACKED_BYTES:
            yield from put()
    if held:
        yield from put()


def _unpack(rows: bytes) -> Iterator[pa.RecordBatch]:
    with pa.ipc.open_stream(rows) as stream:
        yield from stream


def _texts(rows: bytes) -> Iterator[list[str | None]]:
    return (b.column(1).to_pylist() for b in _unpack(rows))


def _score_part(docs: pa.Table, scores: pa.Table) -> pa.Table:
    table: dict[str, float] = {}
    for batch in scores.to_batches():
        table.update(zip(batch.column("run").to_pylist(), batch.column("score").to_pylist(), strict=True))
    cache = WordRows(lambda words: word_scores(words, table), PART_WORDS)
    ids, out = [], []
    for packed in docs.column("rows"):
        for batch in _unpack(packed.as_py()):
            ids.append(batch.column(0))
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks([len(t) for t in texts]):
                cache.trim()
                rows = [cache.rows(t) for t in texts[a:b]]
                found, chars = cache.fill()
                out += [text_features(found[r], chars[r]) for r in rows]
    return pa.table({"doc_id": pa.chunked_array(ids), "x": pa.array(out, pa.list_(pa.float64()))})


def part_names(spark: SparkSession, parts: int) -> list[int]:
    """A name for each part such that Spark's hash deals every part to a task of its own."""
    names = spark.range(40 * parts).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("to"))
    found = {r["to"]: r["id"] for r in names.groupBy("to").agg(F.min("id").alias("id")).collect()}
    return [found.get(p, p) for p in range(parts)]


def features(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """``doc_id, x`` for the whole text of every row.

    The texts are dealt into parts that grow in number with the corpus. A part's different runs
    are joined to their scores, and these meet the part's texts in one task.
    """
    chars = docs.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
    parts = max(MIN_PARTS, -(-chars // PART_CHARS))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")
    if parts <= SPREAD_PARTS:
        part = F.get(F.array(*[F.lit(p) for p in part_names(docs.sparkSession, parts)]), part)
    texts = texts.withColumn("part", part)
    scores = run_scores(texts.select("text").mapInArrow(_asked_runs, "run string"), counts)
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = texts.mapInArrow(_pack, "part int, rows binary").repartition(parts, "part")
    met = dealt.mapInArrow(_part_runs, "part int, run string").join(scores, "run").select("part", "run", "score").repartition(parts, "part")
    return dealt.groupBy("part").cogroup(met.groupBy("part")).applyInArrow(_score_part, f"doc_id {kind}, x array<double>")


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights, the constant last, by Newton steps with a small ridge. Without rows of
    both classes the score rises with the normalised difference of the whole text, from the share of
    class 1, or one half."""
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return np.r_[STEEP, np.zeros(_FEATURES - 1), np.log((share + 0.01) / (1.01 - share))]
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.eye(len(w)) * 1e-2
        step = np.linalg.solve(h, z.T @ (y - p) - 1e-2 * w)
        w += step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
    inner = w[:-1] / spread
    return np.r_[inner, w[-1] - inner @ mean]


def score_toxicity(docs: DataFrame, labels: DataFrame, curve_rows: int = CURVE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for the whole text of every row.

    Learns from rows of ``labels`` (``doc_id, toxic``) whose id does not fall into the held-out
    part; missing labels teach nothing, several labels of an id count as often as they stand
    there. A missing or empty text is scored as a text without words. The curve is fitted on at
    most about ``curve_rows`` rows, chosen by a hash of the id, with one of each class at least where
    a class has two. Without any label the score is one half.
    """
    known = labels.filter(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("_lid"), F.col("toxic").cast("int").alias("class"))
    known = known.filter(~held_out(F.col("_lid")))
    drawn = F.xxhash64(F.col("_lid").cast("string"))
    aside = F.pmod(drawn, F.lit(ASIDE)) == 0
    # a class that the draw misses gives the row with the least hash, if it has another
    for r in known.withColumn("_h", drawn).groupBy("class").agg(F.count_if(aside).alias("n"), F.min("_h").alias("h"), F.max("_h").alias("most")).collect():
        if not r["n"] and r["h"] < r["most"]:
            aside = aside | ((F.col("class") == r["class"]) & (drawn == r["h"]))
    learn = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text")
    rows = learn.join(known.filter(~aside), F.col("doc_id") == F.col("_lid"))
    found = write_table(features(docs, fit_counts(rows)), "toxicity")
    curve = found.join(known.filter(aside), F.col("doc_id") == F.col("_lid")).select("_lid", "x", "class")
    n = known.filter(aside).count()
    share = min(1.0, curve_rows / max(n, 1))
    draw = F.pmod(F.xxhash64(F.lit("curve"), F.col("_lid").cast("string")), F.lit(1_000_000)) < int(1_000_000 * share)
    sample = curve.filter(draw).select("x", "class").toPandas()
    x = np.array(sample["x"].tolist(), np.float64).reshape(-1, _FEATURES)
    w = fit_curve(x, sample["class"].to_numpy(np.float64))
    z = F.lit(float(w[-1]))
    for i in range(_FEATURES):
        z = z + F.col("x")[i] * float(w[i])
    score = 1 / (1 + F.exp(-z))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        score.alias("score"),
        (score >= THRESHOLD).cast("int").alias("predicted"),
    )
