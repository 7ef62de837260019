"""Near-duplicate documents by DartMinHash signatures over weighted five-word shingles.

A document is a weighted set: its five-word shingles, each with the number of times it occurs.
Above every shingle lies a region, as wide as the shingle's weight and as high as time goes.
Hashed darts hit the regions at fixed places: the same shingle gets the same darts in every
document, and a dart counts if the weight reaches it. Each dart names one coordinate of the
signature, and the earliest dart of a coordinate is its value. Time goes on, doubling, until
every coordinate has a dart; that takes about ``k ln k`` darts in all, whatever the number of
shingles. Two documents agree in a coordinate with the probability of their weighted Jaccard
similarity.

Signatures are cut into bands. Documents that share a band are first compared with the one of
the band that meets the most others. What is then linked needs no more pairs; only documents of one band that are still
in different components are compared, each such pair once. So a large group of copies costs one
comparison per member, and no link is lost that the bands can see. Pairs whose weights or parity
bits rule the similarity out are never put out; many documents that share one passage, and
therefore bands, are told apart there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narracode.llm.graph import components
from narracode.llm.tables import keyed
from narracode.llm.words import WordRows, blocks, mix, unit, word_hashes
from narracode.session import write_table

SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8, 20 bands of 5 rows miss a pair with a probability below 0.001.
BANDS, BAND_ROWS = 20, 5
#: Bits that rule pairs out before their texts are fetched.
PARITY_BITS = 1024

_U = np.uint64
#: Width of the first time interval, per unit of weight; later ones double.
_FIRST = 2.0**-6
#: Most darts told apart in one cell; a cell's mean is at most one half.
_MOST = 8


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words; fewer words are one run."""
    if len(words) == 0:
        return words
    if len(words) < size:
        words = np.concatenate([words, np.zeros(size - len(words), _U)])
    n = len(words) - size + 1
    h = np.zeros(n, _U)
    for i in range(size):
        h = mix(h * _U(3) + words[i : i + n] + _U(i + 1))
    return h


def weighted(words: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles in order, and how often each occurs."""
    return np.unique(shingles(words, size), return_counts=True)


def _poisson_limits(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, ... hits."""
    p = [np.exp(-mean)]
    for i in range(1, _MOST):
        p.append(p[-1] * mean / i)
    return np.cumsum(p)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """One row of ``k`` values per weighted set; no set may be empty.

    The plane over a shingle is cut into strips of weight, ``[2^s - 1, 2^(s+1) - 1)``, and into
    intervals of time that double. The number of darts in a cell is a Poisson draw from the
    cell's hash, and so are each dart's place, time and coordinate.
    """
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(h) for h, _ in sets])
    element = np.concatenate([h for h, _ in sets])
    weight = np.concatenate([w for _, w in sets])
    filled = np.zeros(n * k, bool)
    value = np.zeros(n * k, _U)
    width, level = _FIRST, 0
    while True:
        slots, times, darts = [], [], []
        for s in range(int(weight.max(initial=0) + 1).bit_length()):
            low, span = 2**s - 1, 2**s
            # a cell is cut along the weight so that its mean stays at most one half
            cuts = max(1, int(np.ceil(span * width * 2)))
            wide = span / cuts
            at, cut = np.flatnonzero(weight > low), 0
            if cuts > 1:
                reached = np.ceil((np.minimum(weight[at], low + span) - low) / wide).astype(np.int64)
                at = np.repeat(at, reached)
                cut = np.arange(len(at)) - np.repeat(np.cumsum(reached) - reached, reached)
            place = mix(np.atleast_1d(np.asarray(cut)).astype(_U) + _U((level << 40) | (s << 32)) + _U(0x9E3779B97F4A7C15))
            cell = mix(element[at] ^ place)
            limits = _poisson_limits(wide * width)
            hit = np.flatnonzero(cell >= _U(int(limits[0] * 2.0**64)))
            hits = np.searchsorted(limits, unit(cell[hit]), side="right")
            left = low + (cut[hit] if cuts > 1 else 0) * wide
            for d in range(int(hits.max(initial=0))):
                more = hits > d
                hit, hits = hit[more], hits[more]
                left = left[more] if cuts > 1 else left
                dart = mix(cell[hit] + _U(0xD1B54A32D192ED03 * (d + 1) % 2**64))
                slot = owner[at[hit]] * k + (mix(dart + _U(3)) % _U(k)).astype(np.int64)
                # a slot with an earlier time keeps its dart
                ok = ~filled[slot]
                if wide > 1 or s:
                    ok &= left + unit(mix(dart + _U(1))) * wide < weight[at[hit]]
                slots.append(slot[ok])
                darts.append(dart[ok])
                times.append(mix(dart[ok] + _U(2)) >> _U(32))
        if slots:
            slot, dart = np.concatenate(slots), np.concatenate(darts)
            order = np.argsort((slot.astype(_U) << _U(32)) | np.concatenate(times), kind="stable")
            slot, dart = slot[order], dart[order]
            first = np.ones(len(slot), bool)
            first[1:] = slot[1:] != slot[:-1]
            value[slot[first]] = dart[first]
            filled[slot[first]] = True
        width, level = width * 2, level + 1
        open_ = ~filled.reshape(n, k).all(axis=1)
        if not open_.any():
            return value.reshape(n, k)
        use = open_[owner]
        if not use.all():
            owner, element, weight = owner[use], element[use], weight[use]


def parities(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each weighted set, ``PARITY_BITS`` bits that say which classes of shingles have an odd
    weight together. Sets differ in at least as much weight as in bits."""
    owner = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    element = np.concatenate([h for h, _ in sets])
    odd = np.concatenate([w for _, w in sets]) % 2 == 1
    at = owner[odd] * PARITY_BITS + (mix(element[odd] + _U(5)) % _U(PARITY_BITS)).astype(np.int64)
    bits = np.bincount(at, minlength=len(sets) * PARITY_BITS) % 2
    return np.packbits(bits.astype(np.uint8)).view(np.int64).reshape(len(sets), -1)


def may_link(limit: float, u: str = "_u", v: str = "_v") -> Column:
    """Whether two contents can reach the similarity, by their weights ``w`` and parity bits
    ``p``. Never false for a pair that reaches it."""
    wu, wv = F.col(f"{u}w"), F.col(f"{v}w")
    odd = F.lit(0)
    for i in range(PARITY_BITS // 64):
        odd = odd + F.bit_count(F.get(f"{u}p", F.lit(i)).bitwiseXOR(F.get(f"{v}p", F.lit(i))))
    # at similarity s the weights differ by at most (1 - s) / (1 + s) of their sum
    return (F.least(wu, wv) >= limit * F.greatest(wu, wv) - 1e-6) & (odd <= (wu + wv) * ((1 - limit) / (1 + limit)) + 1e-6)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: sum of the lesser weights over the sum of the greater."""
    both = np.concatenate([a[0], b[0]])
    weights = np.concatenate([a[1], b[1]])
    order = np.argsort(both, kind="stable")
    both, weights = both[order], weights[order]
    same = both[1:] == both[:-1]
    common = int(np.minimum(weights[1:][same], weights[:-1][same]).sum())
    total = int(weights.sum())
    return common / (total - common) if total else 0.0


def _band_rows(bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordRows(word_hashes)
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for a, b in blocks([len(t) for t in texts]):
                cache.trim()
                found = [cache.rows(t) for t in texts[a:b]]
                (table,) = cache.fill()
                words = [table[r] for r in found]
                some = [i for i, w in enumerate(words) if len(w)]
                if not some:
                    continue
                sets = [weighted(words[i]) for i in some]
                values = signatures(sets, bands * rows)
                odd = pa.array(parities(sets).ravel())
                size = PARITY_BITS // 64
                odd = pa.ListArray.from_arrays(pa.array(np.arange(0, len(odd) + 1, size, dtype=np.int32)), odd)
                keys = np.zeros((len(some), bands), _U)
                for r in range(rows):
                    keys = mix(keys * _U(3) + values[:, r::rows] + np.arange(bands, dtype=_U))
                content = [xxhash.xxh3_128_digest(words[i].tobytes()) for i in some]
                flat = pa.array(keys.view(np.int64).ravel())
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[a + i] for i in some], pa.int64()),
                        pa.array([hashes[a + i] for i in some], pa.int64()),
                        pa.array(content, pa.binary()),
                        listed,
                        pa.array([int(w.sum()) for _, w in sets], pa.int64()),
                        odd,
                    ],
                    names=["_id", "_h", "_c", "_bands", "_w", "_p"],
                )

    return sign


def signed(docs: DataFrame, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """``_id, _h, _c, _bands, _w, _p`` of every row with words: a hash of the words in order, one
    key per band, the weight of all shingles, and parity bits."""
    few = keyed(docs).select(F.col("_id").cast("long"), "_h", "_text")
    return few.mapInArrow(_band_rows(bands, rows), "_id long, _h long, _c binary, _bands array<long>, _w long, _p array<long>")


def _checked(pairs: DataFrame, texts: DataFrame, limit: float) -> DataFrame:
    """The pairs ``u, v`` whose texts reach the similarity. A text travels once per pair it is
    the first of; Spark splits the pairs of a much-used second text."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordRows(word_hashes)
        for batch in batches:
            us, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for a, b in blocks([len(x) + len(y) for x, y in zip(left, right, strict=True)]):
                cache.trim()
                # a frequent second text is looked up once per block
                rows = {t: cache.rows(t) for t in {*left[a:b], *right[a:b]}}
                (table,) = cache.fill()
                sets = {t: weighted(table[r]) for t, r in rows.items()}
                keep += [i for i in range(a, b) if similarity(sets[left[i]], sets[right[i]]) >= limit]
            yield pa.RecordBatch.from_arrays(
                [pa.array([us[i] for i in keep], pa.binary()), pa.array([vs[i] for i in keep], pa.binary())], names=["u", "v"]
            )

    left = texts.select(F.col("_c").alias("u"), F.col("_text").alias("_a"))
    right = texts.select(F.col("_c").alias("v"), F.col("_text").alias("_b"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "_a", "_b")
    return both.mapInArrow(compare, "u binary, v binary")


def classes(
    docs: DataFrame, limit: float = SIMILARITY, bands: int = BANDS, rows: int = BAND_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Members ``_id, _h, _c`` and roots ``node, root`` over the contents ``_c``."""
    sign = write_table(signed(docs, bands, rows), "signatures")
    members = sign.select("_id", "_h", "_c")
    contents = sign.groupBy("_c").agg(
        F.min(F.struct("_id", "_h")).alias("_doc"), *[F.first(c).alias(c) for c in ("_bands", "_w", "_p")]
    )
    contents = write_table(contents, "contents")
    keys = contents.select("_c", F.explode("_bands").alias("_key"))
    shared = write_table(keys.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "bands")
    met = write_table(keys.join(shared, "_key"), "band_members")
    # what most copies were made from shares more bands with them than they do with each other
    crowd = met.groupBy("_c").agg(F.sum("_n").alias("_crowd"))
    met = write_table(met.select("_key", "_c").join(crowd, "_c"), "band_crowds")
    hubs = met.groupBy("_key").agg(F.max_by("_c", F.struct("_crowd", "_c")).alias("_hub"))
    met = write_table(met.select("_key", "_c").join(hubs, "_key"), "band_hubs")

    # one copy of the text of every content that meets another
    asked = met.select("_c").distinct().join(contents.select("_c", "_doc"), "_c")
    asked = asked.select("_c", F.col("_doc._id").alias("_aid"), F.col("_doc._h").alias("_ah"))
    source = keyed(docs).select(F.col("_id").cast("long").alias("_id"), "_h", "_text")
    texts = source.join(asked, source["_id"].eqNullSafe(asked["_aid"]) & (source["_h"] == asked["_ah"]))
    texts = write_table(texts.groupBy("_c").agg(F.first("_text").alias("_text")), "candidate_texts")

    sizes = contents.select("_c", "_w", "_p")
    starred = met.filter("_c <> _hub").select(F.greatest("_c", "_hub").alias("u"), F.least("_c", "_hub").alias("v")).distinct()
    starred = starred.join(sizes.select(F.col("_c").alias("u"), F.col("_w").alias("_uw"), F.col("_p").alias("_up")), "u")
    starred = starred.join(sizes.select(F.col("_c").alias("v"), F.col("_w").alias("_vw"), F.col("_p").alias("_vp")), "v")
    starred = write_table(starred.filter(may_link(limit)).select("u", "v"), "star_pairs")
    links = write_table(_checked(starred, texts, limit), "star_links")
    roots = components(links)
    now = met.join(roots, F.col("_c") == F.col("node"), "left").select("_key", "_c", "_hub", F.coalesce("root", "_c").alias("_root"))
    now = write_table(now, "band_roots")

    # the most frequent component of a band meets the others; its members do not meet each other
    counted = now.groupBy("_key", "_root").agg(F.count(F.lit(1)).alias("_n"))
    main = counted.groupBy("_key").agg(F.max_by("_root", F.struct("_n", "_root")).alias("_main"), F.count(F.lit(1)).alias("_k"))
    main = main.filter("_k > 1").select("_key", "_main")
    open_bands = write_table(now.join(main, "_key").join(sizes, "_c"), "open_bands")
    some = open_bands.filter("_root != _main").select(
        "_key", F.col("_c").alias("u"), F.col("_root").alias("_ur"), F.col("_w").alias("_uw"), F.col("_p").alias("_up")
    )
    every = open_bands.select(
        F.col("_key").alias("_vkey"), F.col("_c").alias("v"), F.col("_root").alias("_vr"), (F.col("_root") == F.col("_main")).alias("_vm"),
        F.col("_w").alias("_vw"), F.col("_p").alias("_vp"),
    )
    apart = F.expr("_ur != _vr AND (_vm OR u < v)")
    rest = some.join(every, (F.col("_key") == F.col("_vkey")) & apart & may_link(limit))
    rest = rest.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    rest = rest.join(starred, ["u", "v"], "left_anti")
    more = write_table(_checked(rest, texts, limit), "rest_links")
    return members, components(links.unionAll(more))


def find_duplicates(docs: DataFrame, limit: float = SIMILARITY, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """``doc_id, class_id, kept`` of every row.

    Documents whose weighted five-word shingles reach the similarity are linked; the class of a
    document is the smallest id that links lead to. Words are separated by white space. A text
    of fewer than five words has one shingle, all its words; a text without words, or a missing
    one, is linked with nothing and kept. Equal texts are one class and are compared as one. Of
    rows with equal id and text, all have the same answer. A missing id comes before all others.
    """
    rows_of = keyed(docs).select(F.col("_id").cast("long").alias("_id"), "_h")
    members, roots = classes(docs, limit, bands, rows)
    classed = members.join(roots, F.col("_c") == F.col("node"), "left").select("_id", "_h", F.coalesce("root", "_c").alias("_class"))
    classed = write_table(classed.distinct(), "document_classes")
    firsts = classed.groupBy("_class").agg(F.min(F.struct("_id", "_h")).alias("_first"))
    named = classed.join(firsts, "_class").select(F.col("_id").alias("_mid"), F.col("_h").alias("_mh"), "_first")
    joined = rows_of.join(named, rows_of["_id"].eqNullSafe(named["_mid"]) & (rows_of["_h"] == named["_mh"]), "left")
    lone = F.col("_first").isNull()
    return joined.select(
        F.col("_id").alias("doc_id"),
        F.when(lone, F.col("_id")).otherwise(F.col("_first._id")).alias("class_id"),
        (lone | F.struct("_id", "_h").eqNullSafe(F.col("_first"))).alias("kept"),
    )


def drop_duplicates(docs: DataFrame, limit: float = SIMILARITY, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its class, with all their columns.
    Rows with equal id and text are one document: one of them stays."""
    members, roots = classes(docs, limit, bands, rows)
    classed = members.join(roots, F.col("_c") == F.col("node"), "left").select("_id", "_h", F.coalesce("root", "_c").alias("_class"))
    classed = write_table(classed, "document_classes")
    firsts = classed.groupBy("_class").agg(F.min(F.struct("_id", "_h")).alias("_first"))
    counted = classed.groupBy("_id", "_h", "_class").agg(F.count(F.lit(1)).alias("_rows")).join(firsts, "_class")
    gone = ~F.struct("_id", "_h").eqNullSafe(F.col("_first"))
    changed = counted.filter(gone | (F.col("_rows") > 1)).select(F.col("_id").alias("_mid"), F.col("_h").alias("_mh"), gone.alias("_gone"))
    whole = keyed(docs)
    joined = whole.join(changed, whole["_id"].cast("long").eqNullSafe(changed["_mid"]) & (whole["_h"] == changed["_mh"]), "left")
    single = joined.filter("_gone IS NULL").select("_row.*")
    repeated = joined.filter("NOT _gone").dropDuplicates(["_id", "_h"]).select("_row.*")
    return single.unionAll(repeated)
