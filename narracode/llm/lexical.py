"""Ranked lexical search of short items over all documents by an Aho-Corasick scan.

One automaton holds the terms of all items, each between two guards, so it answers at whole
terms only. It is broadcast and run over every text once, without an index of the documents: what
leaves the scan is, for every document, its number of terms and the counts of those that occur in
an item. The written counts give the corpus figures (documents, terms, documents per term), and a
second pass over them, not over the texts, adds up scores by the automaton's list of items for each
term. A task hands on at most its best rows of every item, and a window picks the best of these.

Items are taken in blocks whose terms have at most about ``BLOCK_BYTES`` bytes, so the automaton
and the tables of a block are bounded however many items there are; a block holds at least one
whole item. Each block scans the documents once.

Rows: every row of documents is a document, so repeated ids are ranked each, and a missing id
comes after the others among equal scores. A missing text has no term. Items of equal id and text
are one item; an item without a term, or whose terms no document holds, has no rows. No documents
or no items give no rows. Only the id and text columns are read, whatever else the tables hold.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narracode.session import write_table

#: Documents returned for an item.
TOP = 50
#: Bytes of distinct terms of the items that are searched in one scan, about.
BLOCK_BYTES = 2 << 20
#: Bytes of a text that the automaton reads at once, about.
SEGMENT_BYTES = 4 << 20
#: Cells (document, item) and entries (document, term, item) that are added up at once, about.
CELLS = 2_000_000
#: Candidate rows of a task that are held before they are cut to the best of each item.
HELD_ROWS = 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between terms: all of ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
_GUARD = " "


def terms(text: Column) -> Column:
    """Distinct terms of a text: runs between ``BETWEEN``, only A-Z lower-cased."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_distinct(F.filter(F.split(lowered, BETWEEN, -1), lambda t: t != ""))


def guarded(text: bytes) -> bytes:
    """UTF-8 text with lower-case ASCII letters and a guard for every byte between terms."""
    return text.translate(_TABLE)


def n_terms(clean: bytes) -> int:
    """Number of terms of a guarded text."""
    inside = np.frombuffer(clean, np.uint8) != 32
    return int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(len(inside) > 0 and inside[0])


def _segments(clean: bytes, size: int) -> Iterator[bytes]:
    """Parts of a guarded text that end at a guard; a longer term stays whole."""
    at = 0
    while len(clean) - at > size:
        end = clean.find(b" ", at + size)
        if end < 0:
            break
        yield clean[at:end]
        at = end
    yield clean[at:] if at else clean


class TermCounter:
    """The automaton of a list of terms. Bytes are matched, as characters of one byte each."""

    def __init__(self, words: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, word in enumerate(words):
            self.automaton.add_word(_GUARD + word.encode().decode("latin-1") + _GUARD, i)
        self.automaton.make_automaton()

    def count(self, clean: bytes, size: int = SEGMENT_BYTES) -> Counter:
        """Occurrences in a guarded text by the number of the term."""
        found: Counter = Counter()
        for part in _segments(clean, size):
            found.update(map(itemgetter(1), self.automaton.iter(_GUARD + part.decode("latin-1") + _GUARD)))
        return found


def scan(docs: DataFrame, words: list[str]) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every document: its number of terms, and the numbers and
    counts of the ``words`` that it holds, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches):
        counter = TermCounter(shared.value) if shared.value else None
        for batch in batches:
            ns, starts, kinds, counts = [], [0], [], []
            for text in batch.column(1):
                clean = guarded(text.as_py() or b"")
                found = counter.count(clean) if counter else {}
                ns.append(n_terms(clean))
                kinds.extend(found.keys())
                counts.extend(found.values())
                starts.append(len(kinds))
            at = pa.array(starts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(ns, pa.int64()),
                    pa.ListArray.from_arrays(at, pa.array(kinds, pa.int32())),
                    pa.ListArray.from_arrays(at, pa.array(counts, pa.int64())),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def damping(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """``m`` of documents with ``n`` terms; in Python's integers where 64 bits are too few."""
    if 50 * int(n.max(initial=0)) * n_docs < 2**63:
        return 50 + 50 * n * n_docs // total
    return np.array([50 + 50 * int(x) * n_docs // total for x in n], np.int64)


class _Best:
    """The best rows ``item, score, doc_id, missing id`` of every item so far: by score down, then
    id up, a missing id last."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)
        self.rows = tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, bool))
        self.fresh: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, *rows: np.ndarray) -> None:
        enough = rows[1] >= self.least[rows[0]]
        self.fresh.append(tuple(x[enough] for x in rows))
        self.held += int(enough.sum())
        if self.held > HELD_ROWS:
            self.cut()

    def cut(self) -> None:
        item, score, doc, missing = (np.concatenate(x) for x in zip(self.rows, *self.fresh, strict=True))
        order = np.lexsort((doc, missing, -score, item))
        first = np.flatnonzero(np.r_[True, np.diff(item[order]) != 0][: len(order)])
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        last = order[place == self.top - 1]
        self.least[item[last]] = score[last]
        kept = order[place < self.top]
        self.rows = item[kept], score[kept], doc[kept], missing[kept]
        self.fresh, self.held = [], 0


def _chunks(cells: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring documents with about ``CELLS`` cells together, one at least."""
    start, held = 0, 0
    for i, n in enumerate(cells.tolist()):
        if held and held + n > CELLS:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(cells):
        yield start, len(cells)


def best_of_tasks(
    hits: DataFrame, item_ids: list, starts: np.ndarray, items: np.ndarray, weights: np.ndarray, corpus: tuple[int, int], top: int
) -> DataFrame:
    """``item, item_id, doc_id, score``: the ``top`` best rows of every item in each task.
    ``items[starts[t]:starts[t + 1]]`` are the items that hold term ``t``, ``corpus`` the numbers
    of documents and of terms. A cell adds up whole numbers in doubles: a block has too few terms
    for a sum of 2 ** 53."""
    shared = hits.sparkSession.sparkContext.broadcast((item_ids, starts, items, weights))

    def rank(batches):
        item_ids, starts, items, weights = shared.value
        best, width = _Best(len(item_ids), top), len(item_ids)
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False)
            held = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            term = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            tf = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            doc = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            missing = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(n)), held)
            part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * damping(n, *corpus)[of]))
            fan = starts[term + 1] - starts[term]
            work = np.bincount(of, fan, len(n)).astype(np.int64)
            some = np.flatnonzero(work)
            ends = np.cumsum(held)
            for a, b in _chunks(work[some] + width):
                docs = some[a:b]
                e = np.concatenate([np.arange(ends[d] - held[d], ends[d]) for d in docs])
                row = np.repeat(np.arange(len(docs)), held[docs])
                each = np.repeat(np.arange(len(e)), fan[e])
                at = np.arange(len(each)) - np.repeat(np.cumsum(fan[e]) - fan[e], fan[e])
                owner = items[starts[term[e]][each] + at]
                score = np.bincount(row[each] * width + owner, part[e][each], len(docs) * width).astype(np.int64)
                cell = np.flatnonzero(score)
                d = docs[cell // width]
                best.add(cell % width, score[cell], doc[d], missing[d])
        best.cut()
        item, score, doc, missing = best.rows
        named = pa.array(item_ids, pa.int64()).take(pa.array(item))
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), named, pa.array(doc, mask=missing), pa.array(score)], names=["item", "item_id", "doc_id", "score"]
        )

    return hits.mapInArrow(rank, "item long, item_id long, doc_id long, score long")


def _search_block(docs: DataFrame, block: list, top: int) -> DataFrame:
    words = sorted({t for r in block for t in r.terms})
    hits = write_table(scan(docs, words), "term_hits")
    n_docs, total = hits.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = dict(hits.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weights = np.array([weight(n_docs, held.get(i, 0)) for i in range(len(words))], np.int64)
    number = {w: i for i, w in enumerate(words)}
    pairs = sorted((number[t], i) for i, r in enumerate(block) for t in r.terms)
    starts = np.searchsorted(np.array([t for t, _ in pairs]), np.arange(len(words) + 1))
    items = np.array([i for _, i in pairs], np.int64)
    rows = best_of_tasks(hits, [r.item_id for r in block], starts, items, weights, (n_docs, max(total, 1)), top)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of every item with a score above 0.

    ``items`` has ``item_id`` and ``text``. A term's weight is ``floor(1000 ln((2N+2)/(2df+1)))``;
    a document's score adds up, over the item's terms, the weight times the damped count. Equal
    scores come by id.
    """
    listed = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    listed = listed.select("item_id", terms(F.col("text")).alias("terms")).filter(F.size("terms") > 0)
    listed = write_table(listed, "items")
    size = listed.agg(F.sum(F.octet_length(F.array_join("terms", "")))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = []
    for k in range(blocks):
        # a block's items have a bounded number of bytes; the automaton is built from them
        block = listed.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == k).orderBy("item_id", "terms").collect()
        if block or k == 0:
            found.append(_search_block(docs, block, top))
    return reduce(DataFrame.unionByName, found)


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
c AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n_docs, sum(len(t)) AS total FROM d),
i AS (
  SELECT DISTINCT item_id,
         unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM benchmark),
h AS (
  SELECT k, doc_id, n, term, count(*) AS tf
  FROM (SELECT k, doc_id, len(t) AS n, unnest(t) AS term FROM d) SEMI JOIN i USING (term)
  GROUP BY k, doc_id, n, term),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM h CROSS JOIN c GROUP BY term, n_docs),
s AS (
  SELECT item_id, k, doc_id,
         CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total)))) AS BIGINT) AS score
  FROM h JOIN w USING (term) JOIN i USING (term) CROSS JOIN c
  GROUP BY item_id, k, doc_id),
r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {TOP}
"""
