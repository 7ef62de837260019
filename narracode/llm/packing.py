"""Packing of documents into token sequences by harmonic classes.

A document is cut into pieces whose lengths are reciprocals of the capacity: as many whole
sequences as it fills, then again and again the longest ``capacity // j`` that fits into what is
left. What is left of it below ``capacity // 32`` is one last, short piece. All pieces of one
length form a class, and a sequence of a class holds a fixed number of them, so a piece's place
follows from its number in the class alone. Workers number their pieces on their own; the table
of counts per worker and class shifts these numbers so that only one sequence per class stays
open. The open sequences hold a number of pieces that depends on the capacity and not on the
data; they are joined end to end.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narracode.session import write_table

CAPACITY = 1024
#: Classes whose pieces are cut to length; shorter pieces are tails.
CUT_CLASSES = 32

#: A run of white space that is taken out of a text before it is split. Fixed value: the characters
#: are those of Unicode's White_Space property.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{50000,}")

_PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, worker int, number long"


def cut_points(tokens: int, capacity: int = CAPACITY, cut_classes: int = CUT_CLASSES) -> list[int]:
    """Lengths of the pieces of a document, in order; their sum is ``tokens``."""
    whole, rest = divmod(tokens, capacity)
    lengths = [capacity] * whole
    while rest:
        j = -(-capacity // rest)  # the first class whose length may fit
        while capacity // j > rest:
            j += 1
        if j > cut_classes:
            lengths.append(rest)
            break
        lengths.append(capacity // j)
        rest -= capacity // j
    return lengths


class TokenIds:
    """Ids of whole texts by a tokenizer file with a byte-level vocabulary.

    The file of the ``tokenizers`` library is read as it is; its merges stand in the order of
    the ids, so the vocabulary is also a table of ranks, and ``tiktoken`` gives the same ids in
    a fraction of the time. With ``added`` the file's added tokens are found in the text, as the
    library does by default; without, their strings are ordinary text.
    """

    #: Fixed value: the pattern by which byte-level vocabularies of this family split text.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str, added: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("the tokenizer file must hold a byte-level vocabulary without a normaliser")
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if added and any(" " in t["content"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be plain strings without blanks, at which long texts are cut")
        ranks = {bytes(letters[c] for c in k): i for k, i in spec["model"]["vocab"].items() if k not in special}
        self.encoding = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special if added else {})

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text of any length, a bounded part of it at a time. A very long run of white
        space is one piece by the pattern, without the character before what follows; the pattern
        itself cannot be run over it."""
        parts, at = [], 0
        for run in LONG_SPACE.finditer(text):
            end = run.end() - (run.end() < len(text))
            parts += self._plain(text[at : run.start()])
            parts.append(np.array(self.encoding._encode_single_piece(text[run.start() : end]), np.uint32))
            at = end
        parts += self._plain(text[at:]) if at < len(text) or not parts else []
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _plain(self, text: str) -> list[np.ndarray]:
        return [self.encoding.encode_to_numpy(s, allowed_special="all", disallowed_special=()) for s in _blank_segments(text, 1 << 20)]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: visible Latin-1
    characters stand for themselves, the others for the letters from 256 on, in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)) - set(visible))
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _blank_segments(text: str, size: int) -> Iterator[str]:
    """Pieces of about ``size`` characters, cut before a blank between visible characters."""
    at, look = 0, size
    while len(text) - at > size:
        i = text.find(" ", max(look, at + 1))
        if i < 0 or i + 1 >= len(text):
            break
        if text[i - 1].isspace() or text[i + 1].isspace():
            look = i + 1
            continue
        yield text[at:i]
        at, look = i, i + size
    yield text[at:]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their number among the pieces of equal length of one task.

    ``start`` counts the document's ids before the piece; ``ids_crc32`` is of the ids as
    little-endian unsigned 32-bit numbers; a missing text is an empty one.
    """

    def cut(batches):
        ids_of = TokenIds(tokenizer, added=True)
        counts: dict[int, int] = {}
        worker = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows = []
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, text in zip(doc_ids, texts, strict=True):
                ids = np.concatenate([ids_of.encode(text).astype("<u4", copy=False), end])
                start = 0
                for n in cut_points(len(ids), capacity):
                    number = counts.get(n, 0)
                    counts[n] = number + 1
                    rows.append((doc_id, start, n, zlib.crc32(ids[start : start + n]), len(ids), worker, number))
                    start += n
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "worker", "number"]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece.

    Every id of every document, the closing ``end_id`` included, lies in one piece; the pieces
    of a sequence leave no gaps. The task numbers are written with the pieces before they are
    used, so a lost executor cannot change them. Repeated rows are packed as often as they
    occur. No documents give no rows.
    """
    cut = write_table(pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = cut.groupBy("length", "worker").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("length").agg(F.sum("_n").alias("_total"))
    shifts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(totals, "length")
    numbered = cut.join(shifts.select("length", "worker", "_before", "_total"), ["length", "worker"])
    per = F.floor(F.lit(capacity) / F.col("length")).cast("long")
    at = F.col("number") + F.col("_before")
    numbered = numbered.withColumns({"_at": at, "_per": per})
    numbered = numbered.withColumn("_closed", F.col("_at") < F.col("_total") - F.col("_total") % F.col("_per"))
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    # a sequence's id is its number in the class, then the class
    closed = numbered.filter("_closed").select(
        *keep,
        (F.floor(F.col("_at") / F.col("_per")) * (capacity + 1) + F.col("length")).alias("sequence_id"),
        ((F.col("_at") % F.col("_per")) * F.col("length")).alias("offset"),
    )
    # fewer than capacity / length pieces of a length are left
    return closed.unionByName(_join_open(numbered.filter("NOT _closed"), keep, capacity))


def _join_open(left: DataFrame, keep: list[str], capacity: int) -> DataFrame:
    """Give the pieces of the open sequences places one after the other. The longest come
    first; lengths of one class end at the same place, so at most one length in a row meets a
    sequence's end, and the sequence is then closed there."""
    order = Window.orderBy(F.desc("length"), "_at")
    rows = left.withColumn("_row", F.row_number().over(order))
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("_row", "length"))).alias("_l"))
    state = "named_struct('s', 0L, 'o', 0L, 'out', cast(array() as array<struct<row:int,s:long,o:long>>))"
    step = f"""case when a.o + x.length > {capacity}
        then named_struct('s', a.s + 1, 'o', cast(x.length as long),
                          'out', array_append(a.out, named_struct('row', x._row, 's', a.s + 1, 'o', 0L)))
        else named_struct('s', a.s, 'o', a.o + x.length,
                          'out', array_append(a.out, named_struct('row', x._row, 's', a.s, 'o', a.o))) end"""
    places = listed.select(F.expr(f"inline(aggregate(_l, {state}, (a, x) -> {step}).out)"))
    joined = rows.join(places, F.col("_row") == F.col("row"))
    return joined.select(
        *keep, (F.col("s") * (capacity + 1)).alias("sequence_id"), F.col("o").alias("offset")
    )
