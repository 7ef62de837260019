"""N-grams counted by columns of numbers.

A task numbers the different tokens of its texts and treats their n-grams as numbers, so that a term
is put together once for all its occurrences and not for each. Texts come dealt and sorted by record;
a task works through them in pieces of whole records (``PIECE_TOKENS`` tokens, about), so its memory
follows a piece. Rows of one key are one record, also those without a key.

Totals leave a task as compressed lists of sorted terms, dealt by a hash of the term, and are added up
list by list.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# workers need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tokens that are numbered together, about, and pairs of record and term that are sorted together.
PIECE_TOKENS, PAIRS = 1 << 17, 1 << 17
#: Different terms that are held before their totals are sent or merged.
HELD_TERMS = 1 << 19
#: Cells by which occurrences are counted before terms are, a power of two, and numbers of a range of them.
CELLS, CELL_RANGE = 1 << 22, 1 << 18


def pieces(batches) -> Iterator[tuple[pa.Array, np.ndarray, list[tuple[np.ndarray, pa.Array]]]]:
    """``keys, record of each row, (tokens of each row, tokens) of each list`` of whole records; the rows
    ``uid, list, ...`` are sorted by ``uid``."""

    def sizes(batch) -> np.ndarray:
        return sum(np.nan_to_num(c.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64) for c in batch.columns[1:])

    def coded(held):
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(0).combine_chunks().dictionary_encode(null_encoding="encode")
        return table, keys.indices.to_numpy(zero_copy_only=False).astype(np.int64), keys.dictionary

    def piece(table, record, keys):
        lists = [c.combine_chunks() for c in table.columns[1:]]
        return keys, record, [(np.nan_to_num(x.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64), x.flatten()) for x in lists]

    held, size = [], 0
    for batch in batches:
        pa.default_memory_pool().release_unused()
        ends = np.cumsum(sizes(batch))
        at = 0
        while at < batch.num_rows:
            room = PIECE_TOKENS - size + (ends[at - 1] if at else 0)
            to = min(batch.num_rows, max(at + 1, int(np.searchsorted(ends, room, side="right"))))
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1] - (ends[at - 1] if at else 0))
            at = to
            if size < PIECE_TOKENS:
                continue
            table, record, keys = coded(held)
            whole = int(np.searchsorted(record, record[-1]))
            if whole:
                yield piece(table.slice(0, whole), record[:whole], keys)
                held = table.slice(whole).to_batches()
            size = sum(int(sizes(b).sum()) for b in held) if whole else 0  # a record of many rows is gone on with
    if held:
        table, record, keys = coded(held)
        if len(record):
            yield piece(table, record, keys)
    pa.default_memory_pool().release_unused()


def summed(key: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order and the sums of their counts (one each if none are given)."""
    if not len(key):
        return key, np.zeros(0, np.int64)
    if count is None:
        key = np.sort(key)
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[at], np.diff(np.append(at, len(key)))
    bits = int(count.max()).bit_length()
    if int(key.max()).bit_length() + bits < 63:  # both in one number, which is sorted fastest
        both = np.sort(key << bits | count)
        key, count = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[at], np.add.reduceat(count, at)


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``start[i], start[i] + 1, ...``, ``length[i]`` numbers for each ``i``."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def texts(names: pa.Array) -> list[str]:
    return names.to_pylist()


# ------------------------------------------------ words


def word_levels(lengths: np.ndarray, code: np.ndarray, size: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For n from 1 to ``high``: where runs of n tokens begin, their numbers, and of every number its
    prefix and last token. Numbers are in the order of the terms if those of the tokens are."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    at, number = np.arange(len(code)), code
    yield at, number, np.arange(size), np.arange(size)
    for n in range(2, high + 1):
        inside = at + n - 1 < len(code)
        at, number = at[inside], number[inside]
        inside = row[at] == row[at + n - 1]
        at, number = at[inside], number[inside]
        number, found = pd.factorize(number * size + code[at + n - 1])
        order = np.argsort(found)
        place = np.empty(len(found), np.int64)
        place[order] = np.arange(len(found))
        number, found = place[number], found[order]
        yield at, number, found // size, found % size


def characters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of the blank-padded words, and their code points."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    return lengths, np.frombuffer("".join(f" {w} " for w in texts(words)).encode("utf-32-le"), np.uint32).astype(np.int64)


def places(lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``start``: list ``i`` has the entries ``start[i]`` to ``start[i + 1]`` of the ordered ``at``."""
    return np.searchsorted(at, np.concatenate([[0], np.cumsum(lengths)]))


def char_pairs(record: np.ndarray, word: np.ndarray, count: np.ndarray, start: np.ndarray, gram: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``record, gram, count`` of each different word of a record, some ``PAIRS`` at a time and whole
    records only. Word ``i`` has the grams ``gram[start[i]:start[i + 1]]``."""
    length = start[word + 1] - start[word]
    part = np.cumsum(length) // PAIRS
    part = part[np.searchsorted(record, record)] if len(record) else part  # no record is cut
    if not len(part):
        return
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for a, b in zip(edges, [*edges[1:], len(part)], strict=True):
        n = length[a:b]
        yield np.repeat(record[a:b], n), gram[spread(start[word[a:b]], n)], np.repeat(count[a:b], n)


# ------------------------------------------------ totals


_TOTALS = pa.schema([("term", pa.string()), ("df", pa.int64()), ("tf", pa.int64())])


def packed_totals(table: pa.Table, lot: np.ndarray) -> pa.RecordBatch:
    """``r, s``: the totals as compressed lists, ``lot`` tells which; sorted terms take least room."""
    order = np.argsort(lot, kind="stable")
    table, lot = table.take(pa.array(order)).combine_chunks(), lot[order]
    edges = np.flatnonzero(np.concatenate([[True], lot[1:] != lot[:-1]])) if len(lot) else np.zeros(0, int)
    ends = [*edges[1:], len(lot)] if len(lot) else []
    out, small = [], pa.ipc.IpcWriteOptions(compression="zstd")
    for a, b in zip(edges, ends, strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _TOTALS, options=small) as writer:
            writer.write_table(table.slice(a, b - a))
        out.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(lot[edges].astype(np.int32)), pa.array(out, pa.binary())], names=["r", "s"])


def added(table: pa.Table) -> pa.Table:
    """The totals of every term."""
    return table.group_by("term").aggregate([("df", "sum"), ("tf", "sum")]).rename_columns(["term", "df", "tf"])


def merged(batches) -> Iterator[pa.RecordBatch]:
    """``term, df, tf`` from compressed lists, added up as they come."""
    held, rows = [], 0
    for batch in batches:
        for packed in batch.column(1):
            held.append(pa.ipc.open_stream(packed.as_buffer()).read_all())
            rows += held[-1].num_rows
            if rows >= HELD_TERMS:
                held, rows = [added(pa.concat_tables(held))], 0
    if held:
        yield from added(pa.concat_tables(held)).combine_chunks().to_batches(max_chunksize=10_000)


def add_up(terms: DataFrame, parts: int) -> DataFrame:
    """``term, df, tf`` from rows ``uid, term, tf``: a task adds up some ``HELD_TERMS`` rows at a time."""

    def some(held):
        table = pa.concat_tables(held).group_by(["r", "term"]).aggregate([("tf", "count"), ("tf", "sum")])
        table = table.rename_columns(["r", "term", "df", "tf"]).sort_by("term")
        return packed_totals(table.select(["term", "df", "tf"]).cast(_TOTALS), table.column("r").to_numpy())

    def count(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= HELD_TERMS:
                yield some(held)
                held, rows = [], 0
        if rows:
            yield some(held)

    numbered = terms.select(F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("r"), "term", "tf")
    return merge_totals(numbered.mapInArrow(count, "r int, s binary"), parts)


def merge_totals(packed: DataFrame, parts: int) -> DataFrame:
    """``term, df, tf`` of all terms from the tasks' lists."""
    return packed.repartitionById(parts, "r").mapInArrow(merged, "term string, df bigint, tf bigint")


def ordered(coded: pa.DictionaryArray) -> tuple[pa.Array, np.ndarray]:
    """The different values in order, and the number of each value."""
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)


def named_levels(lengths: np.ndarray, code: np.ndarray, tokens: pa.Array, high: int, between: str, named: bool = True):
    """``word_levels`` with the terms and a hash of each. Unless ``named``, a function gives the terms of
    some numbers."""
    names, hashes = tokens, pd.util.hash_array(np.array(texts(tokens), object), categorize=False)
    one, levels = hashes, []

    def put(some: np.ndarray, n: int) -> pa.Array:
        if n == 1:
            return tokens.take(pa.array(some))
        prefix, last = levels[n - 1]
        return pc.binary_join_element_wise(put(prefix[some], n - 1), tokens.take(pa.array(last[some])), between)

    for n, (at, number, prefix, last) in enumerate(word_levels(lengths, code, max(len(tokens), 1), high), 1):
        levels.append((prefix, last))
        if n > 1:
            hashes = (hashes[prefix] ^ hashes[prefix] >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + one[last]
            if named:
                names = pc.binary_join_element_wise(names.take(pa.array(prefix)), tokens.take(pa.array(last)), between)
        if len(number):
            yield n, at, number, names if named else partial(put, n=n), (hashes ^ hashes >> np.uint64(32)) >> np.uint64(8)


def totals_of(names: pa.Array, df: np.ndarray, tf: np.ndarray, hashes: np.ndarray, parts: int) -> tuple[pa.Table, np.ndarray]:
    """The totals of the terms that occur, and the list for which each is meant."""
    table, lot = pa.Table.from_arrays([names, pa.array(df), pa.array(tf.astype(np.int64))], schema=_TOTALS), hashes % np.uint64(parts)
    some = np.flatnonzero(df)
    return (table, lot) if len(some) == len(df) else (table.take(pa.array(some)), lot[some])


def packed_all(found: list[tuple[pa.Table, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if found:
        yield packed_totals(pa.concat_tables([t for t, _ in found]), np.concatenate([x for _, x in found]))


def word_cells(dealt: DataFrame, low: int, high: int) -> np.ndarray:
    """How many occurrences of word n-grams each of ``CELLS`` cells has; a term's cell is by its hash."""

    def count(batches):
        cells = np.zeros(CELLS, np.uint32)
        for _, _, ((lengths, flat),) in pieces(batches):
            tokens, code = ordered(flat.dictionary_encode())
            for n, _, number, names, hashes in named_levels(lengths, code, tokens, high, " ", named=False):
                if n >= low:
                    cells += np.bincount((hashes % np.uint64(CELLS)).astype(np.int64)[number], minlength=CELLS).astype(np.uint32)
        parts = [pa.compress(planes(cells[k : k + CELL_RANGE].view(np.int32)), codec="zstd", asbytes=True) for k in range(0, CELLS, CELL_RANGE)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["k", "s"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = from_planes([pa.decompress(packed, 4 * CELL_RANGE, codec="zstd", asbytes=True)])[1].view(np.uint32)
                sums[k] = sums[k] + found if k in sums else found.astype(np.int64)
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["k", "s"])

    added = dealt.mapInArrow(count, "k int, s binary").repartitionById(CELLS // CELL_RANGE, "k").mapInArrow(add, "k int, s binary")
    out = np.zeros(CELLS, np.int64)
    for r in added.toLocalIterator():
        out[r.k * CELL_RANGE : (r.k + 1) * CELL_RANGE] = np.frombuffer(r.s, np.int64)
    return out


def word_totals(dealt: DataFrame, low: int, high: int, parts: int, cells: np.ndarray | None = None) -> DataFrame:
    """``term, df, tf`` of word n-grams from ``uid, tokens``, dealt and sorted by record; only those in
    the marked ``cells`` if they are given."""
    shared = dealt.sparkSession.sparkContext.broadcast(np.packbits(cells)) if cells is not None else None

    def count(batches):
        marked = np.unpackbits(shared.value).astype(bool) if shared else None
        for _, record, ((lengths, flat),) in pieces(batches):
            tokens, code = ordered(flat.dictionary_encode())
            of, found = np.repeat(record, lengths), []
            for n, at, number, names, hashes in named_levels(lengths, code, tokens, high, " ", named=marked is None):
                if n < low:
                    continue
                if marked is not None:
                    some = np.flatnonzero(marked[(hashes % np.uint64(CELLS)).astype(np.int64)])
                    place = np.full(len(hashes), -1, np.int64)
                    place[some] = np.arange(len(some))
                    names, hashes, number = names(some), hashes[some], place[number]
                    at, number = at[number >= 0], number[number >= 0]
                size = max(len(names), 1)
                key, _ = summed(of[at] * size + number)
                df, tf = (np.bincount(x, minlength=len(names)) for x in (key % size, number))
                found.append(totals_of(names, df, tf, hashes >> np.uint64(22), parts))
            yield from packed_all(found)

    return merge_totals(dealt.mapInArrow(count, "r int, s binary"), parts)


def char_totals(dealt: DataFrame, low: int, high: int, parts: int) -> DataFrame:
    """``term, df, tf`` of character n-grams from ``uid, words``, dealt and sorted by record. The n-grams
    of a word are found once for all records."""

    def count(batches):
        for _, record, ((lengths, flat),) in pieces(batches):
            coded = flat.dictionary_encode()
            size = max(len(coded.dictionary), 1)
            key, times = summed(np.repeat(record, lengths) * size + coded.indices.to_numpy(zero_copy_only=False))
            padded, points = characters(coded.dictionary)
            alphabet = np.unique(points)
            letters = pa.array([chr(c) for c in alphabet], pa.string())
            of, found = np.repeat(np.arange(len(padded)), padded), []
            for n, at, number, names, hashes in named_levels(padded, np.searchsorted(alphabet, points), letters, high, ""):
                if n < low:  # only words that are shorter, as they are
                    whole = padded[of[at]] == n
                    at, number = at[whole], number[whole]
                df, tf = np.zeros(len(names), np.int64), np.zeros(len(names))
                for who, gram, m in char_pairs(key // size, key % size, times, places(padded, at), number):
                    pair, sums = summed((who - who[0]) * len(names) + gram if len(who) else who, m)
                    df += np.bincount(pair % len(names), minlength=len(names))
                    tf += np.bincount(pair % len(names), sums, len(names))
                found.append(totals_of(names, df, tf, hashes, parts))
            yield from packed_all(found)

    return merge_totals(dealt.mapInArrow(count, "r int, s binary"), parts)


# ------------------------------------------------ weights


class Index:
    """The numbers of a vocabulary's terms, token by token: each run of tokens that begins a term has a
    place, found from the place of the run without its last token. Tokens are words or characters."""

    def __init__(self, split: list[list[str]], ids: list[int]):
        self.tokens = sorted({w for s in split for w in s})
        code, size = {w: i for i, w in enumerate(self.tokens)}, len(self.tokens)
        length, number = np.array([len(s) for s in split], np.int64), np.array(ids, np.int64)
        place = np.array([code[s[0]] for s in split], np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # sorted keys, the term's number or -1
        for n in range(1, int(length.max(initial=1)) + 1):
            here, keys = np.flatnonzero(length >= n), np.arange(size)
            if n > 1:
                key = place[here] * size + np.array([code[split[i][n - 1]] for i in here.tolist()], np.int64)
                keys = np.unique(key)
                place[here] = np.searchsorted(keys, key)
            numbers, ends = np.full(len(keys), -1, np.int64), np.flatnonzero(length == n)
            numbers[place[ends]] = number[ends]
            self.levels.append((keys, numbers))

    def known(self, tokens: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(tokens, pa.array(self.tokens, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def found(self, lengths: np.ndarray, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For n from 1: where known terms of n tokens begin, in order, and their numbers."""
        row = np.repeat(np.arange(len(lengths)), lengths)
        at = np.flatnonzero(code >= 0)
        place = code[at]
        for n, (keys, number) in enumerate(self.levels, 1):
            if n > 1:
                inside = at + n - 1 < len(code)
                at, place = at[inside], place[inside]
                last = code[at + n - 1]
                inside = (row[at] == row[at + n - 1]) & (last >= 0)
                at, key = at[inside], place[inside] * len(self.tokens) + last[inside]
                place = np.searchsorted(keys, key)
                there = np.take(keys, np.minimum(place, len(keys) - 1)) == key if len(keys) else np.zeros(len(key), bool)
                at, place = at[there], place[there]
            ids = number[place]
            yield at[ids >= 0], ids[ids >= 0]


def counted(dealt: DataFrame, words: list[tuple[str, int, float]], chars: list[tuple[str, int, float]]) -> DataFrame:
    """``uid, ids, tf, rows`` from ``uid, tokens, words``, dealt and sorted by record: the known terms of
    each record in id order, characters after words, and how often it has them, as ``planes``; and how
    many rows the record has."""
    n_word, size = len(words), max(len(words) + len(chars), 1)
    indexes = Index([t.split(" ") for t, _, _ in words], [i for _, i, _ in words]), Index([list(t) for t, _, _ in chars], [i + n_word for _, i, _ in chars])
    shared = dealt.sparkSession.sparkContext.broadcast([vars(x) for x in indexes])

    def count(batches):
        runs, grams = Index([], []), Index([], [])
        for index, values in zip((runs, grams), shared.value, strict=True):
            vars(index).update(values)
        for keys, record, ((lengths, flat), (blanks, split)) in pieces(batches):
            coded = flat.dictionary_encode()
            of, code = np.repeat(record, lengths), runs.known(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
            pairs = [summed(of[at] * size + number) for at, number in runs.found(lengths, code)]
            coded = split.dictionary_encode()
            some = max(len(coded.dictionary), 1)
            key, times = summed(np.repeat(record, blanks) * some + coded.indices.to_numpy(zero_copy_only=False))
            padded, points = characters(coded.dictionary)
            alphabet, letter = np.unique(points, return_inverse=True)
            code = grams.known(pa.array([chr(c) for c in alphabet], pa.string()))[letter] if len(points) else letter
            # a term shorter than the least length is a whole padded word, and so met by no other
            for at, number in grams.found(padded, code):
                for who, gram, n in char_pairs(key // some, key % some, times, places(padded, at), number):
                    pairs.append(summed(who * size + gram, n))
            key, tf = (np.concatenate(x) for x in zip(*pairs, strict=True))
            order = np.argsort(key, kind="stable")
            who, number, tf = key[order] // size, (key[order] % size).astype(np.int32), tf[order].astype(np.int32)
            names, rows = np.unique(record, return_counts=True)
            ends = np.append(np.searchsorted(who, names), len(who))
            lists = [[planes(np.diff(number[a:b], prepend=np.int32(0))), planes(tf[a:b])] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            columns = [keys.take(pa.array(names)).cast(pa.string()), *(pa.array(x, pa.binary()) for x in zip(*lists, strict=True)), pa.array(rows.astype(np.int64))]
            yield from pa.Table.from_arrays(columns, names=["uid", "ids", "tf", "rows"]).to_batches(max_chunksize=1000)

    return dealt.mapInArrow(count, "uid string, ids binary, tf binary, rows bigint")


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, the lowest bytes first; small numbers compress well."""
    return x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of the lists, and their numbers."""
    lists = [np.frombuffer(d, np.uint8).reshape(4, -1).T for d in data]
    return np.array([len(x) for x in lists], np.int64), np.ascontiguousarray(np.concatenate([np.zeros((0, 4), np.uint8), *lists])).view("<i4").ravel()


def weighed(records: DataFrame, idf: np.ndarray, n_word: int, schema) -> DataFrame:
    """``uid, features``: a row for each of the rows of ``counted`` records with the weights
    ``(1 + ln tf) · idf``, those of words (ids below ``n_word``) and of characters scaled to length one each.
    Records without a key have no entry."""
    shared, dim = records.sparkSession.sparkContext.broadcast(idf), len(idf)

    def weigh(batches):
        idf = shared.value
        for batch in (b.slice(a, 100) for b in batches for a in range(0, b.num_rows, 100)):
            length, delta = from_planes(batch.column(1).to_pylist())
            tf = from_planes(batch.column(2).to_pylist())[1]
            who, ends = np.repeat(np.arange(len(length)), length), np.cumsum(length)
            run = np.cumsum(delta, dtype=np.int64)
            number = (run - np.repeat(np.concatenate([[0], run])[ends - length], length)).astype(np.int32)
            w = (1 + np.log(tf)) * idf[number]
            block = 2 * who + (number >= n_word)
            w = w / np.sqrt(np.bincount(block, w * w, 2 * len(length)))[block]
            row = np.repeat(np.arange(len(length)), batch.column(3).to_numpy())
            size = np.where(batch.column(0).is_null().to_numpy(zero_copy_only=False), 0, length)[row]
            at, offsets = spread((ends - length)[row], size), pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            fields = pa.array(np.zeros(len(row), np.int8)), pa.array(np.full(len(row), dim, np.int32)), *(pa.ListArray.from_arrays(offsets, pa.array(x[at])) for x in (number, w))
            vectors = pa.StructArray.from_arrays(fields, names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), vectors], names=["uid", "features"])

    return records.mapInArrow(weigh, schema)
