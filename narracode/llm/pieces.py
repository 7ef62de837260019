"""SentencePiece encoding and decoding, with a max-plus scan over chunks of giant documents.

A text's best segmentation is a path through its pieces, and paths join by max-plus algebra: the
weight of a path is a sum, and of several paths the greatest counts. In a byte-pair model a step
from one piece to the next weighs 0 if the model would leave the two as they are when they stand
alone, and minus infinity if it would merge across them; exactly one path has a finite weight, and
it is the model's encoding. So the scan gives the ids of the library for texts of any length.

A giant document is cut into chunks of equal length, wherever that may be. The state at a cut is
the piece that reaches or spans it. A chunk yields a matrix from the states at its beginning to
those at its end; matrices are combined associatively, upwards in pairs and downwards to every
cut; then each chunk is traced back by itself, between the states at its two ends. Where a blank
follows a visible character no piece spans, so inside a chunk only the ends need the search and
all between is encoded word by word. Documents of one chunk have no inner cuts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narracode.llm.tables import keyed
from narracode.llm.words import _Numbers
from narracode.session import write_table

#: Characters of a chunk.
CHUNK_CHARS = 16_384
#: Distinct words whose ids a task keeps.
CACHED_WORDS = 300_000
BLANK = "▁"
#: A character of the private area: no piece holds it, so nothing merges across it.
_WALL = "\ue000"

State = tuple[int, int]  # piece id (or minus the code point of an unknown character), characters past the cut


class Pieces:
    """A byte-pair model file with byte fallback, and what the scan asks of it."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.text = [self.model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        self.number = {self.text[i]: i for i in plain}
        self.longest = max(len(p) for p in self.number)
        wall = self.model.encode(_WALL)
        self.skip = len(wall)
        fits = BLANK not in "".join(p.lstrip(BLANK) for p in self.number) and not any(_WALL in p for p in self.number)
        if not fits or self.model.encode("a  b ") != self.after_wall(f"{BLANK}a{BLANK * 2}b{BLANK}"):
            raise ValueError("the model must keep blanks, begin words with them, and put one before the text")
        self.bytes = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.clear()

    def after_wall(self, text: str) -> list[int]:
        """Ids of a normalised text as it stands, nothing put before it."""
        return self.model.encode(_WALL + text)[self.skip :]

    # ------------------------------------------------ words

    def clear(self) -> None:
        self.numbers, self.known = _Numbers(), 0
        self.flat, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64)

    def _learn(self) -> None:
        fresh, self.numbers.fresh = self.numbers.fresh, []
        if not fresh:
            return
        # a word stands for itself after one blank; other keys begin with their blanks
        new = self.model.encode([w[1:] if w.startswith(BLANK) else w for w in fresh], num_threads=1)
        new = [self.after_wall(w) if w in ("", BLANK) else ids for w, ids in zip(fresh, new, strict=True)]
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        used = int(self.ends[self.known])
        total, end = used + int(sizes.sum()), self.known + len(new)
        if total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(total, np.int32)])
        if end >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(end + 1, np.int64)])
        self.flat[used:total] = [i for ids in new for i in ids]
        self.ends[self.known + 1 : end + 1] = used + np.cumsum(sizes)
        self.known = end

    def encode_words(self, text: str) -> np.ndarray:
        """Ids of a normalised text that begins with a blank, or is empty."""
        if not text:
            return np.zeros(0, np.int32)
        if len(self.numbers) > CACHED_WORDS:
            self.clear()
        words = text[1:].split(BLANK)
        if not all(words):
            joined, before = [], BLANK
            for w in words:
                if w:
                    joined.append(w if before == BLANK else before + w)
                    before = BLANK
                else:
                    before += BLANK
            if before != BLANK or not joined:
                # blanks at the end stand for themselves
                joined.append(before[1:] if joined or before != BLANK else before)
            words = joined
        rows = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        self._learn()
        starts = self.ends[rows]
        sizes = self.ends[rows + 1] - starts
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]))]

    # ------------------------------------------------ states and steps

    def surface(self, piece: int) -> str:
        return chr(-piece) if piece < 0 else self.text[piece]

    def ids(self, piece: int) -> list[int]:
        return [self.bytes[b] for b in chr(-piece).encode("utf-8", "surrogatepass")] if piece < 0 else [piece]

    def starting(self, text: str, at: int) -> Iterator[int]:
        """Pieces that begin at a place; a character without a piece stands for itself."""
        for n in range(1, min(self.longest, len(text) - at) + 1):
            piece = self.number.get(text[at : at + n])
            if piece is not None:
                yield piece
            elif n == 1:
                yield -ord(text[at])

    def weight(self, left: int | None, right: int) -> float:
        """0 if the two stay apart when they stand alone, else minus infinity."""
        if left is None or left < 0 or right < 0:
            return 0.0 if right < 0 or self._alone(self.text[right], right) else -np.inf
        a, b = self.text[left], self.text[right]
        if b[0] == BLANK and a[-1] != BLANK:
            return 0.0 if self._alone(b, right) else -np.inf
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > CACHED_WORDS:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.after_wall(a + b) == [left, right]
        return 0.0 if ok else -np.inf

    def _alone(self, text: str, piece: int) -> bool:
        ok = self.pairs.get((text, ""))
        if ok is None:
            ok = self.pairs[text, ""] = self.after_wall(text) == [piece]
        return ok

    def states(self, text: str, cut: int) -> list[State]:
        """Pieces that reach or span a cut of the text; at its ends there is one, no piece."""
        if cut in (0, len(text)):
            return [(0, 0)]
        out = []
        for start in range(max(0, cut - self.longest), cut):
            for piece in self.starting(text, start):
                past = start + len(self.surface(piece)) - cut
                if past >= 0:
                    out.append((piece, past))
        return out

    # ------------------------------------------------ decoding

    def decode(self, ids: list[int], first: bool) -> str:
        """The text of ids; of a document's first ids the blank before the text goes."""
        text = "".join(map(self.text.__getitem__, ids))
        if "<0x" in text:
            out, held = [], bytearray()
            for i in ids:
                if i in self.byte_of:
                    held.append(self.byte_of[i])
                    continue
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held = bytearray()
                out.append(self.text[i])
            text = "".join(out) + held.decode("utf-8", "replace")
        text = text.replace(BLANK, " ")
        return text[1:] if first and text else text


def normalised(text: str) -> str:
    """Blanks as their visible mark, and one before the text."""
    return BLANK + text.replace(" ", BLANK) if text else ""


def safe_cuts(text: str, a: int, b: int) -> tuple[int, int] | None:
    """First and last place in ``a .. b`` where a blank follows another character, if any."""
    first = a
    while True:
        first = text.find(BLANK, first)
        if first < 0 or first >= b:
            return None
        if first > 0 and text[first - 1] != BLANK:
            break
        first += 1
    last = b
    while True:
        last = text.rfind(BLANK, first, last)
        if text[last - 1] != BLANK:
            return first, last


# ---------------------------------------------------------------- one chunk


def _walk(p: Pieces, text: str, starts: list[tuple[int, int | None]], until: int):
    """Best weights from each start ``(place, piece before it)`` to every piece that begins before
    ``until``: ``{piece before: weights}`` by place, for places up to ``until`` and beyond."""
    n = len(starts)
    reach: dict[int, dict[int | None, np.ndarray]] = {}
    for k, (place, before) in enumerate(starts):
        w = reach.setdefault(place, {}).setdefault(before, np.full(n, -np.inf))
        w[k] = 0.0
    for place in range(min(reach, default=until), until):
        for before, w in reach.get(place, {}).items():
            for piece in p.starting(text, place):
                step = p.weight(before, piece)
                if step == -np.inf:
                    continue
                to = place + len(p.surface(piece))
                found = reach.setdefault(to, {}).setdefault(piece, np.full(n, -np.inf))
                np.maximum(found, w + step, out=found)
    return reach


def transfer(p: Pieces, text: str, a: int, b: int) -> tuple[list[State], list[State], np.ndarray]:
    """States at the cuts ``a`` and ``b`` of ``text`` and the matrix of greatest weights between
    them. The text may be a part of a document that reaches ``p.longest`` characters past each
    cut, or less where the document ends."""
    left, right = p.states(text, a), p.states(text, b)
    starts = [(a + past, None if a == 0 else piece) for piece, past in left]
    safe = safe_cuts(text, a + p.longest, b - p.longest) if b - a > 3 * p.longest else None
    matrix = np.full((len(left), len(right)), -np.inf)
    if safe is None:
        reach = _walk(p, text, starts, b)
        for j, (piece, past) in enumerate(right):
            ends = reach.get(b + past, {})
            found = [w for before, w in ends.items() if b == len(text) or before == piece]
            if found:
                matrix[:, j] = np.max(found, axis=0)
        return left, right, matrix
    first, last = safe
    into = _walk(p, text, starts, first).get(first, {})
    out = _walk(p, text, [(last, None)], b)
    head = np.max(list(into.values()), axis=0) if into else np.full(len(left), -np.inf)
    for j, (piece, past) in enumerate(right):
        found = [w[0] for before, w in out.get(b + past, {}).items() if b == len(text) or before == piece]
        if found:
            matrix[:, j] = head + max(found)
    return left, right, matrix


def _trace(p: Pieces, text: str, start: tuple[int, int | None], end: int, last: int | None) -> list[int]:
    """Pieces of the best path from a start to a place, ``last`` being the piece that ends there."""
    steps: dict[tuple[int, int | None], tuple[float, tuple | None, int | None]] = {start: (0.0, None, None)}
    for place in range(start[0], end):
        for at, before in [k for k in steps if k[0] == place]:
            w = steps[at, before][0]
            for piece in p.starting(text, place):
                to = (place + len(p.surface(piece)), piece)
                found = w + p.weight(before, piece)
                if to[0] <= end and found > steps.get(to, (-np.inf,))[0]:
                    steps[to] = (found, (at, before), piece)
    ends = [k for k in steps if k[0] == end and (last is None or k[1] == last or k == start)]
    at = max(ends, key=lambda k: steps[k][0])
    out: list[int] = []
    while steps[at][1] is not None:
        out.append(steps[at][2])
        at = steps[at][1]
    return out[::-1]


def trace(p: Pieces, text: str, a: int, b: int, left: State, right: State) -> tuple[np.ndarray, str]:
    """Ids of the pieces that begin in ``a .. b``, given the states at both cuts, and the text
    they cover."""
    begin, end = a + left[1], b + right[1]
    before = None if a == 0 else left[0]
    last = None if b == len(text) else right[0]
    safe = safe_cuts(text, a + p.longest, b - p.longest) if b - a > 3 * p.longest else None
    if safe is None:
        found = _trace(p, text, (begin, before), end, last)
        ids = [i for piece in found for i in p.ids(piece)]
    else:
        head = _trace(p, text, (begin, before), safe[0], None)
        tail = _trace(p, text, (safe[1], None), end, last)
        body = p.encode_words(text[safe[0] : safe[1]])
        ids = [i for piece in head for i in p.ids(piece)] + body.tolist() + [i for piece in tail for i in p.ids(piece)]
    return np.array(ids, np.int32), text[begin:end]


# ---------------------------------------------------------------- the scan


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (x[:, :, None] + y[None]).max(axis=1)


def scan(matrices: list[np.ndarray]) -> list[int]:
    """Number of the state at every cut on the best path, by products of neighbours upwards and
    the choice of the state between two halves downwards."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        m = levels[-1]
        levels.append([_join(m[i], m[i + 1]) if i + 1 < len(m) else m[i] for i in range(0, len(m), 2)])
    whole = levels[-1][0]
    first, last = np.unravel_index(np.argmax(whole), whole.shape)
    cuts = [int(first), int(last)]
    for m in levels[-2::-1]:
        finer = [cuts[0]]
        for i in range(0, len(m), 2):
            if i + 1 < len(m):
                middle = m[i][finer[-1]] + m[i + 1][:, cuts[i // 2 + 1]]
                finer.append(int(np.argmax(middle)))
            finer.append(cuts[i // 2 + 1])
        cuts = finer
    return cuts


# ---------------------------------------------------------------- tables

_OUT = "_id long, _h long, chunk int, ids array<int>, round_trip boolean"


def _encoded(rows: list[tuple]) -> pa.RecordBatch:
    names = ["_id", "_h", "chunk", "ids", "round_trip"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.bool_()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _same(p: Pieces, ids: np.ndarray, text: str, first: bool) -> bool:
    shown = text.replace(BLANK, " ")
    return p.decode(ids.tolist(), first) == (shown[1:] if first else shown)


def encode(docs: DataFrame, model: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``doc_id, chunk, n_ids, ids, round_trip`` of every chunk of every row.

    The ids of a document's chunks, one after the other, are those of the library for the whole
    text; ``round_trip`` says that decoding the chunk gives back the text it covers. A missing or
    empty text is one chunk without ids. Rows with equal id and text are encoded each.
    """
    rows = keyed(docs).select(F.col("_id").cast("long").alias("_id"), "_h", F.coalesce("_text", F.lit("")).alias("_text"))
    giant = F.length("_text") >= chunk_chars

    def whole(batches):
        p = Pieces(model)
        for batch in batches:
            out = []
            for i, h, text in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                shown = normalised(text)
                ids = p.encode_words(shown)
                out.append((i, h, 0, ids, _same(p, ids, shown, True)))
            yield _encoded(out)

    # the pieces' greatest length is asked of the model on the driver, as chunks overlap by it
    reach = Pieces(model).longest

    short = rows.filter(~giant).mapInArrow(whole, _OUT)
    shown = F.concat(F.lit(BLANK), F.translate("_text", " ", BLANK))
    long_ = rows.filter(giant).select("_id", "_h", F.monotonically_increasing_id().alias("_row"), shown.alias("_text"))
    long_ = long_.withColumn("_size", F.length("_text"))
    cuts = long_.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.expr(f"cast((_size - 1) div {chunk_chars} as int)"))))
    start = F.col("chunk") * chunk_chars
    low = F.greatest(start - reach, F.lit(0))
    high = F.least(start + chunk_chars + reach, F.col("_size"))
    cuts = cuts.select(
        "_id", "_h", "_row", "chunk",
        F.substring("_text", low + 1, high - low).alias("_part"),
        (start - low).cast("int").alias("_a"),
        (F.least(start + chunk_chars, F.col("_size")) - low).cast("int").alias("_b"),
    )
    cuts = write_table(cuts, "chunks")

    def matrices(batches):
        p = Pieces(model)
        for batch in batches:
            kept = [batch.column(c).to_pylist() for c in range(4)]
            blobs = []
            for text, a, b in zip(*[batch.column(c).to_pylist() for c in (4, 5, 6)], strict=True):
                left, right, m = transfer(p, text, a, b)
                blobs.append(json.dumps([left, right, (m > -np.inf).astype(int).tolist()]))
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(k, t) for k, t in zip(kept, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], pa.array(blobs, pa.string())],
                names=["_id", "_h", "_row", "chunk", "_m"],
            )

    dealt = cuts.repartition("_row", "chunk")
    found = dealt.mapInArrow(matrices, "_id long, _h long, _row long, chunk int, _m string").select("_row", "chunk", "_m")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        read = [json.loads(m) for m in pdf["_m"]]
        weights = [np.where(np.array(m, float).reshape(len(x), len(y)) > 0, 0.0, -np.inf) for x, y, m in read]
        at = scan(weights)
        left = [read[i][0][at[i]] for i in range(len(read))]
        right = [read[i][1][at[i + 1]] for i in range(len(read))]
        states = [[*x, *y] for x, y in zip(left, right, strict=True)]
        return pd.DataFrame({"_row": pdf["_row"].to_numpy(), "chunk": pdf["chunk"].to_numpy(), "_states": states})

    chosen = write_table(found.groupBy("_row").applyInPandas(choose, "_row long, chunk int, _states array<int>"), "chunk_states")

    def back(batches):
        p = Pieces(model)
        for batch in batches:
            out = []
            for i, h, chunk, text, a, b, s in zip(*[batch.column(c).to_pylist() for c in range(7)], strict=True):
                ids, covered = trace(p, text, a, b, (s[0], s[1]), (s[2], s[3]))
                out.append((i, h, chunk, ids, _same(p, ids, covered, chunk == 0)))
            yield _encoded(out)

    traced = cuts.join(chosen, ["_row", "chunk"]).select("_id", "_h", "chunk", "_part", "_a", "_b", "_states").mapInArrow(back, _OUT)
    both = short.unionAll(traced)
    return both.select(F.col("_id").alias("doc_id"), "chunk", F.size("ids").alias("n_ids"), "ids", "round_trip")


def decode(chunks: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, chunk, ids``: each chunk is decoded by itself, then a
    document's chunks are joined in order."""

    def text(batches):
        p = Pieces(model)
        for batch in batches:
            doc, chunk = batch.column(0), batch.column(1)
            texts = [p.decode(ids or [], c == 0) for c, ids in zip(chunk.to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([doc, chunk, pa.array(texts, pa.string())], names=["doc_id", "chunk", "_t"])

    decoded = chunks.select(F.col("doc_id").cast("long"), F.col("chunk").cast("int"), "ids").mapInArrow(text, "doc_id long, chunk int, _t string")
    listed = decoded.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "_t"))).alias("_l"))
    return listed.select("doc_id", F.array_join(F.col("_l._t"), "").alias("text"))
