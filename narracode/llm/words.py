"""Words of texts as row numbers of a table, so that work per word is done once per distinct word.

A task sees the same words again and again. ``WordRows`` numbers them; an operator keeps one
array entry per numbered word and gathers. The table is a cache with a bounded size: it is
emptied between blocks of texts, never in the middle of one, so results do not depend on it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import xxhash

#: Distinct words kept by a task before the cache is emptied.
CACHED_WORDS = 400_000
#: Characters of a text that are split into words at once.
SEGMENT_CHARS = 1 << 20

_SPACE = re.compile(r"\s")


class _Numbers(dict):
    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


def segments(text: str, size: int = SEGMENT_CHARS) -> Iterator[str]:
    """Pieces of at least ``size`` characters that end before white space; a text without
    white space is one piece."""
    at = 0
    while len(text) - at > size:
        space = _SPACE.search(text, at + size)
        if space is None:
            break
        yield text[at : space.start()]
        at = space.start()
    yield text[at:] if at else text


class WordRows:
    """Row numbers of words. ``compute`` turns a list of new words into arrays with one entry
    per word; ``values`` holds them for all rows."""

    def __init__(self, compute: Callable[[list[str]], tuple[np.ndarray, ...]], limit: int = CACHED_WORDS):
        self.compute, self.limit = compute, limit
        self.numbers = _Numbers()
        self.values: tuple[np.ndarray, ...] | None = None
        self.filled = 0

    def trim(self) -> None:
        """Empty the cache if it is over its limit; call it only between blocks."""
        if len(self.numbers) > self.limit:
            self.numbers, self.filled = _Numbers(), 0

    def rows(self, text: str, size: int = SEGMENT_CHARS) -> np.ndarray:
        """Row numbers of the words of ``text``."""
        parts = []
        for piece in segments(text, size):
            words = piece.split()
            parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def fill(self) -> tuple[np.ndarray, ...]:
        """Compute the values of the words that are new since the last call."""
        fresh = self.numbers.fresh
        if fresh or self.values is None:
            new = self.compute(fresh)
            n = self.filled + len(fresh)
            if self.values is None or n > len(self.values[0]):
                grown = []
                for i, v in enumerate(new):
                    room = np.zeros((max(2 * n, 1024), *v.shape[1:]), v.dtype)
                    if self.values is not None:
                        room[: self.filled] = self.values[i][: self.filled]
                    grown.append(room)
                self.values = tuple(grown)
            for kept, v in zip(self.values, new, strict=True):
                kept[self.filled : n] = v
            self.filled = n
            self.numbers.fresh = []
        return self.values


def blocks(lengths: list[int], chars: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts with about ``chars`` characters together."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        held += n
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def word_hashes(words: list[str]) -> tuple[np.ndarray]:
    """One 64-bit hash per word."""
    digest = xxhash.xxh3_64_intdigest
    return (np.fromiter((digest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)),)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes to doubles in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
