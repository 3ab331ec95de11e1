"""Vectorised text primitives for Arrow batches: code points, words, and 64-bit hashes of runs.

A *word* is a maximal run of Unicode letters, marks, digits or underscores of the lower-cased text; everything
else separates words. Hashes of a run are polynomial sums modulo 2**64 over mixed symbols, read from one prefix
sum, so that any window of a text costs a subtraction and a multiplication.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: An odd multiplier with p % 8 == 5, which has the longest period modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15 | 5
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_LIBC = ctypes.CDLL(None)
#: Characters handled at a time; a longer text is handled alone.
CHUNK_CHARS = 400_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter, is it part of a word, its lower case, and a mixed symbol of that lower case."""
    size = sys.maxunicode + 1
    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, size)))
    letter, word, lower = np.zeros(size, bool), np.zeros(size, bool), np.arange(size, dtype=np.uint32)
    for table, pattern in ((letter, r"\p{L}+"), (word, r"[\p{L}\p{M}\p{N}_]+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = True
    for m in regex.finditer(r"[\p{Lu}\p{Lt}]", every):
        if len(low := m[0].lower()) == 1:
            lower[m.start()] = ord(low)
    return letter, word, lower, mix(lower.astype(np.uint64) + np.uint64(0x51ED2701))


class Powers:
    """BASE**i and BASE**-i modulo 2**64, grown on demand."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            size = max(n + 1, 2 * CHUNK_CHARS)
            for name, p in (("up", BASE), ("down", BASE_INVERSE)):
                x = np.full(size, p, np.uint64)
                x[0] = 1
                setattr(cls, name, np.cumprod(x))
        return cls.up, cls.down


class Runs:
    """Hashes of any run [start, end) of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        self.down = Powers.upto(len(symbols))[1]
        self.prefix = np.empty(len(symbols) + 1, np.uint64)
        self.prefix[0] = 0
        np.cumsum(symbols * Powers.up[: len(symbols)], out=self.prefix[1:])

    def hash(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        n = (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix((self.prefix[end] - self.prefix[start]) * self.down[start] + n + np.uint64(salt))

    def hash_all(self, size: int) -> np.ndarray:
        """The hashes of all runs of ``size`` symbols, in order."""
        many = max(0, len(self.prefix) - size)
        out = self.prefix[size:] - self.prefix[:many]
        out *= self.down[:many]
        out += np.uint64(size * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
        return mix(out)


class Words:
    """The words of a few texts: their hashes, and the text and characters (start, end) they come from."""

    def __init__(self, texts: list[str]):
        self.cp, self.starts, self.lens = code_points(texts)
        _, word, _, symbol = tables()
        inside = np.zeros(len(self.cp) + 2, np.int8)
        inside[1:-1] = word[self.cp]
        edge = np.diff(inside)
        self.begin, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.chars = Runs(symbol[self.cp])
        self.hash = self.chars.hash(self.begin, self.end)
        self.text = np.searchsorted(self.starts, self.begin, side="right") - 1
        #: bounds[i]:bounds[i + 1] are the words of text i
        self.bounds = np.searchsorted(self.begin, np.append(self.starts, len(self.cp) + 1))

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts behind one another with a line feed after each: code points, first places and lengths."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.cumsum(lens + 1) - lens - 1, lens


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word shingles: hash, text, and place of the first word. A text of 1 to k - 1 words is one shingle of them all."""
    n = words.counts()
    many = np.maximum(n - k + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), many)
    first = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many) + words.bounds[text]
    last = np.minimum(first + k, words.bounds[text + 1])
    return Runs(words.hash).hash(first, last, 0x5A17), text, first


def chunks(texts: Iterable[str | None], size: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts of about ``size`` characters together, with the place of the first; null is empty."""
    part, chars, at = [], 0, 0
    for i, text in enumerate(texts):
        text = text or ""
        if part and chars + len(text) > size:
            yield at, part
            part, chars, at = [], 0, i
        part.append(text)
        chars += len(text) + 1
    if part:
        yield at, part


def text_chunks(column: pa.Array, null: str | None = "") -> Iterator[tuple[int, list]]:
    """As ``chunks`` of an Arrow column of texts (or bytes), of which only a chunk is made into Python values at a time."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    part = (np.cumsum(size) - size) // CHUNK_CHARS
    ends = [*(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(size)]
    for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
        if hi > lo:
            yield lo, [null if t is None else t for t in column.slice(lo, hi - lo).to_pylist()]


def give_back() -> None:
    """Return what a task has freed to the system: workers are kept for later tasks, and the executor's memory holds all of them."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in all runs [start, start + size) one after another, and the run of each."""
    run = np.repeat(np.arange(len(starts)), sizes)
    return np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[run], run


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of minima over sum of maxima of the multiplicities of two hash arrays; 0 if both are empty."""
    if not len(a) or not len(b):
        return 0.0
    both, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = (np.bincount(w, minlength=len(both)) for w in (where[: len(a)], where[len(a) :]))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())
