"""Byte-level BPE encoding and decoding over a Spark column.

Every match of the pre-tokenizer's pattern is encoded by itself. Two tiers: a minimal perfect hash finds the
pre-tokens that are vocabulary entries as a whole; the others are merged by rank, those of up to ``SHORT`` bytes all
together, one join of each in a round, longer ones with a heap over a doubly linked list of their bytes. The vocabulary
(one fixed file, about 1 MB) is broadcast; a worker keeps a bounded cache of pre-tokens it has seen.

Null text encodes as the empty text, and a null id is passed through. Texts are taken in blocks of pre-tokens, so
one very long text costs its ids and a block.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernel import Runs, chunks, give_back, mix, text_chunks

#: Characters taken at a time, the bytes that a worker's cache holds at most beside the block at hand, and the rank of no token.
BLOCK_CHARS, CACHE_BYTES, NONE = 200_000, 32_000_000, 1 << 40
#: Bytes that an entry of the cache takes besides its characters and ids.
ENTRY_BYTES = 200
#: Bytes of the pre-tokens that are merged together, by upper bounds of their widths, pre-tokens in such a group, and no rank there.
WIDTHS, GROUP, NO_RANK = (6, 9, 12, 16, 24, 40, 64), 16_384, np.int32((1 << 31) - 1)
SHORT = WIDTHS[-1]
_BYTES = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))


def byte_hashes(pieces: list[bytes]) -> np.ndarray:
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    starts = np.append(0, ends[:-1])
    return Runs(_BYTES[np.frombuffer(b"".join(pieces), np.uint8)]).hash(starts, ends)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys by levels: a key rests at the first level where its bit is its alone.

    The index of a key is the number of bits set before its own, so ``n`` keys get 0 to n - 1. A key outside the
    set gets -1 or some index; the caller compares.
    """

    def __init__(self, keys: np.ndarray, gamma: float = 1.5):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        done, left = 0, np.asarray(keys, np.uint64)
        while len(left):
            size = max(64, int(gamma * len(left)))
            at = self._place(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((alone, done + np.cumsum(alone) - alone))
            done, left = done + int(alone.sum()), left[~alone[at]]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (alone, before) in enumerate(self.levels):
            at = self._place(keys[left], level, len(alone))
            hit = alone[at]
            out[left[hit]] = before[at[hit]]
            left = left[~hit]
        return out


class Vocabulary:
    """Ranks by token, from the lines (base64, space, rank) of a ranks file, with its pre-tokenizer pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        hashes = byte_hashes(tokens := list(ranks))
        self.perfect = PerfectHash(hashes)
        place = self.perfect.find(hashes)
        self.entries: list[tuple[bytes, int]] = [(b"", -1)] * len(tokens)
        for t, i in zip(tokens, place.tolist(), strict=True):
            self.entries[i] = (t, ranks[t])
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        self.byte_ids = np.array(self.bytes, np.int32)
        # the rank of two neighbouring tokens, from every cut of a token in two
        cuts = [(a << 32 | b, r) for t, r in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k], -1)) >= 0 and (b := ranks.get(t[k:], -1)) >= 0]
        pairs = np.array(sorted(cuts), np.int64).reshape(-1, 2)
        self.pairs, self.pair_ranks = np.append(pairs[:, 0], np.int64(-1)), np.append(pairs[:, 1], NO_RANK).astype(np.int32)
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def whole(self, pieces: list[bytes]) -> list[int]:
        """First tier: the id of each piece that is a vocabulary entry, else -1."""
        out = self.perfect.find(byte_hashes(pieces)).tolist()
        for k, i in enumerate(out):
            if i >= 0:
                token, rank = self.entries[i]
                out[k] = rank if token == pieces[k] else -1
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Second tier: repeatedly join the neighbours of lowest rank, leftmost first."""
        rank, n = self.ranks.get, len(piece)
        ids = [self.bytes[x] for x in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # the rank of the pair that begins at each place, and a heap of rank * n + place; a rank that changed is stale
        pair = [rank(piece[i : i + 2], NONE) for i in range(n - 1)]
        pair.append(NONE)
        heap = [r * n + i for i, r in enumerate(pair) if r < NONE]
        heapify(heap)
        while heap:
            r, i = divmod(heappop(heap), n)
            if pair[i] != r:
                continue
            j = after[i]
            end = after[j]
            ids[i], ids[j], pair[j], after[i] = r, -1, NONE, end
            if end < n:
                before[end] = i
                pair[i] = r = rank(piece[i : after[end]], NONE)
                if r < NONE:
                    heappush(heap, r * n + i)
            else:
                pair[i] = NONE
            if i:
                h = before[i]
                pair[h] = r = rank(piece[h:end], NONE)
                if r < NONE:
                    heappush(heap, r * n + h)
        return [x for x in ids if x >= 0]

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that each pair of tokens makes."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pairs[:-1], keys)
        return np.where(self.pairs[at] == keys, self.pair_ranks[at], NO_RANK)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Second tier for many pieces: their ids as little-endian unsigned 32-bit integers."""
        out = [b""] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for i in np.flatnonzero(size > SHORT).tolist():
            out[i] = array("I", self.merge(pieces[i])).tobytes()
        for low, width in zip((0, *WIDTHS), WIDTHS, strict=False):
            group = np.flatnonzero((size > low) & (size <= width))
            for lo in range(0, len(group), GROUP):
                self._merge_group(pieces, group[lo : lo + GROUP], size, width, out)
        return out

    def _merge_group(self, pieces: list[bytes], at: np.ndarray, size: np.ndarray, width: int, out: list[bytes]) -> None:
        """Rows of ids, and of the rank of the pair that begins at each; a round joins one pair of every row and ends those without one."""
        n = size[at]
        ids = self.byte_ids[np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in at.tolist()]), np.uint8).reshape(len(at), width)]
        rank = np.full(ids.shape, NO_RANK)
        rows, cols = np.nonzero(np.arange(1, width) < n[:, None])
        rank[rows, cols] = self.joined(ids[rows, cols], ids[rows, cols + 1])
        while len(at):
            rows, j = np.arange(len(at)), rank.argmin(1)
            best = rank[rows, j]
            going = best < NO_RANK
            if not going.all():
                over = ~going
                ends = 4 * np.cumsum(n[over])
                told = ids[over][np.arange(ids.shape[1]) < n[over, None]].astype("<u4").tobytes()
                for i, a, b in zip(at[over].tolist(), (ends - 4 * n[over]).tolist(), ends.tolist(), strict=True):
                    out[i] = told[a:b]
                at, n, ids, rank, j, best = at[going], n[going], ids[going], rank[going], j[going], best[going]
                rows = rows[: len(at)]
            if not len(at):
                break
            ids[rows, j] = best
            keep = np.ones(ids.shape, bool)
            keep[rows, j + 1] = False
            ids, rank, n = ids[keep].reshape(len(at), -1), rank[keep].reshape(len(at), -1), n - 1
            rank[rows, j] = NO_RANK
            some = np.flatnonzero(j + 1 < n)
            k = j[some]
            rank[some, k] = self.joined(ids[some, k], ids[some, k + 1])
            some = np.flatnonzero(j > 0)
            k = j[some]
            rank[some, k - 1] = self.joined(ids[some, k - 1], ids[some, k])

    def learn(self, tokens: set[str]) -> None:
        """Put the ids of all these pre-tokens into the cache."""
        if self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        if new := list(tokens.difference(self.cache)):
            pieces = [t.encode() for t in new]
            whole = self.whole(pieces)
            rest = iter(self.merge_all([p for p, i in zip(pieces, whole, strict=True) if i < 0]))
            self.cache.update((t, i.to_bytes(4, "little") if i >= 0 else next(rest)) for t, i in zip(new, whole, strict=True))
            self.held += ENTRY_BYTES * len(new) + 5 * sum(map(len, pieces))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; neighbouring texts are learnt together."""
        out: list[bytes] = []
        for _, part in chunks(texts, BLOCK_CHARS):
            if len(part[0]) > 4 * BLOCK_CHARS:
                out += [self.encode_long(t) for t in part]
                continue
            tokens = [self.pattern.findall(t) for t in part]
            self.learn(set().union(*tokens))
            out += [b"".join(map(self.cache.__getitem__, t)) for t in tokens]
        return out

    def encode_long(self, text: str) -> bytes:
        """A very long text by blocks of pre-tokens."""
        matches, out = self.pattern.finditer(text), []
        while tokens := [m[0] for m in islice(matches, BLOCK_CHARS // 4)]:
            self.learn(set(tokens))
            out.append(b"".join(map(self.cache.__getitem__, tokens)))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}


@lru_cache(4)
def _vocabulary(pattern: str, key: int, holder: object) -> Vocabulary:
    return Vocabulary(holder.ranks, pattern)


class _Held:
    """A broadcast ranks table that a worker turns into a Vocabulary once."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.pattern, self.sent = pattern, spark.sparkContext.broadcast(read_ranks(path))
        self.key = hash((path, pattern))

    @property
    def ranks(self) -> dict[bytes, int]:
        return self.sent.value

    def __hash__(self) -> int:
        return self.key

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Held) and self.key == other.key

    def get(self) -> Vocabulary:
        return _vocabulary(self.pattern, self.key, self)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with a binary column of token ids (little-endian unsigned 32-bit); a column of that name is replaced."""
    held = _Held(docs.sparkSession, path, pattern)

    @F.arrow_udf(T.BinaryType())
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = held.get()
        for texts in batches:
            yield pa.concat_arrays([pa.array([], pa.binary()), *(pa.array(v.encode_all(part), pa.binary()) for _, part in text_chunks(texts))])
        give_back()

    return docs.withColumn(ids, encoded(F.col(text)))


def lengths(docs: DataFrame, path: str, pattern: str, text: str = "text", length: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each text; no ids leave the workers."""
    held = _Held(docs.sparkSession, path, pattern)

    @F.arrow_udf(T.LongType())
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = held.get()
        for texts in batches:
            yield pa.array([len(b) // 4 for _, part in text_chunks(texts) for b in v.encode_all(part)], pa.int64())

    return docs.withColumn(length, counted(F.col(text)))


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for; null ids decode to null."""
    held = _Held(encoded.sparkSession, path, pattern)

    @F.arrow_udf(T.BinaryType())
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = held.get()
        for rows in batches:
            read = ([None if r is None else v.decode(r) for r in part] for _, part in text_chunks(rows, None))
            yield pa.concat_arrays([pa.array([], pa.binary()), *(pa.array(x, pa.binary()) for x in read)])

    return encoded.withColumn(decoded, bytes_of(F.col(ids)))


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode each text: doc_id, n_tokens, and SHA-256 of the ids and of the decoded bytes."""
    both = decode(encode(docs.select("doc_id", "text"), path, pattern), path, pattern)
    return both.select(
        "doc_id",
        F.expr("cast(length(token_ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


