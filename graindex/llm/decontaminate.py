"""Benchmark decontamination: documents that hold a benchmark item, or nearly.

Every window of a document that is as long as an item and could match (see windows.py), or the whole of a document that
is shorter, gets a SimHash of 128 bits
over its word shingles, weighted by how often they occur. Fingerprints within ``RADIUS`` bits of an item's are found
by multi-index blocks: of 16 blocks of 8 bits at least one differs in at most one bit, so an item is listed in each
block under its own value and the eight beside it, and no fingerprint within the radius is missed. Candidates are
verified by the exact weighted Jaccard similarity of the shingles of window and item, which must be ``THRESHOLD`` or
more. At that similarity a fingerprint differs in 19 bits on average, with a deviation of 4, so three deviations lie
within the radius, and a passage has several windows.

The benchmark is a stated query set: it is taken in blocks of bounded size, each broadcast and held against one scan
of the documents; documents are never collected. With one block they aren't shuffled either, and are scanned where the
result is read; of several blocks one at a time is built and broadcast, its results are written out, and it is
released before the next. Repeated items count once. Case and punctuation don't count. A null or empty document
matches nothing, as does an item without words; an item of fewer than five words matches as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .neardup import pair_similarities
from .session import cut, document_key, free, keyed
from .textkernel import Words, mix, spread, text_chunks
from .windows import Items

THRESHOLD, RADIUS, BLOCKS = 0.8, 31, 16
#: Characters of benchmark text in one block, at most about.
BLOCK_CHARS = 4_000_000
_NEIGHBOURS = np.append(0, 1 << np.arange(8)).astype(np.uint8)


def fingerprints(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128-bit SimHash (16 bytes) of the runs [start, start + size) of shingle hashes."""
    used = np.zeros(len(h) + 1, np.int32)
    np.add.at(used, starts, 1)
    np.add.at(used, starts + sizes, -1)
    place = np.flatnonzero(np.cumsum(used)[:-1] > 0)
    bits = np.unpackbits(np.stack([mix(h[place]), mix(h[place] ^ np.uint64(0xBEEF))], 1).view(np.uint8), axis=1)
    sums = np.zeros((len(place) + 1, 128), np.int32)
    np.cumsum(2 * bits.astype(np.int8) - 1, axis=0, dtype=np.int32, out=sums[1:])
    lo = np.searchsorted(place, starts)
    return np.packbits(sums[lo + sizes] > sums[lo], axis=1)


class Index:
    """A block of items, with their fingerprints listed by block, value and size."""

    def __init__(self, ids: list, texts: list[str | None], threshold: float = THRESHOLD):
        self.threshold = threshold
        # of total weights s and n, a sum of minima m gives m / (s + n - m)
        self.items = Items(ids, texts, 2 * threshold / (1 + threshold))
        some = np.flatnonzero(self.items.size > 0)
        self.slots = {(int(k), int(n)): i for i, (k, n) in enumerate(sorted(set(zip(self.items.k[some], self.items.size[some], strict=True))))}
        self.prints = np.zeros((len(ids), BLOCKS), np.uint8)
        for i in some:
            self.prints[i] = fingerprints(self.items.hashes[i], np.array([0]), np.array([len(self.items.hashes[i])]))[0]
        slot = np.array([self.slots[int(self.items.k[i]), int(self.items.size[i])] for i in some], np.int64)
        key = (((slot[:, None] * BLOCKS + np.arange(BLOCKS)) * 256)[:, :, None] + (self.prints[some][:, :, None] ^ _NEIGHBOURS)).reshape(len(some), BLOCKS * len(_NEIGHBOURS))
        order = np.argsort(key.ravel(), kind="stable")
        self.listed = np.repeat(some, key.shape[1])[order]
        self.offsets = np.searchsorted(key.ravel()[order], np.arange(len(self.slots) * BLOCKS * 256 + 1))

    def matches(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Best window of each text and item: text, item, similarity, first and last character (exclusive)."""
        words, found = Words(texts), []
        for k, h, starts, sizes, meets in self.items.windows(words):
            prints = fingerprints(h, starts, sizes)
            slot = np.array([self.slots[k, n] for n in meets.tolist()])
            key = ((slot[:, None] * BLOCKS + np.arange(BLOCKS)) * 256 + prints).ravel()
            many = self.offsets[key + 1] - self.offsets[key]
            entry, row = spread(self.offsets[key], many)
            pair = np.unique(np.stack([row // BLOCKS, self.listed[entry]], 1), axis=0)
            window, item = pair[:, 0], pair[:, 1]
            near = np.bitwise_count(prints[window] ^ self.prints[item]).sum(1) <= RADIUS
            window, item = window[near], item[near]
            if not len(window):
                continue
            place, of = spread(starts[window], sizes[window])
            mine = [self.items.hashes[i] for i in item.tolist()]
            whose = np.repeat(np.arange(len(item)), [len(x) for x in mine])
            similarity = pair_similarities(np.concatenate([h[place], *mine]), np.concatenate([of, whose]), np.repeat([0, 1], [len(of), len(whose)]), len(item))
            good = similarity >= self.threshold
            s, n = starts[window[good]], sizes[window[good]]
            found.append((words.text[s], item[good], similarity[good], words.begin[s], words.end[s + n + k - 2]))
        if not found:
            return (np.zeros(0, np.int64),) * 5
        text, item, similarity, begin, end = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((begin, -similarity, item, text))
        text, item, similarity, begin, end = (x[order] for x in (text, item, similarity, begin, end))
        best = np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]))
        base = words.starts[text[best]]
        return text[best], item[best], similarity[best], begin[best] - base, end[best] - base


def indexes(items: DataFrame, item_id: str, make: Callable) -> tuple[int, Iterator[Broadcast]]:
    """The number of blocks of items, and their broadcast indexes (made by ``make`` of ids and texts), each when it is asked for.

    The number follows the total length of the items, so a block is bounded.
    """
    context = items.sparkSession.sparkContext
    rows = items.select(F.col(item_id).alias("i"), F.col("text").alias("t")).distinct()
    parts = 1 + int(rows.agg(F.coalesce(F.sum(F.length("t") + 64), F.lit(0))).first()[0]) // BLOCK_CHARS

    def made() -> Iterator[Broadcast]:
        for part in range(parts):
            block = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).orderBy("i", "t").collect()
            yield context.broadcast(make([r.i for r in block], [r.t for r in block]))

    return parts, made()


def scans(docs: DataFrame, items: DataFrame, item_id: str, score: str, make: Callable) -> DataFrame:
    """doc_id, text_key and best window of each document and item; of several blocks each is scanned for, written out and released."""
    (parts, each), found = indexes(items, item_id, make), []
    for index in each:
        matches = scan(docs, index, items.schema[item_id].dataType, item_id, score)
        if parts == 1:
            return matches
        found.append(cut(matches))
        index.destroy()
    return reduce(DataFrame.union, found)


def scan(docs: DataFrame, index: Broadcast, id_type: T.DataType, item: str, score: str) -> DataFrame:
    """doc_id, text_key, item, score, char_start, char_end of the best window of each document and item of one block."""
    item_arrow = to_arrow_type(id_type)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in text_chunks(batch.column("text")):
                text, which, value, begin, end = index.value.matches(part)
                if len(text):
                    ids = pa.array([index.value.items.ids[i] for i in which.tolist()], item_arrow)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(text + at)), batch.column("text_key").take(pa.array(text + at)), ids, pa.array(value, pa.float64()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())],
                        ["doc_id", "text_key", item, score, "char_start", "char_end"],
                    )

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_key", T.LongType()), T.StructField(item, id_type), T.StructField(score, T.DoubleType()), T.StructField("char_start", T.LongType()), T.StructField("char_end", T.LongType())])
    return keyed(docs).mapInArrow(found, schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and benchmark item in it: doc_id, item_id, similarity, char_start, char_end."""
    return scans(docs, benchmark, "item_id", "similarity", lambda ids, texts: Index(ids, texts, threshold)).drop("text_key")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without any benchmark item, with all their columns.

    With one block of items they are filtered where they are read; with several, left out by the keys found.
    """
    make = lambda ids, texts: Index(ids, texts, threshold)
    parts, each = indexes(benchmark, "item_id", make)
    if parts == 1:
        index = next(each)

        @F.arrow_udf(T.BooleanType())
        def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                out = np.ones(len(texts), bool)
                for at, part in text_chunks(texts):
                    out[at + index.value.matches(part)[0]] = False
                yield pa.array(out)

        return docs.where(clean(F.col("text")))
    of, key = free(docs, "of", "key")
    leaks = scans(docs, benchmark, "item_id", "similarity", make).select(F.struct("doc_id", "text_key").alias(of)).distinct()
    return docs.withColumn(key, document_key()).join(leaks, F.col(key) == F.col(of), "left_anti").select(*docs.columns)
