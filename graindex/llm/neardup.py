"""Near-duplicate documents by DartMinHash over weighted word shingles.

A document is the multiset of its shingles of five words; the weight of a shingle is how often it occurs. The plane
(weight, rank) of a shingle holds a fixed random set of darts, one for each unit of area, made by hashing. The plane
is cut into regions of doubling weight; darts of a region come in order of rank. A document keeps the darts below its
weights and below a rank that lets through about k ln k + 2 k darts whatever its size; each dart belongs to one of k
coordinates, and the earliest of a coordinate is its value. Two documents agree in a coordinate with the probability
of their weighted Jaccard similarity. Where a coordinate stays empty, the rank is doubled for that document.

Values are banded; candidate pairs are verified by the exact weighted Jaccard similarity of their shingles, which
must be ``THRESHOLD`` or more, and groups are the connected components (see components.py).

Documents of one to four words have one shingle of all their words. Texts with the same words are copies (case and
punctuation don't count); texts without words (null, empty, punctuation) are copies of nothing and stay alone.
Words and texts are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import band_keys, similar_components
from .session import bounded_batches, cut, document_key, free, keyed
from .textkernel import Runs, Words, mix, shingles, text_chunks

WORDS, THRESHOLD = 5, 0.8
#: 16 bands of 5: a pair of similarity 0.8 meets with probability 0.998.
BANDS, ROWS = 16, 5


def multiplicities(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) with their numbers of occurrences."""
    order = np.argsort(hashes)
    # a stable sort of 16-bit numbers takes one pass for each byte
    order = order[np.argsort(text[order].astype(np.uint16 if text.max(initial=0) < 1 << 16 else np.int64), kind="stable")]
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return h[at], t[at], np.diff(np.append(at, len(h)))


def _uniform(x: np.ndarray) -> np.ndarray:
    """From hashes to (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def dart_minhash(hashes: np.ndarray, text: np.ndarray, weight: np.ndarray, texts: int, k: int) -> np.ndarray:
    """Signatures (texts x k) of weighted sets given as (element hash, text, weight > 0); empty sets get zeros."""
    out = np.zeros((texts, k), np.uint64)
    total = np.bincount(text, weights=weight, minlength=texts)
    limit = np.zeros(texts)
    np.divide(k * (np.log(k) + 2), total, out=limit, where=total > 0)
    cells = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    cell = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    low = np.where(cell > 0, 2.0 ** (cell - 1), 0.0)
    width = np.where(cell > 0, low, 1.0)
    of, most = np.repeat(text, cells), np.repeat(weight, cells)
    seed = mix(np.repeat(hashes, cells) + cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    left = np.flatnonzero(total > 0)
    while len(left):
        wanted = np.zeros(texts, bool)
        wanted[left] = True
        live = np.flatnonzero(wanted[of])
        rank, found, step = np.zeros(len(live)), [], 0
        while len(live):
            step += 1
            dart = mix(seed[live] + np.uint64(step * 0xD1B54A32D192ED03 & (1 << 64) - 1))
            rank = rank - np.log(_uniform(dart)) / width[live]
            on = rank <= limit[of[live]]
            live, rank, dart = live[on], rank[on], dart[on]
            hit = low[live] + width[live] * _uniform(mix(dart ^ np.uint64(0xA5A5))) <= most[live]
            found.append((of[live[hit]] * k + (mix(dart[hit] ^ np.uint64(0x5C5C)) % np.uint64(k)).astype(np.int64), rank[hit], dart[hit]))
        place, rank, dart = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((rank, place))
        place, dart = place[order], dart[order]
        new = np.ones(len(place), bool)
        new[1:] = place[1:] != place[:-1]
        full = np.zeros(texts * k, bool)
        full[place[new]] = True
        out.ravel()[place[new]] = dart[new]
        left = left[~full.reshape(texts, k)[left].all(1)]
        limit[left] *= 2
    return out


def content_hashes(words: Words) -> np.ndarray:
    """A hash of all words of each text in their order; 0 for a text without words."""
    n = words.counts()
    h = Runs(words.hash).hash(words.bounds[:-1], words.bounds[1:], 0xC0)
    return np.where(n > 0, h | np.uint64(1), np.uint64(0)).view(np.int64)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_key, node (the hash of the text's words, null without words) and band keys of each document."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys = [np.zeros(0, np.int64)], [np.zeros((0, bands), np.int64)]
            for _, part in text_chunks(batch.column("text")):
                words = Words(part)
                h, text, weight = multiplicities(*shingles(words, WORDS)[:2])
                nodes.append(content_hashes(words))
                keys.append(band_keys(dart_minhash(h, text, weight, len(part), bands * rows), rows))
            node, key = np.concatenate(nodes), np.concatenate(keys)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1, dtype=np.int32) * bands), pa.array(key.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(node, mask=node == 0), lists], ["doc_id", "text_key", "node", "keys"])

    return keyed(docs).mapInArrow(found, f"doc_id {dict(docs.dtypes)['doc_id']}, text_key long, node long, keys array<long>")


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A shingle that occurs n times as n features, so that Jaccard similarity is that of the weights."""
    h, text, weight = multiplicities(*shingles(Words(texts), WORDS)[:2])
    nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    return mix(np.repeat(h, weight) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.repeat(text, weight)


def pair_similarities(hashes: np.ndarray, pair: np.ndarray, side: np.ndarray, pairs: int, weighted: bool = True) -> np.ndarray:
    """Jaccard similarity of the two sides of each pair, of multisets if weighted; 0 if both are empty."""
    key = mix(hashes + pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    key, side, pair = key[order], side[order], pair[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(at, len(key)))
    right = np.add.reduceat(side.astype(np.int64), at) if len(key) else n
    left = n - right
    if not weighted:
        left, right = np.minimum(left, 1), np.minimum(right, 1)
    both, either = (np.bincount(pair[at], weights=f(left, right), minlength=pairs) for f in (np.minimum, np.maximum))
    return np.divide(both, either, out=np.zeros(pairs), where=either > 0)


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, text_key, and those of the document that stands for its group: class_id, class_key.

    That is the least by doc_id, then text_key; null ids come last. Repeated rows are repeated.
    """
    with bounded_batches(docs.sparkSession):
        held = cut(signatures(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    nodes = cut(held.where("node is not null").groupBy("node").agg(first))

    def texts(wanted: DataFrame) -> DataFrame:
        one = nodes.join(wanted, "node").select("node", F.struct("first.doc_id", "first.text_key").alias("at"))
        rows = docs.select(document_key().alias("of"), "text").join(one, F.col("of") == F.col("at"))
        return rows.select("node", "text").dropDuplicates(["node"])

    groups = similar_components(held, texts, features, THRESHOLD)
    found = nodes.join(groups, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    least = cut(found.groupBy(F.col("component").alias("of")).agg(F.min("first").alias("first")))
    # written out, so that the joins stand right on their shuffles and Spark can split a frequent node or class
    classes = cut(found.select("node", "component").join(least, F.col("component") == F.col("of")).select("node", F.col("first.doc_id").alias("class_id"), F.col("first.text_key").alias("class_key")))
    alone = F.col("node").isNull()
    rows = held.drop("keys").join(classes, "node", "left")
    return rows.select(
        "doc_id", "text_key", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("text_key")).otherwise(F.col("class_key")).alias("class_key")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns: the least (doc_id, text_key) of a group stays, null ids last.

    Of rows that share doc_id and text one stays.
    """
    of, key = free(docs, "of", "key")
    stays = near_duplicate_classes(docs).where("doc_id <=> class_id and text_key = class_key")
    kept = stays.select(F.struct("doc_id", "text_key").alias(of)).distinct()
    rows = docs.withColumn(key, document_key()).dropDuplicates([key])
    return rows.join(kept, F.col(key) == F.col(of), "left_semi").select(*docs.columns)
