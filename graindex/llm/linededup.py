"""Fuzzy line dedup: of all lines of all documents that are alike, directly or through others, one stays.

Lines end at line feeds; they are compared in lower case with white space trimmed and runs of it as one space. A
line is the set of its character 6-grams (a shorter line is one gram). MinHash signatures are banded for high recall
(two lines of Jaccard similarity 0.8 meet with probability 0.99), candidates are verified by the exact Jaccard
similarity, which must be ``THRESHOLD`` or more, and a distributed union-find joins them (components.py). Equal
lines are one item throughout. The line that stays is the one with the least (doc_id, text_key, line number).

Lines of ``LONG`` distinct grams or more take all values of a signature from one hash (one bin of grams for each value, empty
bins filled from others); shorter ones, where bins would be empty, take one hash for each value. Lines up to
LONG / 0.8 do both, so that any two lines of similarity 0.8 have a kind in common.

Blank lines are left alone. Null and empty texts have no lines and are unchanged. A document all of whose lines but
blank ones go is dropped by ``dedup_lines``: its content stands elsewhere. Rows that share doc_id and text repeat
each other's lines: the lines of one of them stay as far as those of other documents let them, and all lines of the
others go. Null ids come last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import band_keys, similar_components
from .neardup import multiplicities
from .session import bounded_batches, cut, document_key, free, keyed
from .textkernel import Runs, code_points, give_back, spread, tables, text_chunks

GRAM, THRESHOLD, LONG = 6, 0.8, 64
BANDS, ROWS = 12, 5
_SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)
#: A character that isn't white space.
_SOLID = "[^" + "".join(f"\\x{{{c:x}}}" for c in _SPACES.tolist()) + "]"


class Lines:
    """The lines of a few texts, blank ones left out: text, number in the text, content hash (node) and grams."""

    def __init__(self, texts: list[str]):
        cp, starts, _ = code_points(texts)
        space = np.zeros(max(0x3001, int(cp.max(initial=0)) + 1), bool)
        space[_SPACES] = True
        solid, feed = ~space[cp], cp == 10
        begins = np.append(0, np.flatnonzero(feed) + 1)[:-1]  # each text ends with a line feed
        # of a run of white space the last character stays, if the line has something before and after it
        inner = ~solid & ~feed
        inner[:-1] &= solid[1:]
        inner[-1:] = False
        keep = solid.copy()
        keep[1:] |= inner[1:] & solid[:-1]
        inner &= ~keep
        if len(open_ := np.flatnonzero(inner)):  # runs of two and more, and those at the beginning of a line
            at = np.flatnonzero(solid)
            before = np.searchsorted(at, open_) - 1
            first = begins[np.searchsorted(begins, open_, side="right") - 1]
            keep[open_[(before >= 0) & (at[before] >= first)]] = True
        chars = np.where(solid, cp, np.uint32(32))[keep]
        count = np.add.reduceat(keep, begins, dtype=np.int64) if len(begins) else begins
        some = np.flatnonzero(count)
        self.end = np.cumsum(count)[some]
        self.start = self.end - count[some]
        self.runs = Runs(tables()[3][chars])
        self.node = (self.runs.hash(self.start, self.end, 0x11) | np.uint64(1)).view(np.int64)
        self.text = np.searchsorted(starts, begins[some], side="right") - 1
        self.number = some - np.searchsorted(begins, starts)[self.text]

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Gram hashes of all lines one after another, and the place of each line's first."""
        size = self.end - self.start
        many = np.maximum(size - GRAM + 1, 1)
        h = np.zeros(int(self.end[-1]) if len(size) else 0, np.uint64)
        h[: max(0, len(h) - GRAM + 1)] = self.runs.hash_all(GRAM)
        short = size < GRAM
        h[self.start[short]] = self.runs.hash(self.start[short], self.end[short])
        keep = np.ones(len(h), bool)
        keep[spread(self.start + many, size - many)[0]] = False
        return h[keep], np.cumsum(many) - many


def minhash(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Signatures of the sets that begin at the places ``at`` of ``h``, by a hash for each value."""
    seeds = np.random.default_rng(20).integers(0, 1 << 32, (k, 2), dtype=np.uint32)
    low = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at), k), np.uint64)
    for i, (x, odd) in enumerate(seeds):
        out[:, i] = np.minimum.reduceat((low ^ x) * (odd | np.uint32(1)), at)
    return out


def binned_minhash(h: np.ndarray, of: np.ndarray, sets: int, k: int) -> np.ndarray:
    """Signatures of the sets ``of``: the least hash of each of k bins, empty bins filled from bins drawn in a fixed order."""
    none = np.uint32(0xFFFFFFFF)
    out = np.full(sets * k, none, np.uint32)
    bins = ((h >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(out, of * k + bins, h.astype(np.uint32))
    full = out.reshape(sets, k)
    filled, rng = full.copy(), np.random.default_rng(21)
    open_sets = np.flatnonzero((full == none).any(1))
    while len(open_sets):
        source = rng.integers(0, k, k)
        part = filled[open_sets]
        filled[open_sets] = np.where(part == none, full[open_sets][:, source], part)
        open_sets = open_sets[(filled[open_sets] == none).any(1)]
    return filled.astype(np.uint64)


def _of(h: np.ndarray, at: np.ndarray, many: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grams of the lines ``some``, and which of these each belongs to."""
    place, of = spread(at[some], many[some])
    return h[place], of


def _filled(h: np.ndarray, of: np.ndarray, sets: int, bits: int = 9) -> np.ndarray:
    """At least how many distinct grams each set has: the places that they fill of a table of 2**bits."""
    full = np.zeros((sets, 1 << bits), bool)
    full[of, (h >> np.uint64(64 - bits)).astype(np.int64)] = True
    return full.sum(1)


def distinct_grams(h: np.ndarray, of: np.ndarray, sets: int) -> np.ndarray:
    """The number of distinct grams of each set."""
    key = (of.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=sets)


def line_keys(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of all lines one after another, and their number for each line."""
    h, at = lines.grams()
    many = np.diff(np.append(at, len(h)))
    line = np.repeat(np.arange(len(at)), many)
    # the kind goes by distinct grams, as similarity does; a line of few grams has no more of them
    distinct = many.copy()
    some = np.flatnonzero(many >= LONG)
    if len(some):
        distinct[some] = _filled(*_of(h, at, many, some), len(some))
        # most lines fill enough places to be long beyond doubt; only the others are counted
        some = some[distinct[some] < LONG / THRESHOLD]
        distinct[some] = distinct_grams(*_of(h, at, many, some), len(some))
    short, long = distinct < LONG / THRESHOLD, distinct >= LONG
    keys, owner = [], []
    for kind, mask in ((0, short), (1, long)):
        mine = np.flatnonzero(mask)
        if len(mine):
            inside = mask[line]
            grams, n = h[inside], many[mine]
            k = BANDS * ROWS
            signature = binned_minhash(grams, np.repeat(np.arange(len(mine)), n), len(mine), k) if kind else minhash(grams, np.cumsum(n) - n, k)
            keys.append(band_keys(signature, ROWS, kind).ravel())
            owner.append(np.repeat(mine, BANDS))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(keys)[order], np.bincount(owner, minlength=len(at))


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no, node and band keys of every line that isn't blank."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in text_chunks(batch.column("text")):
                lines = Lines(part)
                keys, many = line_keys(lines)
                row = pa.array(lines.text + at)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), pa.array(keys))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(row), batch.column("text_key").take(row), pa.array(lines.number.astype(np.int32)), pa.array(lines.node), lists],
                    ["doc_id", "text_key", "line_no", "node", "keys"],
                )
        give_back()

    return keyed(docs).mapInArrow(found, f"doc_id {dict(docs.dtypes)['doc_id']}, text_key long, line_no int, node long, keys array<long>")


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of each text, which is one line."""
    lines = Lines(texts)
    h, at = lines.grams()
    return multiplicities(h, np.repeat(lines.text, np.diff(np.append(at, len(h)))))[:2]


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and text of the lines named in ``wanted`` (doc_id, text_key, line_no, node); repeated rows give them again."""
    lists = wanted.groupBy(F.struct("doc_id", "text_key").alias("at")).agg(F.collect_list(F.struct("line_no", "node")).alias("wanted"))
    rows = docs.select(document_key().alias("of"), "text").join(lists, F.col("of") == F.col("at")).select("text", "wanted")

    def cutout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, texts = [], []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                lines = text.split("\n")
                nodes += [w["node"] for w in wanted]
                texts += [lines[w["line_no"]] for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(texts, pa.string())], ["node", "text"])
        give_back()

    return rows.mapInArrow(cutout, "node long, text string")


def _place() -> Column:
    """Where a line stands, in the order in which lines stay."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "line_no")


def _decisions(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines of documents that go (doc_id, text_key, line_no, kept), and the lines that stay for others or for repeated rows (kept)."""
    with bounded_batches(docs.sparkSession):
        lines = cut(line_table(docs))
    nodes = cut(lines.groupBy("node").agg(F.min(_place()).alias("least"), F.count(F.lit(1)).alias("n")))

    def texts(wanted: DataFrame) -> DataFrame:
        one = nodes.join(wanted, "node").select("least.*", "node")
        return line_texts(docs, one).dropDuplicates(["node"])

    groups = similar_components(lines, texts, features, THRESHOLD)
    found = cut(nodes.join(groups, "node", "left").select("node", "least", "n", F.coalesce("component", "node").alias("component")))
    kept = cut(found.groupBy(F.col("component").alias("of")).agg(F.min("least").alias("kept"), F.sum("n").alias("lines")).where("lines > 1"))
    # written out, so that the join stands right on its shuffles and Spark can split the rows of a frequent line
    after = cut(found.join(kept, F.col("component") == F.col("of")).select(F.col("node").alias("of"), "kept"))
    gone = lines.drop("keys").join(after, F.col("node") == F.col("of")).where(_place() != F.col("kept"))
    return gone.select("doc_id", "text_key", "line_no", "kept"), kept.select("kept")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """The lines that go: doc_id, text_key, line_no, and the line that stays for each: kept_doc_id, kept_line_no.

    Of a line that stays in one of several rows of the same doc_id and text, each further row gives one, gone for itself.
    """
    gone, kept = _decisions(docs)
    rows = docs.groupBy(document_key().alias("at")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    again = kept.join(rows, F.struct("kept.doc_id", "kept.text_key") == F.col("at")).withColumn("nth", F.explode(F.sequence(F.lit(2).cast("long"), F.col("rows"))))
    every = gone.union(again.select("kept.doc_id", "kept.text_key", "kept.line_no", "kept"))
    return every.select("doc_id", "text_key", "line_no", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no"))


@F.arrow_udf(T.StringType())
def _without(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Texts without the lines of these numbers; null where no line but blank ones is left."""
    for texts, gone in batches:
        parts = [pa.array([], pa.string())]
        for at, part in text_chunks(texts, None):
            out = []
            for text, numbers in zip(part, gone.slice(at, len(part)).to_pylist(), strict=True):
                if text is None or numbers is None:
                    out.append(text)
                    continue
                drop = set(numbers)
                left = [x for i, x in enumerate(text.split("\n")) if i not in drop]
                out.append("\n".join(left) if any(x.strip() for x in left) else None)
            parts.append(pa.array(out, pa.string()))
        yield pa.concat_arrays(parts)
    give_back()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated lines; documents that keep no line but blank ones are dropped.

    Of rows that share doc_id and text and have a line, one stays, any of them.
    """
    key, of, lost, left = free(docs, "key", "of", "lost", "left")
    lists = _decisions(docs)[0].groupBy(F.struct("doc_id", "text_key").alias(of)).agg(F.collect_set("line_no").alias(lost))
    has_line = F.coalesce(F.col("text").rlike(_SOLID), F.lit(False))
    rows = docs.where(has_line).withColumn(key, document_key()).dropDuplicates([key])
    rows = rows.join(lists, F.col(key) == F.col(of), "left").withColumn(left, _without(F.col("text"), F.col(lost)))
    rows = rows.where(F.col(lost).isNull() | F.col(left).isNotNull()).withColumn("text", F.col(left)).select(*docs.columns)
    return rows.union(docs.where(~has_line))
