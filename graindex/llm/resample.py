"""Importance resampling towards a target distribution, exact to the row.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z are lower-cased; features are all runs of 1 to
``ngram`` words joined by one space. Each feature falls into one of ``buckets`` buckets by the crc32 of its bytes. Bucket
counts of all documents and of all target texts give an array of gains, floor(1000 ln((t+1)(S+B)/((s+1)(T+B)))), and
a document's weight is the floored mean gain of its features. With a Gumbel variate of the document's id, the highest
scores are a draw without replacement by weight.

The draw is an external merge. Each task sorts its eligible rows that can still be drawn into runs, cuts them at the
bounds of score slices and writes the pieces to the shared folder. The pieces of a slice are merged by a tournament
tree in one task, which starts counting behind the rows of all higher slices and stops at the exact number to draw;
slices behind that number are never read. Slices have about ``SLICE`` rows: the bounds are keys of single rows, taken from a
sample of the rows' hashes, so that not even rows of one id fill a slice. The driver gets counts only: buckets, scores (whole thousandths of logarithms, so
some 10**5 different ones at any size of corpus), bounds and slices.

A null text has no features: weight 0, not eligible. A null id is drawn by the hash of an empty id and ranks behind
all other ids of its score. Repeated rows take part one by one; equal rows may swap ranks, which changes no result. An
empty table gives none; an empty target gives gains against no counts. Other columns are not read unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import cut, free, release
from .textkernel import text_chunks

#: Rows of a slice, which one task merges, and sampled rows a slice from which bounds are taken.
SLICE, PER_SLICE = 200_000, 64
#: Rows of a sorted run, and numbers in the key of a row.
RUN, WIDTH = 100_000, 5
#: Bytes that separate words become spaces; A-Z become a-z. Bytes from 0x80 belong to words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or b >= 97 and b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: str, ngram: int) -> tuple[list[bytes], int]:
    """All features of a text, and how many words it has."""
    words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split()
    if ngram == 1:
        return words, len(words)
    return [b" ".join(words[i : i + k]) for k in range(1, ngram + 1) for i in range(len(words) - k + 1)], len(words)


def bucket_counts(texts: DataFrame, buckets: int = 10_000, ngram: int = 1, text: str = "text") -> DataFrame:
    """bucket, n: the features of all texts by bucket, summed up in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in text_chunks(batch.column(0)):
                hashed = np.fromiter((crc32(f) for t in part for f in features(t, ngram)[0]), np.int64)
                n += np.bincount(hashed % buckets, minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"bucket": some, "n": n[some]})

    return texts.select(F.col(text)).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = 10_000, ngram: int = 1, text: str = "text") -> np.ndarray:
    """The gain of each bucket, in thousandths, from the counts of all documents and all target texts."""
    counted = []
    for texts in (docs, target):
        n = np.zeros(buckets)
        rows = bucket_counts(texts, buckets, ngram, text).toArrow()
        n[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
        counted.append(n)
    s, t = counted
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def noise(id_: int | None, seed: int) -> int:
    """A Gumbel variate in thousandths, from the first 32 bits of a digest of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, gain: np.ndarray, ngram: int, min_words: int, seed: int, id_: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row a document: id, ``keep``, n_features, weight, score, eligible and row_key, a number of its own."""
    rows = docs.select(F.col(id_), *(F.col(f"`{c}`") for c in keep), F.col(text).alias(free(docs, "_text")[0]))
    own = [T.StructField(n, T.LongType()) for n in ("n_features", "weight", "score")] + [T.StructField("eligible", T.BooleanType()), T.StructField("row_key", T.LongType())]
    names = [*rows.columns[:-1], *(f.name for f in own)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_key = TaskContext.get().partitionId() << 33
        for batch in batches:
            last = batch.num_columns - 1
            for at, part in text_chunks(batch.column(last)):
                told = [features(t, ngram) for t in part]
                n = [len(f) for f, _ in told]
                weight = [int(gain[np.fromiter(map(crc32, f), np.int64, len(f)) % len(gain)].sum()) // len(f) if f else 0 for f, _ in told]
                scores = [w + noise(i, seed) for w, i in zip(weight, batch.column(0).slice(at, len(part)).to_pylist(), strict=True)]
                made = [n, weight, scores, [w >= min_words for _, w in told], np.arange(row_key, row_key + len(part))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, len(part)) for i in range(last)), *map(pa.array, made)], names=names)
                row_key += len(part)

    return rows.mapInArrow(score, T.StructType([*rows.schema.fields[:-1], *own]))


class Tournament:
    """Sorted sequences merged by a tree of losers: each key taken costs one comparison a level."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self.play(i)

    def play(self, i: int) -> None:
        """Let run ``i`` play its way up; where no run has played before, it waits."""
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = i
                return
            if self.heads[i] is None or self.heads[other] is not None and self.heads[other] < self.heads[i]:
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self.heads[winner := self.losers[0]]) is not None:
            yield head
            self.heads[winner] = next(self.runs[winner], None)
            self.play(winner)


def _bounds(rows: DataFrame, many: int) -> list[tuple]:
    """Keys that cut ``many`` rows into slices of about SLICE rows."""
    slices = -(-many // SLICE)
    if slices < 2:
        return []
    share = min(1.0, slices * PER_SLICE / many)
    sample = rows.where(F.pmod(F.xxhash64("row_key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    keys = sorted(map(tuple, sample.collect()))
    step = max(1, len(keys) // slices)
    return keys[step::step]


def rank_highest(scored: DataFrame, share: int, id_: str = "doc_id") -> DataFrame:
    """row_key, rank: the floor(share * N / 100) highest scores of the N eligible rows; ties go to smaller ids.

    ``scored`` must be a written table: it is read several times, and its row keys must stay what they are.
    """
    spark = scored.sparkSession
    counts = scored.where("eligible").groupBy("score").agg(F.count(F.lit(1)).alias("n")).toArrow()
    score, n = counts["score"].to_numpy(), counts["n"].to_numpy()
    order = np.argsort(-score)
    above = np.cumsum(n[order])
    draw = int(n.sum()) * share // 100
    if not draw:
        return spark.createDataFrame([], "row_key bigint, rank bigint")
    last = int(np.searchsorted(above, draw))
    lowest, many = int(score[order][last]), int(above[last])
    # the order of the draw as one ascending key; n_features tells rows of one id apart
    key = [(-F.col("score")).alias("down"), F.col(id_).isNull().cast("int").alias("nameless"), F.coalesce(F.col(id_).cast("long"), F.lit(0)).alias("id"), F.col("n_features"), F.col("row_key")]
    rows = scored.where(F.col("eligible") & (F.col("score") >= lowest)).select(*key)
    bounds = _bounds(rows, many)

    def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pieces() -> Iterator[pa.RecordBatch]:
            columns = pa.Table.from_batches(held).columns if held else []
            held.clear()
            if columns:
                keys = [c.to_numpy().astype(np.int64) for c in columns]
                order = np.lexsort(keys[::-1])
                run = np.stack(keys, axis=1)[order]
                ends = [_place(run, b) for b in bounds]
                for part, (a, b) in enumerate(zip([0, *ends], [*ends, len(run)], strict=True)):
                    if b > a:
                        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([b - a], pa.int64()), "run": pa.array([run[a:b].tobytes()], pa.binary())})

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= RUN:
                yield from pieces()
        yield from pieces()

    written = cut(rows.mapInArrow(sorted_runs, "part int, n bigint, run binary"))
    sizes = dict(written.groupBy("part").agg(F.sum("n")).collect())
    first, before = {}, 0
    for part in sorted(sizes):
        if before < draw:
            first[part] = before
        before += sizes[part]

    def merge(pieces: pa.Table) -> pa.Table:
        rank = first[pieces["part"][0].as_py()]
        runs = [map(tuple, np.frombuffer(x, np.int64).reshape(-1, WIDTH).tolist()) for x in pieces["run"].to_pylist()]
        taken = [k[-1] for k, _ in zip(Tournament(runs), range(draw - rank), strict=False)]
        return pa.table({"row_key": pa.array(taken, pa.int64()), "rank": pa.array(range(rank + 1, rank + 1 + len(taken)), pa.int64())})

    ranks = cut(written.where(F.col("part") <= max(first)).groupBy("part").applyInArrow(merge, "row_key bigint, rank bigint"))
    release(written)
    return ranks


def _place(run: np.ndarray, bound: tuple) -> int:
    """How many keys of a sorted run are below ``bound``."""
    low, high = 0, len(run)
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if tuple(run[middle]) < bound else (low, middle)
    return low


def resample(docs: DataFrame, target: DataFrame, share: int = 10, min_words: int = 20, buckets: int = 10_000, ngram: int = 1, seed: int = 2024, id_: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row a document: its id, n_features, weight, score and rank (1, 2, 3...; null where it isn't drawn), and ``keep``.

    Of the N documents of at least ``min_words`` words, floor(share * N / 100) are drawn. With ``keep=("text",)`` and
    ``rank is not null`` the result is the resampled corpus itself. Columns in ``keep`` named as results are left out.
    """
    keep = tuple(c for c in keep if c.lower() not in (id_.lower(), "n_features", "weight", "score", "eligible", "row_key", "rank"))
    gain = gains(docs, target, buckets, ngram, text)
    scored = cut(score_documents(docs, gain, ngram, min_words, seed, id_, text, keep))
    ranks = rank_highest(scored, share, id_)
    return scored.join(ranks, "row_key", "left").select(id_, "n_features", "weight", "score", "rank", *(f"`{c}`" for c in keep))
