"""Periodic runs of words: every maximal stretch that repeats one block, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and length of at least
``max(24, 3 * q)`` that no neighbouring word extends keeping period q. A run of length L agrees with itself q words on in
L - q places, and L - q >= 16 whatever q is, so each of its words lies in a 16-gram that occurs at least twice in the
same document. Words outside such grams cannot join a run. They are masked first, by hashes of all 16-grams; equal grams
have equal hashes, so a collision only leaves a word unmasked.

What survives is a few short stretches of most corpora. Those are ranked by prefix doubling (equal ranks mean equal
words, exactly) and searched as by Main and Lorentz: split a segment in the middle; a run across the middle holds a whole
period on one side of it, so for each period p the common extensions of the places p apart at the middle give the run.
All segments of one level of the halving are one set of array operations. A run found is maximal as it stands, since the
extensions read past the halves; periods that agree in less than 8 words at the middle are left at once, since one of
the two extensions of a run across it has 8 or more.

Words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text has no words, no runs and an empty collapsed text. Every row is
answered by itself, repeated rows and null ids too. Texts of any length are read whole; neighbouring short ones are
handled together. Extra columns are kept; columns named as the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import free
from .textkernel import Runs, mix, text_chunks

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: The least number of places in which a run agrees with itself one period on, over all periods.
OVERLAP = min(max(LEAST_WORDS, LEAST_PERIODS * q) - q for q in range(1, LEAST_WORDS + 1))
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])


def masked(words: np.ndarray, doc: np.ndarray, k: int = OVERLAP) -> np.ndarray:
    """Which words lie in a k-gram that occurs at least twice in their document (words and documents as numbers)."""
    inside = np.zeros(len(words) + 1, np.int32)
    if len(words) < k:
        return inside[:-1] > 0
    grams = Runs(mix(words.astype(np.uint64) + np.uint64(0x2545F491))).hash_all(k)
    whole = np.flatnonzero(doc[k - 1 :] == doc[: len(doc) - k + 1])
    keys = mix(grams[whole] ^ mix(doc[whole].astype(np.uint64) + np.uint64(0x1F83D9AB)))
    order = np.argsort(keys, kind="stable")
    again = keys[order][1:] == keys[order][:-1]
    at = whole[np.unique(np.concatenate([order[1:][again], order[:-1][again]]))]
    np.add.at(inside, at, 1)
    np.add.at(inside, at + k, -1)
    return np.cumsum(inside[:-1]) > 0


class Ranks:
    """Exact equality of stretches of a sequence of numbers: ``by[j][i]`` names the 2**j numbers from i on."""

    def __init__(self, symbols: np.ndarray, longest: int):
        self.n, self.by = len(symbols), [np.unique(symbols, return_inverse=True)[1].astype(np.int64)]
        while 1 << len(self.by) <= longest:
            last, step = self.by[-1], 1 << len(self.by) - 1
            pairs = last[:-step] * (last.max() + 1) + last[step:]
            self.by.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers agree from places a and b on."""
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.by) - 1, -1, -1):
            rank = self.by[j]
            x, y = a + out, b + out
            fits = np.flatnonzero((x < len(rank)) & (y < len(rank)))
            fits = fits[rank[x[fits]] == rank[y[fits]]]
            out[fits] += 1 << j
        return out

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers agree before places a and b, which don't count themselves."""
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.by) - 1, -1, -1):
            rank, step = self.by[j], 1 << j
            x, y = a - out - step, b - out - step
            fits = np.flatnonzero((x >= 0) & (y >= 0))
            fits = fits[rank[x[fits]] == rank[y[fits]]]
            out[fits] += step
        return out


def segment_runs(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The runs (start, end, period) of segments ``bounds[i]:bounds[i + 1] - 1``; a number that occurs once ends each."""
    low, high = bounds[:-1], bounds[1:] - 1
    ranks = Ranks(symbols, int((high - low).max()))
    rank8, found = ranks.by[3], []
    while len(low):
        many = (high - low) // LEAST_PERIODS
        node = np.repeat(np.arange(len(low)), many)
        p = np.arange(len(node)) - np.repeat(np.cumsum(many) - many, many) + 1
        middle = (low + high)[node] // 2
        for a, b in ((middle, middle + p), (middle - p, middle)):
            # the stretch with period p around [a, b); words left of a and from a on are compared with those p further
            near = np.zeros(len(p), bool)
            for back in (0, 8):
                x, y = a - back, b - back
                fits = np.flatnonzero((x >= 0) & (y < len(rank8)))
                near[fits] |= rank8[x[fits]] == rank8[y[fits]]
            x, y = a[near], b[near]
            start, end = x - ranks.behind(x, y), y + ranks.ahead(x, y)
            q = y - x
            long = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
            found.append(np.stack([start[long], end[long], q[long]], axis=1))
        middle = (low + high) // 2
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        rest = high - low >= LEAST_WORDS
        low, high = low[rest], high[rest]
    runs = np.unique(np.concatenate(found), axis=0)
    # a stretch is found for multiples of its smallest period too: the first of each (start, end) has the smallest
    return runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))[: len(runs)]]


def runs_of(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The runs (start, end, period) of all documents of a sequence of words, by start, then period."""
    survives = masked(words, doc)
    edge = np.diff(np.concatenate([[0], survives.astype(np.int8), [0]]))
    # words of two documents never form one segment
    split = np.flatnonzero(survives[1:] & survives[:-1] & (doc[1:] != doc[:-1])) + 1
    begin = np.union1d(np.flatnonzero(edge == 1), split)
    end = np.union1d(np.flatnonzero(edge == -1), split)
    begin, end = begin[keep := end - begin >= LEAST_WORDS], end[keep]
    if not len(begin):
        return np.empty((0, 3), np.int64)
    bounds = np.concatenate([[0], np.cumsum(end - begin + 1)])
    symbols = np.empty(bounds[-1], np.int64)
    symbols[bounds[1:] - 1] = -1 - np.arange(len(begin))
    inside = np.ones(len(symbols), bool)
    inside[bounds[1:] - 1] = False
    shift = np.repeat(begin - bounds[:-1], end - begin)
    symbols[inside] = words[np.flatnonzero(inside) + shift]
    runs = segment_runs(symbols, bounds)
    moved = (begin - bounds[:-1])[np.searchsorted(bounds, runs[:, 0], side="right") - 1]
    runs[:, :2] += moved[:, None]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _answers(texts: list[str]) -> Iterator[tuple[int, list[dict], str]]:
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    ids: dict[bytes, int] = {}
    sizes = np.array([len(s) for s in split])
    words = np.fromiter((ids.setdefault(w, len(ids)) for s in split for w in s), np.int64, sizes.sum())
    doc, first = np.repeat(np.arange(len(split)), sizes), np.cumsum(sizes) - sizes
    runs = runs_of(words, doc)
    goes = np.zeros(len(words) + 1, np.int32)
    np.add.at(goes, runs[:, 0] + runs[:, 2], 1)
    np.add.at(goes, runs[:, 1], -1)
    stays = np.cumsum(goes[:-1]) == 0
    at = np.searchsorted(runs[:, 0], np.append(first, len(words)))
    for i, s in enumerate(split):
        own = runs[at[i] : at[i + 1]]
        kept = s if not len(own) else [s[j] for j in np.flatnonzero(stays[first[i] : first[i] + len(s)])]
        told = [{"start": int(a - first[i]), "length": int(b - a), "period": int(q)} for a, b, q in own]
        yield len(s), told, b" ".join(kept).decode("utf-8", "surrogatepass")


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add to each row n_words, runs (start, length, period; by start, then period) and collapsed.

    collapsed: the words that stay, joined by one space. A word goes if any run holds it after that run's first period.
    """
    rest = [c for c in docs.columns if c.lower() not in RESULT.names]
    rows = docs.select(*(F.col(f"`{c}`") for c in rest), F.col(text).alias(free(docs, "_text")[0]))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in text_chunks(batch.column(batch.num_columns - 1)):
                n, runs, collapsed = zip(*_answers(part), strict=True)
                own = [batch.column(i).slice(at, len(part)) for i in range(batch.num_columns - 1)]
                own += [pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays(own, names=[*batch.schema.names[:-1], *RESULT.names])

    return rows.mapInArrow(answer, T.StructType([*rows.schema.fields[:-1], *RESULT.fields]))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts of a tenth of the ids made periodic from some word on, to be found again.

    h = crc32 of the decimal doc_id and g = h div 10. Where h % 10 = 0 and the text has n > 0 words, each word i >= a becomes
    word a + (i - a) % p of the original, where a = g % n and p = 1 + (n - a) div (3 + g % 8). A null id plants nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    names = free(docs, "_h", "_words", "_n", "_a", "_p")
    h_, words_, n_, a_, p_ = names
    planted = (
        docs.withColumn(h_, h)
        .withColumn(words_, F.when(F.col(h_) % 10 == 0, words))
        .withColumn(n_, F.size(words_))
        .withColumn(a_, F.when(F.col(n_) > 0, F.expr(f"(`{h_}` div 10) % `{n_}`")))
        .withColumn(p_, F.expr(f"1 + (`{n_}` - `{a_}`) div (3 + (`{h_}` div 10) % 8)"))
    )
    made = F.array_join(F.transform(F.col(words_), lambda w, i: F.when(i < F.col(a_), w).otherwise(F.get(F.col(words_), (F.col(a_) + (i - F.col(a_)) % F.col(p_)).cast("int")))), " ")
    return planted.withColumn("text", F.when(F.col(n_) > 0, made).otherwise(F.col("text"))).drop(*names)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the run of greatest exact exponent, and digests of all runs and of the collapsed text."""
    best = F.aggregate(
        "runs",
        F.lit(None).cast(RUN),
        lambda x, r: F.when(x.isNull() | (r["length"] * x["period"] > x["length"] * r["period"]), r).otherwise(x),
    )
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
