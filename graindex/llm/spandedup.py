"""Substring dedup by sliding spans of sentences.

A sentence ends at ``.``, ``!``, ``?`` (before white space or the end) or a line feed. A sentence of more than
``LONG`` words is cut further after the word of least hash in every window of ``PIECE`` words, so that a passage
without sentence ends is cut alike wherever it stands, but for PIECE - 1 words at its ends. A *span* is a run of
consecutive sentences that has ``SENTENCES`` of them or more and ``WORDS`` words or more, and is the shortest such run
that begins, or the shortest that ends, with its first or last sentence. Each sentence of a longer run is in a span
inside it: in the one that begins with the run, or else in one that ends with the sentence. So the sentences that
spans cover are those that all runs would cover. Spans are compared by a hash of their words: case, punctuation and
white space don't count.

The first place of a span is its first one in the first document that holds it, by doc_id (null ids last) and then by a
hash of the text, so documents that share an id, or have none, are told apart. Every sentence covered by a span at
another place is removed. Repeats inside one document are told apart where the document is read. The first shuffle
holds a hash and a count, summed before it; only spans that repeat carry their places on.

Null and empty texts have no spans. Rows that share doc_id and text are one document, and all of them stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import bounded_batches, cut, document_key, free, keyed
from .textkernel import Runs, Words, text_chunks

#: With sentences of at most 25 words, a passage of more than 50 words that begins or ends with a sentence holds a span;
#: so does one of 49 words inside a longer sentence.
SENTENCES, WORDS, LONG = 2, 20, 25
#: A piece of a long sentence ends in every window of so many words.
PIECE = 8
_ENDS = np.array([ord(c) for c in ".!?"], np.uint32)


class Spans:
    """Sentences and spans of a few texts.

    Sentences: ``text``, the words [``low``, ``high``) and their characters [``begin``, ``end``) in the text, up to
    where the next sentence begins. Spans: ``first`` and ``last`` sentence (inclusive), ``hash``, and ``again`` if
    an earlier place of the same text has the same span.
    """

    def __init__(self, texts: list[str]):
        words = Words(texts)
        cp, n = words.cp, len(words.hash)
        blank = (cp == 32) | ((cp >= 9) & (cp <= 13)) | (cp == 0xA0)
        stop = np.isin(cp, _ENDS)
        stop[:-1] &= blank[1:]
        stop |= cp == 10
        stops = np.append(0, np.cumsum(stop))
        # a word closes its sentence if a stop stands between it and the next word
        next_begin = np.append(words.begin[1:], len(cp))
        closes = stops[next_begin] > stops[words.end]
        closes |= np.append(words.text[1:] != words.text[:-1], True)[:n]
        high = np.flatnonzero(closes) + 1
        low = np.append(0, high)[:-1]
        sentence = np.repeat(np.arange(len(low)), high - low)
        many = max(0, n - PIECE + 1)
        at = np.flatnonzero((sentence[:many] == sentence[PIECE - 1 :]) & ((high - low)[sentence[:many]] > LONG))
        closes[at + PIECE - 1 - words.hash[at[:, None] + np.arange(PIECE)[::-1]].argmin(1)] = True
        self.high = np.flatnonzero(closes) + 1
        self.low = np.append(0, self.high)[:-1]
        self.text = words.text[self.low]
        base, size = words.starts[self.text], words.lens[self.text]
        self.begin = words.begin[self.low] - base
        leads = np.append(True, self.text[1:] != self.text[:-1])[: len(self.text)]
        self.begin[leads] = 0
        self.end = np.where(np.append(leads[1:], True)[: len(leads)], size, np.append(self.begin[1:], 0)[: len(leads)])
        # from each sentence to the first one, and back to the last one, that makes enough sentences and words
        s = np.arange(len(self.low))
        last = np.maximum(s + SENTENCES - 1, np.searchsorted(self.high, self.low + WORDS))
        first = np.minimum(s - SENTENCES + 1, np.searchsorted(self.low, self.high - WORDS, side="right") - 1)
        on, back = last < len(s), first >= 0
        on[on] = self.text[last[on]] == self.text[s[on]]
        back[back] = self.text[first[back]] == self.text[s[back]]
        both = np.unique(np.concatenate([s[on] * len(s) + last[on], first[back] * len(s) + s[back]]))
        self.first, self.last = both // max(1, len(s)), both % max(1, len(s))
        self.hash = Runs(words.hash).hash(self.low[self.first], self.high[self.last], 0x59).view(np.int64)
        order = np.lexsort((self.first, self.hash, self.text[self.first]))
        h, t = self.hash[order], self.text[self.first][order]
        self.again = np.zeros(len(order), bool)
        self.again[order[1:]] = (h[1:] == h[:-1]) & (t[1:] == t[:-1])


def span_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, hash and place of every span: first character * 2**32 + last (exclusive), negative if not the first place in its text."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in text_chunks(batch.column("text")):
                s = Spans(part)
                row = pa.array(s.text[s.first] + at)
                place = (s.begin[s.first].astype(np.int64) << 32) + s.end[s.last]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(row), batch.column("text_key").take(row), pa.array(s.hash), pa.array(np.where(s.again, -place, place))],
                    ["doc_id", "text_key", "hash", "place"],
                )

    return keyed(docs).mapInArrow(found, f"doc_id {dict(docs.dtypes)['doc_id']}, text_key long, hash long, place long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Spans at another place than their first: doc_id, text_key, char_start, char_end, first_doc_id."""
    with bounded_batches(docs.sparkSession):
        spans = span_table(docs)
        # tables that are joined are written out, so that a join stands right on its shuffles and Spark can split the rows of a frequent span
        seen = cut(spans.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"))
        spans = cut(spans.join(seen, "hash"))
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    first = cut(spans.groupBy("hash").agg(F.min(at).alias("first")))
    met = spans.join(first, "hash").where((F.col("place") < 0) | (at != F.col("first")))
    begin, end = F.shiftright(F.abs("place"), 32).cast("int"), F.abs("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    return met.select("doc_id", "text_key", begin.alias("char_start"), end.alias("char_end"), F.col("first.doc_id").alias("first_doc_id"))


def removals(docs: DataFrame) -> DataFrame:
    """For each document that loses text: doc_id, text_key, gone array<struct<char_start, char_end>>, first_doc_ids."""
    return (
        repeated_spans(docs)
        .groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.collect_set(F.struct("char_start", "char_end"))).alias("gone"), F.array_sort(F.collect_set("first_doc_id")).alias("first_doc_ids"))
    )


def without(text: str, gone: list[tuple[int, int]]) -> str:
    """``text`` without the character ranges, which are in order and may overlap."""
    out, at = [], 0
    for lo, hi in gone:
        out.append(text[at : max(at, lo)])
        at = max(at, hi)
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([t if s is None else without(t, list(zip(s, e, strict=True))) for t, s, e in zip(texts, starts, ends, strict=True)], dtype=object)


def changed_documents(docs: DataFrame) -> DataFrame:
    """The documents that lose text: doc_id, first_doc_ids (null ones left out), removed_chars, and the text that is left."""
    lost = removals(docs).select(F.struct("doc_id", "text_key").alias("of"), "gone", "first_doc_ids")
    rows = docs.select("doc_id", "text", document_key().alias("key")).join(lost, F.col("key") == F.col("of"))
    left = rows.withColumn("left", _without("text", F.col("gone.char_start"), F.col("gone.char_end")))
    return left.select("doc_id", "first_doc_ids", (F.length("text") - F.length("left")).cast("long").alias("removed_chars"), F.col("left").alias("text"))


def dedup_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated sentences removed from ``text``, and all other columns."""
    key, of, lost = free(docs, "key", "of", "lost")
    gone = removals(docs).select(F.struct("doc_id", "text_key").alias(of), F.col("gone").alias(lost))
    rows = docs.withColumn(key, document_key()).join(gone, F.col(key) == F.col(of), "left")
    return rows.withColumn("text", _without("text", F.col(f"{lost}.char_start"), F.col(f"{lost}.char_end"))).select(*docs.columns)
