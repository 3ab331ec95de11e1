"""Language identification: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

Subwords are the letter n-grams of one to four characters inside words (marked at word ends), of the whole text in
lower case, hashed to ``BUCKETS`` rows of an embedding table. A text is the mean of its rows; a linear layer gives a
logit for each language. Both are trained together in numpy by stochastic gradient descent on a bounded sample:
about ``SAMPLE`` documents of each language (fewer, if that would make more than ``ROWS`` in all), drawn by a hash of
doc_id and text. Every sampled text is learnt whole, and so are ``PIECES`` short pieces of it, drawn at random, so
that short texts are known too. Executors count the subwords; a document leaves them as counts of buckets, however
long it is. Only the text and lang of documents whose crc32(doc_id) modulo 4 isn't 2 are used. A quarter of the sample
isn't trained on; it sets the temperature of the softmax and the score below which a prediction is rejected: the
largest of at most ``REJECT_AT`` that rejects no more than ``REJECT_SHARE`` of the right predictions.

Prediction reads every whole text, by one table of BUCKETS x languages that is broadcast; nothing is shuffled. A
text that is null or has no letter is ``und`` with score 0, and rejected. Without labelled documents all are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import bounded_batches
from .textkernel import code_points, give_back, mix, spread, tables, text_chunks

BUCKETS_LOG2, ORDERS, DIM = 16, 4, 16
SAMPLE, ROWS, PIECES, PIECE = 400, 20_000, 4, 200
EPOCHS, BATCH, RATE = 4, 32, 8.0
#: Texts for calibration that are looked up together.
CALIBRATED = 200
REJECT_AT, REJECT_SHARE = 0.5, 0.001
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def subwords(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the buckets of the n-grams of all texts, and the text of each, in order of texts."""
    letter, _, _, symbol = tables()
    cp, starts, _ = code_points(texts)
    cp = np.append(np.uint32(10), cp)
    is_letter = letter[cp]
    beside = np.zeros(len(cp), bool)
    beside[:-1] = is_letter[1:]
    beside[1:] |= is_letter[:-1]
    keep = np.flatnonzero(is_letter | beside)
    inside = is_letter[keep]
    s = np.where(inside, symbol[cp[keep]], np.uint64(0x0123456789ABCDEF))
    text = np.searchsorted(starts, keep - 1, side="right") - 1
    for n in range(1, ORDERS + 1):
        m = len(s) - n + 1
        if m <= 0:
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h += s[j : j + m] * np.uint64((2 * j + 3) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        whole = inside[:m] | inside[n - 1 :]
        for j in range(1, n - 1):
            whole &= inside[j : j + m]
        at = np.flatnonzero(whole)
        # a mark before a word may stand where the text before ends
        yield (mix(h[at]) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64), text[at + (~inside[at] if n > 1 else 0)]


def bucket_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, bucket) of all orders with their numbers, in order of texts."""
    found = [np.zeros(0, np.int64), *[(t << BUCKETS_LOG2) + b for b, t in subwords(texts)]]
    key, count = np.unique(np.concatenate(found), return_counts=True)
    return key >> BUCKETS_LOG2, key & (1 << BUCKETS_LOG2) - 1, count


@dataclass
class Model:
    """A logit for each bucket and language; the logits of a text are their means plus ``bias``."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits (texts x languages) and the number of n-grams of each text."""
        sums, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for bucket, text in subwords(texts):
            n = np.bincount(text, minlength=len(texts))
            some = np.flatnonzero(n)
            if len(some):
                at = (np.cumsum(n) - n)[some]
                for k in range(len(self.languages)):
                    sums[some, k] += np.add.reduceat(self.table[k][bucket], at, dtype=np.float64)
            count += n
        return sums / np.maximum(count, 1)[:, None] + self.bias, count

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (0 to 1), and whether the prediction is rejected."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        logits, count = self.logits(texts)
        best = logits.argmax(1)
        score = np.where(count > 0, softmax(logits / self.temperature).max(1), 0.0)
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), count.tolist(), strict=True)], score, (score < self.threshold) | (count == 0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Sample:
    """Texts as counts of buckets: those of text i are at ends[i]:ends[i + 1]; its language, and whether it is for calibration."""

    ends: np.ndarray
    bucket: np.ndarray
    count: np.ndarray
    label: np.ndarray
    calibration: np.ndarray
    languages: list[str]

    def means(self, rows: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean of ``table`` over the buckets of each text, and the buckets and their shares one text after another."""
        n = self.ends[rows + 1] - self.ends[rows]
        place, _ = spread(self.ends[rows], n)
        share = self.count[place].astype(np.float32)
        at = np.cumsum(n) - n
        share /= np.repeat(np.add.reduceat(share, at), n)
        return np.add.reduceat(table[self.bucket[place]] * share[:, None], at), self.bucket[place], share


def train(sample: Sample, seed: int = 7) -> Model:
    """Fit on the texts that aren't for calibration, then set temperature and threshold on those that are."""
    rng, k = np.random.default_rng(seed), len(sample.languages)
    embedding = rng.normal(0, 1 / DIM, (1 << BUCKETS_LOG2, DIM)).astype(np.float32)
    weight, bias = rng.normal(0, 1, (DIM, k)).astype(np.float32), np.zeros(k, np.float32)
    some = np.diff(sample.ends) > 0
    fit = np.flatnonzero(~sample.calibration & some)
    steps, step = EPOCHS * (len(fit) // BATCH + 1), 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(fit), len(fit) // BATCH + 1):
            rate, step = RATE * (1 - step / steps), step + 1
            if not len(rows):
                continue
            mean, bucket, share = sample.means(rows, embedding)
            error = softmax(mean @ weight + bias)
            error[np.arange(len(rows)), sample.label[rows]] -= 1
            back = np.repeat((error @ weight.T).astype(np.float32), sample.ends[rows + 1] - sample.ends[rows], axis=0) * share[:, None]
            weight -= (rate / len(rows) * 0.1 * (mean.T @ error)).astype(np.float32)
            bias -= (rate / len(rows) * 0.01 * error.sum(0)).astype(np.float32)
            # steps of a batch that fall on one bucket are summed before they are made
            order = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
            embedding[bucket[order][first]] -= rate * np.add.reduceat(back[order], first)
    model = Model(sample.languages, np.ascontiguousarray((embedding @ weight).T), bias.astype(np.float64))
    held = np.flatnonzero(sample.calibration & some)
    if len(held):
        by_bucket, truth = np.ascontiguousarray(model.table.T), sample.label[held]
        logits = np.concatenate([sample.means(part, by_bucket)[0] for part in np.array_split(held, len(held) // CALIBRATED + 1)]) + model.bias
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(held)), truth] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
        p = softmax(logits / model.temperature)
        right = p.max(1)[p.argmax(1) == truth]
        model.threshold = min(REJECT_AT, float(np.quantile(right, REJECT_SHARE, method="lower"))) if len(right) else 0.0
    return model


def sampled(docs: DataFrame) -> Sample:
    """The training sample. Rows that share doc_id, text and lang are drawn together and learnt once."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("doc", F.xxhash64("doc_id", "text", F.lit(1)))
    counts = known.groupBy("lang").count().orderBy("lang").collect()  # a row a language
    most = min(SAMPLE, ROWS / max(1, len(counts)))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, most / r["count"]))]) if counts else F.create_map()
    drawn = known.where(F.pmod("doc", F.lit(1 << 30)) / (1 << 30) < F.coalesce(share[F.col("lang")], F.lit(0.0)) if counts else F.lit(False))
    # copies without an id would all be drawn together
    drawn = drawn.select("doc", "lang", "text").dropDuplicates(["doc", "lang"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, lang = batch.column("doc").to_pylist(), batch.column("lang").to_pylist()
            for i, text in enumerate(batch.column("text").to_pylist()):
                text, rng = text or "", np.random.default_rng(doc[i] & (1 << 63) - 1)
                pieces = [text]
                for size in rng.integers(8, PIECE, PIECES).tolist():
                    at = int(rng.integers(0, max(1, len(text) - size + 1)))
                    pieces.append(text[at : at + size])
                of, bucket, count = bucket_counts(pieces)
                ends = np.searchsorted(of, np.arange(len(pieces) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (bucket, count)]
                yield pa.RecordBatch.from_arrays([pa.array([doc[i]] * len(pieces)), pa.array([lang[i]] * len(pieces)), *lists], ["doc", "lang", "bucket", "count"])

    with bounded_batches(docs.sparkSession):
        told = drawn.mapInArrow(counted, "doc long, lang string, bucket array<int>, count array<int>").toArrow()
    # numbers stay packed: as Python values they take the driver ten times the room
    rows = []
    for batch in told.to_batches():
        ends = np.cumsum(batch.column("bucket").value_lengths().to_numpy())
        lists = [np.split(batch.column(c).flatten().to_numpy(), ends)[:-1] for c in ("bucket", "count")]
        rows += zip(batch.column("doc").to_pylist(), batch.column("lang").to_pylist(), *lists, strict=True)
    rows.sort(key=lambda r: (r[0], r[1], len(r[2]), r[2].astype(">i4").tobytes()))
    languages = sorted({r[1] for r in rows})
    ends = np.append(0, np.cumsum([len(r[2]) for r in rows])).astype(np.int64)
    joined = [np.concatenate([np.zeros(0, np.int32), *[r[c] for r in rows]]) for c in (2, 3)]
    return Sample(ends, *joined, np.array([languages.index(r[1]) for r in rows], np.int64), np.array([(r[0] >> 32) % 4 == 0 for r in rows], bool), languages)


def fit(docs: DataFrame) -> Model:
    """Train on the documents that may be learnt from (doc_id, text, lang)."""
    sample = sampled(docs)
    return train(sample) if sample.languages else Model([], np.zeros((0, 1 << BUCKETS_LOG2), np.float32), np.zeros(0))


def recognised(text: Column, model: Model, spark: SparkSession) -> Column:
    """Is the language of a text recognised, that is, its prediction not rejected? Only texts go to the workers, and flags come back."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.BooleanType())
    def kept(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.concatenate([np.zeros(0, bool), *(~sent.value.predict(part)[2] for _, part in text_chunks(texts))]))
        give_back()

    return kept(text)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and rejected; columns of those names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.drop("lang_pred", "score", "rejected")

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rejected = [], [], []
            for _, part in text_chunks(batch.column("text")):
                a, b, c = sent.value.predict(part)
                langs, scores, rejected = langs + a, scores + b.tolist(), rejected + c.tolist()
            added = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "lang_pred", "score", "rejected"])

    schema = T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return plain.mapInArrow(predicted, schema)
