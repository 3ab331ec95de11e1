"""Language predictions recomputed in plain Python, text by text and n-gram by n-gram."""

import math
import tracemalloc

import numpy as np
import pytest
import regex

from graindex.llm import langid, textkernel

DOCS = "doc_id bigint, text string, lang string"
MASK = (1 << 64) - 1


def mixed(x):
    """The finaliser of 64-bit values, in whole numbers."""
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & MASK
    x ^= x >> 29
    x = x * 0xC4CEB9FE1A85EC53 & MASK
    return x ^ x >> 32


def grams(text):
    """Every n-gram of letters of one to ORDERS characters of the lower-cased text, with one mark on each side of a word."""
    low = "".join(c.lower() if len(c.lower()) == 1 and regex.match(r"[\p{Lu}\p{Lt}]", c) else c for c in text or "")
    marked = "\n" + low + "\n"
    letter = [regex.match(r"\p{L}", c) is not None for c in marked]
    kept = [(c, is_in) for i, (c, is_in) in enumerate(zip(marked, letter)) if is_in or i and letter[i - 1] or i + 1 < len(letter) and letter[i + 1]]
    for n in range(1, langid.ORDERS + 1):
        for i in range(len(kept) - n + 1):
            part = kept[i : i + n]
            whole = all(is_in for _, is_in in part[1:-1]) and (part[0][1] or part[-1][1]) if n > 1 else part[0][1]
            if whole:
                yield n, part


def bucket(n, part):
    h = n
    for j, (c, is_in) in enumerate(part):
        symbol = mixed((ord(c) + 0x51ED2701) & MASK) if is_in else 0x0123456789ABCDEF
        h = (h + symbol * ((2 * j + 3) * 0x9E3779B97F4A7C15 & MASK)) & MASK
    return mixed(h) >> (64 - langid.BUCKETS_LOG2)


def plain(model, text):
    found = [bucket(n, part) for n, part in grams(text)]
    if not found:
        return langid.UNKNOWN, 0.0, True
    logits = [sum(float(model.table[k][b]) for b in found) / len(found) + float(model.bias[k]) for k in range(len(model.languages))]
    top = max(range(len(logits)), key=lambda k: logits[k])
    e = [math.exp((x - max(logits)) / model.temperature) for x in logits]
    score = e[top] / sum(e)
    return model.languages[top], score, score < model.threshold


def test_predictions_equal_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    assert model.languages == sorted({r.lang for r in docs.collect() if r.lang is not None})
    texts = [r.text for r in docs.orderBy("doc_id").limit(40).collect()]
    texts += ["", None, "123 !", "a", "Été à Köln: ΣΑΣ ǅ ß", "x" * 500, "ab-cd'ef  gh\n\nij", "don't", "é", "́a", "漢字 かな", texts[0]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in langid.identify(rows, model).collect():
        lang, score, rejected = plain(model, r.text)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-9), r.text
        if abs(score - model.threshold) > 1e-9:
            assert r.rejected == rejected


def test_texts_of_a_batch_are_read_in_chunks(monkeypatch):
    """However large an Arrow batch is, Python holds texts of one chunk at a time."""
    import pyarrow as pa

    monkeypatch.setattr(textkernel, "CHUNK_CHARS", 1000)
    texts = ["a" * 400, None, "b" * 700, "", "c" * 5000, "é" * 300, None]
    got = list(textkernel.text_chunks(pa.array(texts)))
    assert [t for _, part in got for t in part] == [t or "" for t in texts]
    assert all(sum(map(len, part[:-1])) <= 1000 for _, part in got) and len(got) >= 3
    assert [at for at, _ in got] == np.cumsum([0, *[len(p) for _, p in got[:-1]]]).tolist()
    assert [t for _, part in textkernel.text_chunks(pa.array([b"x", None]), None) for t in part] == [b"x", None]
    assert list(textkernel.text_chunks(pa.array([], pa.string()))) == []


def test_driver_holds_the_sample_packed(spark):
    """The numbers of the sample never stand in the driver as Python values, and calibration takes a part of them at a time."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    langid.sampled(docs.limit(5))  # imports and tables
    tracemalloc.start()
    sample = langid.sampled(docs)
    got, entries = tracemalloc.get_traced_memory()[1], len(sample.bucket)
    assert entries > 1_000_000 and got < 24 * entries
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    langid.train(sample)
    assert tracemalloc.get_traced_memory()[1] - before < 16 * langid.DIM << langid.BUCKETS_LOG2  # four tables of embeddings
    tracemalloc.stop()
