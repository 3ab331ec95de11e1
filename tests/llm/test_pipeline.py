"""The whole pipeline against a plain version of every stage on a small made-up corpus."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from graindex.llm import langid

WORD = re.compile(r"\w+")


def made_up(rng, n, letters):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def joined(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def alike(a, b):
    return bool(a) and bool(b) and sum((a & b).values()) >= 0.8 * sum((a | b).values())


def corpus(rng):
    kinds = {"xx": "aeioustrnl", "yy": "uökzpdgvwä"}
    rows, item = [], made_up(rng, 40, kinds["xx"])
    base = [made_up(rng, 25, kinds["xx"]) for _ in range(3)]
    for i in range(70):
        lang = "xx" if i % 2 else "yy"
        lines = [made_up(rng, rng.randint(8, 30), kinds[lang]) for _ in range(rng.randint(1, 4))]
        if i % 7 == 1:
            lines.insert(0, base[i % 3])
        if i % 7 == 2:
            lines.append(base[i % 3].upper() + " " + made_up(rng, 1, "q"))
        if i in (15, 33):
            lines.append("So: " + item + " " + made_up(rng, 12, kinds["xx"]))
        rows.append((i, "\n".join(lines), lang, "s"))
    one = made_up(rng, 60, kinds["xx"]).split()
    for j in range(4):  # near copies whose lines differ enough to stay, words alike enough to go
        words = list(one)
        rows.append((100 + j, "\n".join(" ".join(words[k : k + 3 + j]) for k in range(0, 60, 3 + j)), "xx", "s"))
    rows += [(200, rows[5][1], "xx", "s"), (201, None, "xx", "s"), (202, "123 456", "yy", "s"), (203, base[0], "xx", "s"), (None, made_up(rng, 50, kinds["yy"]), None, "s")]
    return [(*r, len(r[1]) if r[1] else None) for r in rows], item


def without_repeated_lines(docs):
    lines = [(d, i, " ".join(x.lower().split())) for d, t in sorted(docs.items(), key=lambda x: (x[0] is None, x[0] or 0)) for i, x in enumerate(t.split("\n")) if x.strip()]
    grams = [{x[i : i + 6] for i in range(max(1, len(x) - 5))} for _, _, x in lines]
    group = joined(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])])
    gone = {lines[i][:2] for i, g in enumerate(group) if g != i}
    out = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in docs.items()}
    return {d: t for d, t in out.items() if t.strip()}


def shingles(text):
    w = WORD.findall(text.lower())
    return Counter(" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline

    rows, item = corpus(random.Random(17))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, "nothing of the kind stands here at all")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    model = langid.fit(docs.select("doc_id", "text", "lang"))
    left = {d: t for d, t, *_ in rows if t and not model.predict([t])[2][0]}
    assert 201 not in left and 202 not in left and len(left) > 60
    left = without_repeated_lines(left)
    assert 200 not in left and 203 not in left
    ids = sorted(left, key=lambda d: (d is None, d or 0))
    sets = [shingles(left[d]) for d in ids]
    group = joined(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if alike(sets[i], sets[j])])
    left = {ids[i]: left[ids[i]] for i, g in enumerate(group) if g == i}
    n = sum(shingles(item).values())

    def leaks(text):
        w = WORD.findall(text.lower())
        g = [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]
        return any(alike(Counter(g[p : p + n]), shingles(item)) for p in range(max(1, len(g) - n + 1)))

    gone = {d for d, t in left.items() if leaks(t)}
    assert gone == {15, 33}
    ranks = {}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        import base64

        ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
    encoding = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert set(got) == set(left) - gone and len(got) > 40
    for d, r in got.items():
        codes = encoding.encode_ordinary(left[d])
        assert r.n_tokens == len(codes) and r.ids_sha256 == hashlib.sha256(b"".join(c.to_bytes(4, "little") for c in codes)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(left[d].encode()).hexdigest()


@pytest.mark.parametrize("stage", ["line_dedup", "near_dedup", "decontamination"])
def test_stages_keep_nulls_and_empty_texts(spark, stage):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (3, "a line of words that stand alone", None, None, 9)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, "/root/testdata/sf0.001")
    assert out.columns == docs.columns and {(r.doc_id, r.text) for r in out.collect()} == {(1, None), (None, ""), (3, "a line of words that stand alone")}
    assert dict(corpus_pipeline.STAGES)[stage](spark, docs.where(F.lit(False)), "/root/testdata/sf0.001").count() == 0
