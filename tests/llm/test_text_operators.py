"""BPE, token counts, chat formatting, decontamination, license scans and language ID against plain references."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from graindex.llm import bpe, chat, decontaminate, langid, licenses, queries, textkernel, token_counts

PATH, PATTERN = public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"\w+")


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def encoding():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(5)
    letters = "ab cd'se \n\t\x1c\x85\u00a0\u3000éñ²Ⅷ٣漢😀#!_09\u0301\r"
    return ["", None, "a" * 3000, " " * 500, "don't stop 1234 ok\n\n  x", "thhahe the ofthstthor"] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(300)]


def test_bpe_equals_tiktoken_and_round_trips(spark, encoding):
    texts = odd_texts()
    got = {r.doc_id: r for r in bpe.round_trip_digests(docs_of(spark, texts), PATH, PATTERN).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = encoding.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_long_text_by_blocks(encoding, monkeypatch):
    v = bpe.Vocabulary(bpe.read_ranks(PATH), PATTERN)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    text = "Some words, thhahe and others' 123 times. " * 40
    assert np.frombuffer(v.encode_all([text])[0], "<u4").tolist() == encoding.encode_ordinary(text)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 500)
    assert np.frombuffer(v.encode_all([text])[0], "<u4").tolist() == encoding.encode_ordinary(text)


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64))
    assert sorted(bpe.PerfectHash(keys).find(keys)) == list(range(len(keys)))


def test_bpe_merges_short_words_together(encoding, monkeypatch):
    """Only pre-tokens longer than SHORT take the heap, which costs Python steps a byte."""
    rng, heaped = np.random.default_rng(3), []
    v = bpe.Vocabulary(bpe.read_ranks(PATH), PATTERN)
    merge = v.merge
    monkeypatch.setattr(v, "merge", lambda piece: heaped.append(piece) or merge(piece))
    monkeypatch.setattr(bpe, "GROUP", 70, raising=False)
    sizes = [*range(1, 66), *rng.integers(1, 70, 900).tolist(), 300]
    words = ["".join(map(chr, rng.choice([97, 98, 101, 116, 0xE9, 0x4E2D, 0x1D11E], n))) for n in sizes]
    words += ["a" * n for n in sizes] + ["ab" * n for n in range(1, 40)] + ["\U0001f600" * n for n in range(1, 20)] + ["=" * 80]
    text = " ".join(words)
    assert np.frombuffer(v.encode_all([text])[0], "<u4").tolist() == encoding.encode_ordinary(text)
    assert heaped and min(map(len, heaped)) > 64


def test_bpe_replaces_a_clashing_column_and_takes_an_empty_table(spark):
    docs = docs_of(spark, ["a b"]).withColumn("token_ids", F.lit("x")).withColumn("decoded", F.lit(1))
    out = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN)
    assert out.columns == docs.columns and bytes(out.first()["decoded"]) == b"a b"
    assert bpe.round_trip_digests(docs_of(spark, []), PATH, PATTERN).count() == 0


def test_token_counts(spark, encoding):
    texts = odd_texts()
    n = np.array([len(encoding.encode_ordinary(t or "")) for t in texts])
    sums = token_counts.suffix_sums(token_counts.length_histogram(docs_of(spark, texts), PATH, PATTERN))
    rows = sums.collect()
    assert {r.n_tokens: r.n_docs for r in rows} == dict(Counter(n.tolist()))
    for r in rows:
        assert r.docs_over == (n > r.n_tokens).sum() and r.tokens_over == n[n > r.n_tokens].sum()
        assert r.truncated_total == np.minimum(n, r.n_tokens).sum() and r.tokens_total == n.sum()
        assert r.rank_share == pytest.approx((n <= r.n_tokens).mean())
    at = {r["limit"]: r for r in token_counts.at_limits(sums, [0, 7, 10_000]).collect()}
    assert all(at[x].truncated_total == np.minimum(n, x).sum() and at[x].docs_over == (n > x).sum() for x in at)
    assert token_counts.quantiles(sums, [0.5]).first().n_tokens == sorted(n)[int(np.ceil(0.5 * len(n))) - 1]
    assert token_counts.suffix_sums(token_counts.length_histogram(docs_of(spark, []), PATH, PATTERN)).count() == 0


TURNS = "conv_id bigint, turn bigint, role string, text string, other int"


def test_chat_round_trip_and_digests(spark):
    nasty = [r"\### Assistant: </turn> ok", r"\\</turn>", "</turn>\n<turn>user\nhi", "\n</turn>\n", "<image:1>\\", "", None, "a\nb\\", r"\<turn>\\<turn>"]
    rows = [(1, i, ("user", "assistant")[i % 2], t, 0) for i, t in enumerate(nasty)] + [(2, 5, "assis\ntant\\n", "x", 0), (2, 3, None, "y", 0), (2, 3, None, "y", 0), (None, 0, "user", "z", 0), (3, None, "user", "late?", 0)]
    rows += [(4, t, "assistant", f"t{t}", 0) for t in range(200)]
    out = chat.format_conversations(spark.createDataFrame(rows, TURNS), chat.text_parts(F.col("text")))
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out.select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert back[1] == [(("user", "assistant")[i % 2], t or "") for i, t in enumerate(nasty)]
    assert back[2] == [("", "y"), ("", "y"), ("assis\ntant\\n", "x")] and back[None] == [("user", "z")] and back[3] == [("user", "late?")]
    assert [x for _, x in back[4]] == [f"t{t}" for t in range(200)]
    got = {r.conv_id: r for r in chat.digests(out).collect()}
    told = "".join(f"{r}\n{t}\n" for r, t in back[1])
    loss = "".join(t for r, t in back[1] if r == "assistant")
    assert got[1].turns_sha256 == hashlib.sha256(told.encode()).hexdigest() and got[1].n_turns == len(nasty)
    assert got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[1].loss_chars == len(loss)
    assert chat.format_conversations(spark.createDataFrame([], TURNS), chat.text_parts(F.col("text"))).count() == 0


def test_chat_parts_become_placeholders_and_references(spark):
    rows = [(1, 0, "user", [("text", "see <image:2>", None, None), ("image", None, "s3://a", 3), ("audio", None, "b", None), ("odd", "t", None, 1), ("document", "ignored", "c", 2)]), (1, 1, "user", None), (1, 2, "user", [])]
    turns = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    r = chat.format_conversations(turns, F.col("parts")).first()
    assert r.formatted.startswith("<turn>user\nsee \\<image:2>\n<image:2>\n<audio:3>\nt\n<document:5>\n</turn>\n")
    assert [tuple(a) for a in r.attachments] == [(0, 2, "image", "s3://a", 768), (0, 3, "audio", "b", 25), (0, 5, "document", "c", 1024)]


def test_chat_query_equals_its_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{d}/conversations.parquet'")
    want = sorted(con.execute(queries.OP3_SQL).fetchall())
    assert sorted(tuple(r) for r in queries.op3_chat_format(spark, d).collect()) == want


def grams(text, k=5):
    w = WORD.findall((text or "").lower())
    return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]


def made_up(rng, n):
    return " ".join("".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_decontamination_against_brute_force(spark):
    rng = random.Random(3)
    items = [made_up(rng, n) for n in (12, 15, 15, 30, 60)] + ["two words", "", None, "..."]
    texts = [made_up(rng, 200) for _ in range(6)] + ["", None, "zz"]
    for i, item in enumerate(items[:5]):
        words = item.split()
        texts.append(made_up(rng, 50) + " " + item.upper().replace(" ", ",  ") + "\n" + made_up(rng, 9))
        words[len(words) // 2] = "changed"
        texts.append(made_up(rng, 50) + " " + " ".join(words) + " " + made_up(rng, 50))
    texts.append("Here: Two, words!")
    texts.append(items[3] + " x " + items[3] + " y " + items[0])
    want = set()
    for i, item in enumerate(items):
        k = min(5, len(WORD.findall(item or "")))
        b = Counter(grams(item, k)) if k else Counter()
        n = sum(b.values())
        for d, t in enumerate(texts):
            g = grams(t, k) if k else []
            best = max((sum((b & Counter(g[p : p + n])).values()) for p in range(max(0, len(g) - n + 1))), default=0) if n else 0
            if n and best / (2 * n - best) >= 0.8:
                want.add((d, i))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    docs = docs_of(spark, texts).withColumn("item_id", F.lit(1)).withColumn("similarity", F.lit("x"))
    got = decontaminate.find_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) and len(want) > 8
    assert all(WORD.findall(texts[r.doc_id][r.char_start : r.char_end].lower())[:2] == WORD.findall(items[r.item_id].lower())[:2] for r in got if r.similarity == 1)
    kept = decontaminate.remove_leaks(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0 and decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_decontamination_finds_documents_shorter_than_an_item(spark):
    rng = random.Random(15)
    item, other = made_up(rng, 40).split(), made_up(rng, 12).split()
    texts = [" ".join(item[:-2]), " ".join(item[3:]), " ".join(item[:-7]), " ".join(item[:-8]), " ".join(other[1:]), " ".join(other[:-2]), "a b"]
    bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(other))], "item_id bigint, text string")
    docs = docs_of(spark, texts)
    got = {(r.doc_id, r.item_id): (r.similarity, r.char_start, r.char_end) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {(d, i): (pytest.approx(s), 0, len(texts[d])) for d, i, s in ((0, 0, 34 / 36), (1, 0, 33 / 36), (2, 0, 29 / 36), (4, 1, 7 / 8))}
    assert sorted(r.doc_id for r in decontaminate.remove_leaks(docs, bench).collect()) == [3, 5, 6]


def test_decontamination_in_several_blocks(spark, monkeypatch):
    rng = random.Random(8)
    items = [made_up(rng, 20) for _ in range(12)]
    docs = docs_of(spark, [made_up(rng, 30) + " " + x for x in items])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 500)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()) == [(i, i) for i in range(12)]
    assert decontaminate.remove_leaks(docs, bench).count() == 0


def test_no_fingerprint_within_the_radius_is_missed():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 256, (200, decontaminate.BLOCKS)).astype(np.uint8)
    for row in a:
        bits = np.zeros(128, np.uint8)
        bits[rng.choice(128, decontaminate.RADIUS, replace=False)] = 1
        other = row ^ np.packbits(bits)
        assert (np.bitwise_count(row ^ other) <= 1).any()


def test_licenses(spark):
    mit = dict(licenses.TEMPLATES)["MIT-grant"]
    words = mit.split()
    words[30] = "changed"
    texts = ["x y. Licensed under the Apache License, Version 2.0. z", "released under the mit license", "This work is licensed under the GNU General Public License, version 3.", mit, " ".join(words), "Licensed under the", "", None, "Licensed under CC BY-NC 4.0."]
    got = licenses.scan_licenses(docs_of(spark, texts).withColumn("template_id", F.lit(0)), licenses.default_templates(spark)).collect()
    assert {(r.doc_id, r.template_id) for r in got} == {(0, "Apache-2.0-short"), (1, "MIT-short"), (2, "GPL-3.0-short"), (3, "MIT-grant"), (4, "MIT-grant"), (8, "CC-BY-NC-4.0-short")}
    assert next(r for r in got if r.doc_id == 4).containment < 1
    r = next(r for r in got if r.doc_id == 0)
    assert texts[0][r.char_start : r.char_end] == "Licensed under the Apache License, Version 2.0"
    assert licenses.scan_licenses(docs_of(spark, texts), licenses.default_templates(spark).limit(0)).count() == 0


def test_licenses_cut_short_or_with_words_inserted(spark):
    mit = dict(licenses.TEMPLATES)["MIT-grant"].split()
    n = len(grams(" ".join(mit)))
    added = " ".join(mit[:20] + made_up(random.Random(2), 18).split() + mit[20:])
    texts = [" ".join(mit[:-2]), added, "before it " * 9 + added + " and after" * 40, " ".join(mit[: int(0.8 * n)])]
    got = {(r.doc_id, r.template_id): r for r in licenses.scan_licenses(docs_of(spark, texts), licenses.default_templates(spark)).collect()}
    assert set(got) == {(d, "MIT-grant") for d in range(3)}
    assert got[0, "MIT-grant"].containment == pytest.approx((n - 2) / n) and got[0, "MIT-grant"].char_end == len(texts[0])
    assert all(got[d, "MIT-grant"].containment == pytest.approx((n - 4) / n) for d in (1, 2))


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.op10_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and 150 < len(held) < 350
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_language_id_edges(spark):
    docs = docs_of(spark, ["the cat and the dog", None, "", "123 !?", "x"] * 3).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr")).withColumn("score", F.lit("clash"))
    out = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and out[0].lang_pred in ("en", "fr") and all(out[i].rejected for i in (1, 2, 3))
    none = langid.identify(docs, langid.fit(docs.withColumn("lang", F.lit(None).cast("string"))))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert langid.identify(docs.limit(0), langid.fit(docs.limit(0))).count() == 0


def test_words_are_unicode_and_hashes_agree_anywhere():
    w = textkernel.Words(["Hello, wörld HELLO", "", "Ünï ÜNÏ x_1"])
    assert w.counts().tolist() == [3, 0, 3] and w.hash[0] == w.hash[2] and w.hash[3] == w.hash[4]
    a, b = textkernel.Words(["q " * 100 + "one two three"]), textkernel.Words(["one two three"])
    assert a.hash[-3:].tolist() == b.hash.tolist()
