"""Edge cases of the training-data operators: ids, repeated rows, clashing names, large groups, and licenses by brute force."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graindex.llm import ann, chat, components, decontaminate, langid, license_texts, licenses, linededup, neardup, spandedup

WORD = re.compile(r"\w+")
CLASHES = ["_id", "_gone", "_text_key", "_key", "_left", "key", "of", "lost", "left", "gone", "node", "component", "text_key", "place", "kept"]


def made_up(rng, n):
    return " ".join("".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 7))) for _ in range(n))


def with_clashes(df):
    for name in CLASHES:
        df = df.withColumn(name, F.concat(F.lit("mine "), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")))
    return df


def kept_values(rows):
    return all(r[c] == f"mine {-1 if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHES)


def test_names_of_all_kinds_survive(spark):
    rng = random.Random(1)
    base = [made_up(rng, 12).capitalize() + "." for _ in range(6)]
    rows = [(1, "\n".join(base)), (2, "\n".join(base[2:]) + "\n" + made_up(rng, 30)), (3, made_up(rng, 40)), (None, base[0] + " " + base[1] + " " + made_up(rng, 9))]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    bench = spark.createDataFrame([(1, base[4])], "item_id bigint, text string")
    for out in (neardup.keep_one(docs), linededup.dedup_lines(docs), spandedup.dedup_spans(docs), decontaminate.remove_leaks(docs, bench)):
        got = out.collect()
        assert out.columns == docs.columns and got and kept_values(got)


def test_lines_of_repeated_rows(spark):
    a, b = "first line of some length\nsecond line of some length", "second line of some length\nanother one that is new"
    rows = [(1, a), (1, a), (1, a), (2, b), (None, a), (None, "only here it stands alone"), (None, "only here it stands alone"), (5, None), (5, None), (6, ""), (7, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("extra", F.lit(1))
    gone = Counter((r.doc_id, r.line_no, r.kept_doc_id, r.kept_line_no) for r in linededup.repeated_lines(docs).collect())
    assert gone == Counter({(1, 0, 1, 0): 2, (1, 1, 1, 1): 2, (2, 0, 1, 1): 1, (None, 0, 1, 0): 1, (None, 1, 1, 1): 1, (None, 0, None, 0): 1})
    left = Counter((r.doc_id, r.text) for r in linededup.dedup_lines(docs).collect())
    assert left == Counter({(1, a): 1, (2, "another one that is new"): 1, (None, "only here it stands alone"): 1, (5, None): 2, (6, ""): 1, (7, " \n "): 1})


def test_spans_of_documents_that_share_or_lack_an_id(spark):
    rng = random.Random(2)
    passage = " ".join(made_up(rng, 9).capitalize() + "." for _ in range(4))
    own = [made_up(rng, 8).capitalize() + "." for _ in range(6)]
    rows = [(7, own[0] + " " + passage), (7, own[1] + " " + passage), (None, passage + " " + own[2]), (None, passage + " " + own[3]), (9, own[4]), (9, own[4])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = Counter((r.doc_id, r.text.strip()) for r in spandedup.dedup_spans(docs).collect())
    assert sum(passage in t for _, t in texts) == 1 and texts[(9, own[4])] == 2
    assert {t for d, t in texts if d is None} == {own[2], own[3]} and {passage in t for d, t in texts if d == 7} == {True, False}
    changed = spandedup.changed_documents(docs).collect()
    assert len(changed) == 3 and all(r.first_doc_ids == [7] for r in changed)


def plain_spans(text):
    """Sentences of a text and all runs of two or more with 20 words or more, written plainly (sentences of up to 25 words)."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n", text) if WORD.search(s)]
    runs = {}
    for i in range(len(sentences)):
        for j in range(i + 1, len(sentences)):
            words = tuple(WORD.findall(" ".join(sentences[i : j + 1]).lower()))
            if len(words) >= 20:
                runs[i, j] = words
    return sentences, runs


def test_span_dedup_against_plain_spans(spark):
    rng = random.Random(5)
    pool = [made_up(rng, rng.randint(3, 20)).capitalize() + rng.choice(".!?") for _ in range(40)]
    texts = []
    for _ in range(30):
        at = rng.randrange(34)
        texts.append(" ".join(pool[at : at + rng.randint(2, 6)] + [made_up(rng, rng.randint(2, 15)).capitalize() + "." for _ in range(3)]))
    first, want = {}, {}
    for d, t in enumerate(texts):
        sentences, runs = plain_spans(t)
        gone = set()
        for (i, j), words in runs.items():
            if words in first:
                gone |= set(range(i, j + 1))
            else:
                first[words] = d
        if gone:
            want[d] = " ".join(s for i, s in enumerate(sentences) if i not in gone)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: " ".join(r.text.split()) for r in spandedup.changed_documents(docs).collect()}
    assert got == want and len(want) > 10


def near_copies(rng, n, words, edits):
    base = made_up(rng, words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = made_up(rng, 1)
        out.append(" ".join(w))
    return out


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


@pytest.mark.parametrize("block", [4, 1000])
def test_groups_of_any_size_lose_no_link(spark, monkeypatch, block):
    """Large keys take further stars and rare features with small blocks, and one block without; both join what all pairs would."""
    monkeypatch.setattr(components, "BLOCK", block)
    monkeypatch.setattr(components, "BLOCK_CHARS", 2_000)
    monkeypatch.setattr(components, "FEW", 3)
    monkeypatch.setattr(components, "REFINE", 1)
    rng = random.Random(7)
    texts = near_copies(rng, 40, 110, 4) + near_copies(rng, 10, 60, 1)
    shared = made_up(rng, 60)
    texts += [shared + " " + made_up(rng, 30) for _ in range(25)]
    sets = [Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for t in texts)]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sum((sets[i] & sets[j]).values()) >= 0.8 * sum((sets[i] | sets[j]).values())]
    want = joined(len(texts), links)
    # one key for all, so that every pair is a candidate
    items = spark.createDataFrame([(i, [1, 2 + i % 2]) for i in range(len(texts))], "node long, keys array<long>")
    held = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    got = {r.node: r.component for r in components.similar_components(items, lambda n: held.join(n, "node"), neardup.features, 0.8).collect()}
    assert [got[i] for i in range(len(texts))] == want and 26 < len(set(want)) < 72


def test_a_group_larger_than_the_buffer(spark, monkeypatch):
    monkeypatch.setattr(components, "BLOCK_CHARS", 500)
    rng = random.Random(8)
    texts = near_copies(rng, 30, 110, 3) + [made_up(rng, 3000)]
    rows = [(1, 0, 0, i, i, t) for i, t in enumerate(texts)] + [(2, 0, 0, i, i, t) for i, t in enumerate(texts[:3])]
    import pandas as pd

    frame = pd.DataFrame(rows, columns=["key", "i", "j", "node", "component", "text"])
    assert components.links_of(frame.iloc[:0], neardup.features, 0.8).num_rows == 0
    mixed = spark.createDataFrame([(k, n, c, 31, 0, 1) for k, _, _, n, c, _ in rows], "key long, node long, component long, n long, main long, n_main long")
    held = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    got = {(r.a, r.b) for r in components.alike_across(mixed, held, neardup.features, 0.8).collect()}
    f = [Counter(zip(*[t.split()[i:] for i in range(5)], strict=False)) for t in texts]
    want = {(i, j) for i in range(31) for j in range(i + 1, 31) if sum((f[i] & f[j]).values()) >= 0.8 * sum((f[i] | f[j]).values())}
    assert {tuple(sorted(x)) for x in got} == want and want


def test_local_roots():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-50, 50, 60), rng.integers(-50, 50, 60)
    node, root = components.local_roots(a, b)
    nodes = sorted(set(a.tolist()) | set(b.tolist()))
    place = {x: i for i, x in enumerate(nodes)}
    want = joined(len(nodes), [(place[x], place[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {x: nodes[want[i]] for i, x in enumerate(nodes) if want[i] != i}


def test_licenses_against_brute_force(spark):
    rng = random.Random(12)
    templates = [(n, t) for n, t in license_texts.TEMPLATES if n in ("MIT", "MIT-short", "MIT-grant", "ISC", "Apache-2.0-short", "CC-BY-4.0", "CC-BY-NC-4.0", "Zlib", "MPL-2.0-notice")] + [("two", "Two words"), ("none", "..."), ("null", None)]
    texts = ["", None, made_up(rng, 300), "Two, words"]
    for _, t in templates[:9]:
        words = t.split()
        texts.append(made_up(rng, 30) + " " + t.lower() + " " + made_up(rng, 30))
        for share in (0.02, 0.05, 0.1):
            w = list(words)
            for _ in range(max(1, int(share * len(w)))):
                w[rng.randrange(len(w))] = "changed"
            texts.append(made_up(rng, rng.randint(0, 40)) + " " + " ".join(w))
        texts.append(" ".join(words[: int(0.85 * len(words))]))
        texts.append(" ".join(words[:5] + made_up(rng, len(words) // 3).split() + words[5:]))
    want = {}
    for i, (name, t) in enumerate(templates):
        v = WORD.findall((t or "").lower())
        k = min(5, len(v))
        b = [tuple(v[p : p + k]) for p in range(len(v) - k + 1)] if v else []
        for d, x in enumerate(texts):
            w = WORD.findall((x or "").lower())
            g = [tuple(w[p : p + k]) for p in range(len(w) - k + 1)] if k else []
            best = max((len(set(b) & set(g[p : p + n])) / len(set(b)) for n in {min(len(g), int(len(b) * y)) for y in licenses.LENGTHS} for p in range(len(g) - n + 1)), default=0) if b and g else 0
            if best >= 0.8:
                want[d, name] = best
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), spark.createDataFrame(templates, "template_id string, text string")).collect()
    assert {(r.doc_id, r.template_id): r.containment for r in got} == pytest.approx(want) and len(got) == len(want) and len(want) > 30


def test_license_blocks_are_scanned_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 600)
    docs = spark.createDataFrame([(1, "x " + dict(license_texts.TEMPLATES)["ISC"]), (2, "Released under the MIT License.")], "doc_id bigint, text string")
    twice = licenses.default_templates(spark).union(licenses.default_templates(spark))
    assert Counter((r.doc_id, r.template_id) for r in licenses.scan_licenses(docs, twice).collect()) == Counter({(1, "ISC"): 1, (2, "MIT-short"): 1})


def test_language_of_rows_without_ids_and_of_one_language(spark):
    rng = random.Random(4)
    words = {"xx": ["aba", "bab", "abba"], "yy": ["koko", "tiki", "okto"], "zz": ["uzu", "zuz", "uuz"]}
    rows = [(i if i % 3 else None, " ".join(rng.choice(words[k]) for _ in range(rng.randint(3, 60))), k) for i in range(240) for k in [("xx", "yy", "zz")[i % 3]]]
    docs = spark.createDataFrame([*rows, (None, None, "xx"), (1, "123", None), (None, "koko " * 30_000, None)], "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    got = langid.identify(docs, model).collect()
    assert model.languages == ["xx", "yy", "zz"] and np.mean([r.lang_pred == r.lang for r in got if r.lang and r.text]) > 0.98
    assert all((r.lang_pred, r.score, r.rejected) == ("und", 0.0, True) for r in got if r.text in (None, "123"))
    assert next(r for r in got if r.text and len(r.text) > 100_000).lang_pred == "yy"
    held = [r for r in docs.where(langid.held_out(F.col("doc_id"))).collect()]
    assert held and not any(r.doc_id is None for r in held)


def test_neighbours_of_repeated_ids_and_doubles(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(400)] + [(20, [9.0] * 6)] * 50 + [(7, [9.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    least = {}
    for i, v in rows:
        least[i] = min(least.get(i, v), v)
    hits = []
    for q, found in got.items():
        want = sorted(((-float(np.dot(least[q], v)), i) for i, v in least.items() if i != q))[:20]
        assert len({i for i, _ in found}) == 20 and all(s == pytest.approx(float(np.dot(least[q], least[i])), abs=1e-12) for i, s in found)
        hits.append(len({i for i, _ in found} & {i for _, i in want}) / 20)
    assert set(got) == set(range(0, 400, 20)) and np.mean(hits) > 0.9


def test_lists_are_packed_into_bins(monkeypatch):
    monkeypatch.setattr(ann, "BIN", 10)
    first, parts = ann.bins_of(np.array([4, 5, 3, 0, 25, 9, 1, 1]))
    assert first.tolist() == [0, 0, 1, 1, 2, 5, 5, 6] and parts.tolist() == [1, 1, 1, 1, 3, 1, 1, 1]


def test_driver_holds_blocks_of_distances(spark):
    """The sample comes as Arrow columns, and the driver never holds all of its distances to the centroids."""
    parts = [F.sin(F.xxhash64("id", F.lit(i)).cast("double")).cast("float") for i in range(8)]
    rows = spark.range(100_000).select(F.col("id").alias("vec_id"), F.array(*parts).alias("embedding"))
    ann.fit(rows.limit(500), 20)  # imports
    tracemalloc.start()
    lists = ann.fit(rows, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(lists.centroids) == 1000 and peak < 8 * 16_000 * 1000 / 2  # half of all distances, 64 MB


def test_blocks_of_distances_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(1500)], "vec_id bigint, embedding array<double>").cache()
    want = ann.fit(rows, 20)
    monkeypatch.setattr(ann, "CELLS", 600)
    got = ann.fit(rows, 20)
    assert got.links == want.links and got.ratio == pytest.approx(want.ratio, abs=1e-9) and np.allclose(got.centroids, want.centroids)
    assert np.array_equal(got.sample, want.sample) and np.array_equal(got.sample_ids, want.sample_ids) and np.array_equal(got.sample_lists, want.sample_lists)
    # the nearest of the sample, against all scores at once
    x, probe = want.sample, np.arange(0, len(want.sample), 3)
    score = x[probe] @ x.T
    score[np.arange(len(probe)), probe] = -np.inf
    assert np.array_equal(ann.top_of_sample(x, probe, 7), np.argsort(-score, 1, kind="stable")[:, :7])


def test_the_loss_mask_covers_learned_texts(spark):
    rows = [(1, t, ("user", "assistant", "system")[t % 3], f"text {t} </turn> é" * (t % 4)) for t in range(150)] + [(2, 0, "user", "only")]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), chat.text_parts(F.col("text")))
    got = {r.conv_id: r for r in out.collect()}
    assert got[1].learned == [t % 3 == 1 for t in range(150)] and got[2].learned == [False] and got[2].loss_spans == []
    texts = [got[1].formatted[s.begin : s.end].replace("\\</turn>", "</turn>") for s in got[1].loss_spans]
    assert texts == [x for _, _, r, x in rows[:150] if r == "assistant"]


def test_very_long_texts(spark):
    rng = random.Random(6)
    long = "\n".join(made_up(rng, 400) for _ in range(300))
    docs = spark.createDataFrame([(1, long), (2, long + "\n" + made_up(rng, 50)), (3, made_up(rng, 20))], "doc_id bigint, text string")
    assert {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert linededup.repeated_lines(docs).count() == 300
    assert {r.doc_id for r in spandedup.changed_documents(docs).collect()} == {2}
    assert licenses.scan_licenses(docs, licenses.default_templates(spark)).count() == 0
