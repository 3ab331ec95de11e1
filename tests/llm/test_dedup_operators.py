"""Near-duplicate documents, lines, spans, neighbours and the pipeline against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graindex.llm import ann, components, linededup, neardup, spandedup

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"\w+")


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)


def made_up(rng, n):
    return " ".join("".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = made_up(rng, 1)
    return " ".join(words)


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


def shingle_counts(text):
    w = WORD.findall((text or "").lower())
    return Counter(" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def similar(a, b):
    return bool(a) and bool(b) and sum((a & b).values()) >= 0.8 * sum((a | b).values())


def corpus():
    rng = random.Random(11)
    texts = [made_up(rng, 80) for _ in range(10)]
    base = made_up(rng, 120)
    texts += [edited(rng, base, e) for e in (0, 0, 1, 1, 1, 2, 2, 3, 4, 5, 6, 8) for _ in range(4)]
    texts += ["", None, "", "!!", "one two", "One, two", "one three", texts[0].upper(), texts[0], "a b c " * 40, "a b c " * 38]
    return texts


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    texts = corpus()
    c = [shingle_counts(t) for t in texts]
    links = [(i, j) for i in range(len(c)) for j in range(i) if similar(c[i], c[j])]
    want = joined(len(texts), links)
    monkeypatch.setattr(components, "BLOCK", 7)
    docs = docs_of(spark, texts).withColumn("node", F.lit("clash")).withColumn("class_id", F.lit(0))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) < len(texts) - 20
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_near_duplicates_of_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other words in this one here"), (None, "a b c d e f g"), (None, "alone as it stands there now"), (5, "A b c d e f g!")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r.doc_id, r.class_id) for r in neardup.near_duplicate_classes(docs).collect())
    assert got == Counter({(1, 1): 3, (None, 1): 1, (None, None): 1, (5, 1): 1})
    assert neardup.keep_one(docs).count() == 3
    assert neardup.near_duplicate_classes(docs.limit(0)).count() == 0 and neardup.keep_one(docs.limit(0)).count() == 0


def test_near_duplicates_among_documents_without_ids(spark):
    base = made_up(random.Random(1), 60)
    docs = spark.createDataFrame([(None, base), (None, base + " more"), (None, "apart")], "doc_id bigint, text string")
    assert neardup.keep_one(docs).count() == 2


def test_dart_minhash_estimates_weighted_jaccard():
    h = np.array([1, 2, 3, 1, 2, 4], np.uint64)
    w = np.array([3.5, 100.0, 1.0, 7.0, 50.0, 0.25])
    s = neardup.dart_minhash(h, np.array([0, 0, 0, 1, 1, 1]), w, 3, 4000)
    assert (s[0] == s[1]).mean() == pytest.approx(53.5 / 108.25, abs=0.03) and not s[2].any() and s[:2].all()


def test_connected_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(-9, -3), (-3, 5)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    nodes = sorted({x for e in links if e[0] != e[1] for x in e})
    place = {x: i for i, x in enumerate(nodes)}
    want = joined(len(nodes), [(place[a], place[b]) for a, b in links if a != b])
    assert got == {x: nodes[want[place[x]]] for x in nodes}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def line_sets(text):
    return {i: " ".join(x.lower().split()) for i, x in enumerate((text or "").split("\n")) if x.strip()}


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(4)
    base, short = made_up(rng, 60), made_up(rng, 14)
    texts = ["\n".join(made_up(rng, 12) for _ in range(4)) for _ in range(5)]
    texts += [f"{edited(rng, base, e)}\n{made_up(rng, 10)}\n\n{edited(rng, short, e // 2)}" for e in (0, 1, 1, 2, 2, 3, 5)]
    texts += [texts[0], "", None, " \n\t", "ab\nAB \nab c", "  " + base.upper().replace(" ", "  "), "x\r\ny"]
    lines = [(d, i, x) for d, t in enumerate(texts) for i, x in line_sets(t).items()]
    g = [{x[i : i + 6] for i in range(max(1, len(x) - 5))} for _, _, x in lines]
    want_class = joined(len(lines), [(i, j) for i in range(len(g)) for j in range(i) if len(g[i] & g[j]) >= 0.8 * len(g[i] | g[j])])
    want = {lines[i][:2]: lines[c][:2] for i, c in enumerate(want_class) if c != i}
    docs = docs_of(spark, texts).withColumn("keys", F.lit("clash")).withColumn("line_no", F.lit(0))
    got = {(r.doc_id, r.line_no): (r.kept_doc_id, r.kept_line_no) for r in linededup.repeated_lines(docs).collect()}
    assert got == want and len(want) > 10
    out = linededup.dedup_lines(docs)
    left = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == docs.columns
    for d, t in enumerate(texts):
        keep = [x for i, x in enumerate((t or "").split("\n")) if (d, i) not in want]
        if line_sets(t) and not any(x.strip() for x in keep):
            assert d not in left
        else:
            assert left[d] == (t if t is None else "\n".join(keep))
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_long_and_short_line_signatures_overlap():
    rng = random.Random(6)
    for n in (55, 62, 64, 70, 79, 81, 90):
        keys, many = linededup.line_keys(linededup.Lines(["".join(rng.choice("abcdefgh") for _ in range(n + 5))]))
        assert len(keys) == many[0] == linededup.BANDS * (2 if 64 <= n < 80 else 1)


def test_repetitive_lines_of_any_length_are_compared(spark):
    texts = ["-" * 40, "-" * 100, "=-" * 30, "=-" * 200, "very good " * 5, "very good " * 30, "+---" * 12, "+---" * 90]
    keys, many = linededup.line_keys(linededup.Lines(texts))
    by_line = [set(x.tolist()) for x in np.split(keys, np.cumsum(many)[:-1])]
    assert all(by_line[i] & by_line[i + 1] for i in range(0, len(texts), 2))
    got = {(r.doc_id, r.kept_doc_id) for r in linededup.repeated_lines(docs_of(spark, texts)).collect()}
    assert got == {(i + 1, i) for i in range(0, len(texts), 2)}


def test_span_dedup_against_brute_force(spark):
    rng = random.Random(9)

    def prose(n):
        return " ".join(made_up(rng, rng.randint(3, 12)).capitalize() + rng.choice(".!?") for _ in range(n))

    passage, flat = prose(9), made_up(rng, 90)
    texts = [prose(6) + " " + passage + " " + prose(4), prose(3), passage.upper() + "\n" + prose(2), prose(5) + " " + flat + " " + prose(1), made_up(rng, 20) + " " + flat + " " + made_up(rng, 8), passage + " " + prose(1) + " " + passage, "", None, "Short. Text. Here.", "Short. Text. Here."]
    first, gone, origins = {}, defaultdict(list), defaultdict(set)
    for d, t in enumerate(texts):
        s = spandedup.Spans([t or ""])
        for a, b in zip(s.first, s.last, strict=True):
            key = tuple(WORD.findall(t[s.begin[a] : s.end[b]].lower()))
            if key in first:
                gone[d].append((s.begin[a], s.end[b]))
                origins[d].add(first[key])
            else:
                first[key] = d
    docs = docs_of(spark, texts).withColumn("hash", F.lit("clash")).withColumn("gone", F.lit(0))
    got = {r.doc_id: r for r in spandedup.changed_documents(docs).collect()}
    assert {2, 4, 5} <= set(got) == set(gone) and not {1, 8, 9} & set(got)
    for d, r in got.items():
        assert r.text == spandedup.without(texts[d], sorted(gone[d])) and r.first_doc_ids == sorted(origins[d]) and r.removed_chars == len(texts[d]) - len(r.text)
    assert passage.split(". ")[2].upper() not in got[2].text and sum(w in got[4].text.split() for w in flat.split()) < 40
    out = spandedup.dedup_spans(docs)
    assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()} == {d: got[d].text if d in got else t for d, t in enumerate(texts)}
    assert spandedup.changed_documents(docs.limit(0)).count() == 0


def test_long_repeated_passages_hold_a_span():
    rng = random.Random(12)
    for _ in range(60):
        passage, n = [], 0
        while n < 51:
            k = rng.randint(1, 25)
            passage.append(made_up(rng, k).capitalize() + ".")
            n += k
        s = spandedup.Spans([" ".join(passage)])
        assert len(s.first) and s.high[-1] == n


def test_span_dedup_removes_all_that_repeated_runs_cover(spark):
    rng = random.Random(21)
    made = lambda n: [made_up(rng, rng.randint(3, 17)).capitalize() + "." for _ in range(n)]
    docs = [made(rng.randint(5, 14)) for _ in range(30)]
    docs += [list(d) for d in docs[:20]] + [made(2) + d[1:-1] + made(2) for d in docs[10:25]] + [docs[3] + made(1) + docs[3]]
    docs += [[made_up(rng, n).capitalize() + "." for n in (12, 12, 5)]] * 2
    seen, want = set(), {}
    for d, s in enumerate(docs):
        gone = set()
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                run = tuple(WORD.findall(" ".join(s[i : j + 1]).lower()))
                if len(run) >= 20:
                    if run in seen:
                        gone |= set(range(i, j + 1))
                    seen.add(run)
        if gone:
            want[d] = " ".join(x for i, x in enumerate(s) if i not in gone)
    got = {r.doc_id: r.text.strip() for r in spandedup.changed_documents(docs_of(spark, [" ".join(s) for s in docs])).collect()}
    assert got == want and len(want) >= 36 and got[len(docs) - 1] == ""


def test_passages_inside_long_sentences_share_a_span():
    rng = random.Random(22)
    for _ in range(400):
        passage = made_up(rng, 49)
        s = spandedup.Spans([f"{made_up(rng, rng.randint(1, 30))} {passage} {made_up(rng, rng.randint(1, 30))}" for _ in range(2)])
        at = s.text[s.first]
        assert set(s.hash[at == 0]) & set(s.hash[at == 1])


VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8:
            ok[i] = np.array(v, np.float32).astype(np.float64)
    return {q: sorted(((-float((ok[q] * x).sum()), i) for i, x in ok.items() if i != q))[:k] for q in ok if q % 20 == 0}


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 8))
    rows = [(i, (centre[i % 12] + 0.6 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(3000 + i, [1.0] * 8) for i in range(60)]  # a tie of many equal vectors
    rows += [(4000, None), (4020, []), (4040, [0.0] * 8), (4060, [float("nan")] * 8), (4080, [None] + [1.0] * 7), (4100, [1.0] * 7), (None, [1.0] * 8), (4120, [float("inf")] * 8), rows[40]]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).withColumn("list", F.lit("clash"))
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
    want = brute(rows, 20)
    assert set(got) == set(want) and all(len(got[q]) == 20 and len({i for _, i in got[q]}) == 20 for q in want)
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 20 for q in want]) > 0.93
    assert [i for _, i in got[3000]] == [i for _, i in want[3000]]


def test_neighbours_of_few(spark):
    rows = [(i, [float(i + 1), 1.0] + [0.0] * 6) for i in (0, 20, 3)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 20, 22.0), (0, 2, 3, 5.0), (20, 1, 3, 85.0), (20, 2, 0, 22.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_large_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr(ann, "BIN", 50)
    monkeypatch.setattr(ann, "QUERIES", 10)
    split, bins = [], ann.bins_of
    monkeypatch.setattr(ann, "bins_of", lambda counts: split.append(bins(counts)) or split[-1])
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(900)]
    got = defaultdict(set)
    for r in ann.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS), F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    want = brute(rows, 20)
    assert (split[0][1] > 1).any()  # lists over several bins
    assert np.mean([len(got[q] & {i for _, i in want[q]}) / 20 for q in want]) > 0.9


def test_pipeline(spark, monkeypatch):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontamination", "bpe_encoding"]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, sf)
        assert out.columns == docs.columns, name
        ids, before = {r.doc_id for r in out.select("doc_id").collect()}, {r.doc_id for r in at.select("doc_id").collect()}
        assert ids <= before and len(ids) > 0.5 * len(before), name
        at = components.cut(out)
    assert at.where("n_chars <> length(text)").count() == 0
    final = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in final.collect()} == {r.doc_id for r in at.select("doc_id").collect()}


def test_links_are_made_by_many_tasks(spark, monkeypatch):
    """The few tasks that join links don't read what the links are made from."""
    from pyspark import TaskContext

    n = spark.sparkContext.accumulator(0)

    def counted(batches):
        n.add(1)
        assert TaskContext.get() is not None
        yield from batches

    links = spark.range(0, 400, 1, 8).selectExpr("id as a", "id + 1 as b").mapInArrow(counted, "a long, b long")
    found = components.connected_components(links)
    assert n.value == 8  # each partition of links is computed once, by a task of its own
    assert {r.component for r in found.collect()} == {0}
