"""Importance resampling, main text and periodic runs against plain references."""

import hashlib
import html as entities
import math
import random
import re
from collections import Counter
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graindex.llm import htmltext, page_labels, periodic, queries, resample

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"
PAGES = "page_id bigint, url string, html string"


# periodic runs


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_row(text):
    """What the query gives for one text that is already planted."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in (told, kept)]
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digest)


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return text
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)])


BLOCK = st.lists(st.sampled_from("ab"), min_size=1, max_size=9)
PIECE = st.one_of(st.lists(st.sampled_from("abcdef"), max_size=30), st.tuples(BLOCK, st.integers(3, 30)).map(lambda x: x[0] * x[1]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(PIECE, max_size=4).map(lambda x: sum(x, [])), min_size=1, max_size=4))
def test_runs_of_equals_all_periods(texts):
    got = list(periodic._answers([" ".join(t) for t in texts]))
    for words, (n, runs, _) in zip(texts, got, strict=True):
        assert n == len(words)
        assert [(r["start"], r["length"], r["period"]) for r in runs] == plain_runs(words)


def test_masking_leaves_few_words_of_plain_text():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 5000, 20_000)
    words[9000:9040] = words[100:140]  # a passage that repeats elsewhere survives, and is no run
    assert periodic.OVERLAP == 16
    assert np.flatnonzero(periodic.masked(words, np.zeros(20_000, np.int64))).tolist() == [*range(100, 140), *range(9000, 9040)]
    assert not len(periodic.runs_of(words, np.zeros(20_000, np.int64)))


def test_runs_do_not_cross_documents():
    texts = ["x y " * 11, "x y " * 11, "x y " * 12]
    assert [len(r) for _, r, _ in periodic._answers(texts)] == [0, 0, 1]


def test_op13_equals_plain_reference(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        assert got[r.doc_id] == plain_row(planted(r.doc_id, r.text)), r.doc_id
    assert sum(v[0] > 0 for v in got.values()) > 5


def test_runs_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000)) + " a b c" * 20_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "z " * 30), (5, "z z " * 30), (5, "z z " * 30), (6, long), (7, "é\x1cé " * 24)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("Runs", F.lit("clash")).withColumn("_text", F.lit(1)).withColumn("n words", F.lit(2))
    out = periodic.find_runs(docs)
    assert out.columns == ["doc_id", "text", "_text", "n words", "n_words", "runs", "collapsed"]
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    assert got[1] == got[2] == got[3] == [(0, [], "")]
    assert got[None] == [(30, [(0, 30, 1)], "z")]
    assert got[5] == [(30, [(0, 30, 1)], "z z")] * 2
    assert got[6] == [(90_000, [(30_000, 60_000, 3)], " ".join(f"w{i}" for i in range(30_000)) + " a b c")]
    assert got[7] == [(24, [(0, 24, 1)], "é\x1cé")]
    assert periodic.digests(periodic.find_runs(periodic.with_planted_runs(docs.limit(0)))).count() == 0


# importance resampling


def plain_draw(docs, target, share, seed=2024, least=20, buckets=10_000, ngram=1):
    def told(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return [" ".join(words[i : i + k]) for k in range(1, ngram + 1) for i in range(len(words) - k + 1)], len(words)

    place = lambda f: crc32(f.encode()) % buckets
    s, t = (Counter(place(f) for x in texts for f in told(x)[0]) for texts in ([x for _, x in docs], target))
    n, m = s.total(), t.total()
    out = []
    for i, x in docs:
        fs, words = told(x)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets)))) for b in map(place, fs)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least))
    eligible = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0]))
    rank = {r[0]: k + 1 for k, r in enumerate(eligible[: share * len(eligible) // 100])}
    return sorted((*r[:4], rank.get(r[0])) for r in out)


@pytest.mark.parametrize(("ngram", "share", "size", "run"), [(1, 10, 200_000, 100_000), (2, 40, 30, 50), (3, 100, 7, 20)])
def test_draw_equals_plain_reference(spark, monkeypatch, ngram, share, size, run):
    monkeypatch.setattr(resample, "SLICE", size)
    monkeypatch.setattr(resample, "RUN", run)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(5)
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = sorted(tuple(r) for r in resample.resample(docs, target, share, ngram=ngram).collect())
    assert got == plain_draw([tuple(r) for r in docs.collect()], [r.text for r in target.collect()], share, ngram=ngram)


def test_tournament_merges_any_number_of_runs():
    rng = random.Random(2)
    for k in [0, 1, 2, 3, 5, 8, 13]:
        runs = [sorted((rng.randint(0, 9), j, i) for i in range(rng.randint(0, 12))) for j in range(k)]
        assert list(resample.Tournament([iter(r) for r in runs])) == sorted(sum(runs, []))


def test_rows_of_one_id_fill_no_slice(spark, monkeypatch):
    monkeypatch.setattr(resample, "SLICE", 100)
    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(7, text)] * 3000 + [(i, text) for i in range(100, 200)], DOCS)
    sizes = []
    kept = resample.release
    monkeypatch.setattr(resample, "release", lambda t: (sizes.extend(r[0] for r in t.groupBy("part").agg(F.sum("n")).select("sum(n)").collect()), kept(t)))
    ranks = [r["rank"] for r in resample.resample(docs, docs.limit(0), 100).collect()]
    assert sorted(ranks) == list(range(1, 3101))
    assert len(sizes) > 20 and max(sizes) < 500


def test_draw_edges(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(1, None), (2, ""), (3, "short text"), (None, text), (None, text), (4, text), (4, text), (5, "É" * 50 + " " + text), (6, (text + " ") * 20_000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("rank", F.lit("x")).withColumn("row_key", F.lit(1)).withColumn("_text", F.lit(2))
    target = spark.createDataFrame([(1, "w1 w2 w3"), (2, None)], DOCS)
    out = resample.resample(docs, target, 100, keep=("text", "rank", "_text"))
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank", "text", "_text"]
    got = out.collect()
    assert len(got) == len(rows) and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 7))
    by = {r.doc_id: r for r in got}
    assert [(by[i].n_features, by[i].weight, by[i]["rank"]) for i in (1, 2)] == [(0, 0, None)] * 2
    assert by[3].n_features == 2 and by[3]["rank"] is None and by[6].n_features == 500_000 and by[5].n_features == 26
    assert resample.resample(docs.limit(0), target).count() == 0
    assert {r["rank"] for r in resample.resample(docs, target.limit(0), 0).collect()} == {None}


# main text


def marked_text(html):
    """The text of a made-up page by its labels."""
    page, blocks = htmltext.Page(html), {}
    for _, block, told in page.tokens:
        if words := [w.replace(page_labels.MARK, "") for w in (told or "").split() if w.startswith(page_labels.MARK)]:
            blocks.setdefault(block, []).extend(words)
    return "\n".join(map(" ".join, blocks.values()))


@pytest.fixture(scope="module")
def learnt():
    return htmltext.weights(htmltext.made_up_counts()).tolist()


def test_main_text_of_held_out_layouts(learnt):
    same, shares = 0, []
    pages = page_labels.labelled_pages(200, seed=1234)
    for html in pages:
        want, got = marked_text(html), htmltext.main_text(html.replace(page_labels.MARK, ""), learnt)
        same += want == got
        a, b = Counter(want.split()), Counter(got.split())
        shares.append(2 * (a & b).total() / max(1, a.total() + b.total()))
    assert same / len(pages) > 0.9 and np.mean(shares) > 0.98


def test_op12_equals_marked_articles(spark):
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op12_main_text(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.sub(r"<b>|<br>", "", r.html[r.html.index("<article>") + 9 : r.html.index("</article>")])
        blocks = (" ".join(entities.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        want = "\n".join(x for x in blocks if x)
        assert got[r.page_id] == (want, len(want)), r.page_id


CASES = {
    '<body><div class="cookie-banner"><p>We use cookies to improve. Accept them all.</p><button>OK</button></div><div class="menu"><a href=/>Home</a> <a href=/>News</a></div><div id="content"><h1>Title\n here</h1>'
    '<p>One two three four five six.</p><div class="advertisement">Buy now cheap</div><p>Eight &lt;b&gt; &eacute;t&#233;&nbsp;ten.</p><form><label>Your email</label></form></div><div class="sidebar"><ul><li><a>Foo</a></li></ul></div>'
    '<section id="comments"><p>I liked this a lot, great read, thank you so much for this.</p></section></body>': "Title here\nOne two three four five six.\nEight <b> été ten.",
    "<body><form id=aspnetForm><nav><a>x</a></nav><article><h1>T</h1><p>word word word</p></article></form></body>": "T\nword word word",
    '<body class="single has-sidebar no-comments"><main><h1>T</h1><p>word word word<br>word</main><aside>junk</aside>': "T\nword word word word",
    '<main><article class="post"><h1>T</h1><p>word word word</p></article><section class="comments"><article class="comment"><p>nice one two three four five six</p></article></section></main>': "T\nword word word",
    "<article><script>if (a < b) '</p>';</script><p title=\"x>y's\">hello <a href=foo>link</a>, ok<!-- <p>no --></p><style>p{}</style></article>": "hello link, ok",
    "<p>a < b and c > d": "a < b and c > d",
    "just text &amp; more": "just text & more",
    "<nav><a>Home</a></nav>": "",
    "": "",
}


@pytest.mark.parametrize("html", CASES)
def test_main_text_cases(learnt, html):
    assert htmltext.main_text(html, learnt) == CASES[html]


def test_main_text_edges(spark):
    deep, broken = "<div>" * 20_000 + "<p>deep words here</p>", "<div><a \"" * 20_000
    rows = [(1, None, None), (None, "u", "<article><p>x y z</p></article>"), (3, "u", ""), (3, "u", ""), (4, "u", deep), (5, "u", broken), (6, "u", "<article><p>" + "word " * 200_000 + "</p></article>")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("TEXT", F.lit(1)).withColumn("_html", F.lit(2))
    w = htmltext.fit(pages)
    out = htmltext.extract_text(pages, w)
    assert out.columns == ["page_id", "url", "html", "_html", "text", "n_chars"]
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in out.drop("html").collect()), key=lambda x: x[0])
    assert [x[:2] for x in got[:5]] == [(0, "x y z"), (1, ""), (3, ""), (3, ""), (4, "deep words here")]
    assert got[6][2] == 5 * 200_000 - 1
    assert htmltext.extract_text(pages.limit(0), htmltext.fit(pages.limit(0))).count() == 0
