"""Searches of vectors in blocks against plain loops."""

import math

import pytest
from pyspark.sql import functions as F

from graindex.operators import similarity as S

VECTORS = {i: [float((i * 7 + 3 * j * j) % 11) - 5 for j in range(4)] for i in range(40)} | {40: [0.0] * 4, 41: None, 42: [1.0, 2.0], 43: [1.0, None, 2.0, 3.0], 44: [-2.0, 1.0, 2.0, -4.0], 45: [-2.0, 1.0, 2.0, -4.0]}


def cosine(a, b):
    if not a or not b or len(a) != len(b) or None in a or None in b:
        return 0.0
    norm = math.hypot(*a) * math.hypot(*b)
    return sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm else 0.0


def distance(a, b):
    return math.dist(a, b) if a and b and len(a) == len(b) and None not in a and None not in b else None


@pytest.fixture
def small(monkeypatch):
    for name, value in (("SEARCH_QUERIES", 3), ("SEARCH_ROWS", 9), ("TILE", (2, 4))):
        monkeypatch.setattr(S, name, value)


def test_cosine_search_equals_brute_force(spark, small):
    rows = spark.createDataFrame(list(VECTORS.items()), "id long, v array<float>")
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in S.cosine_search(rows, F.col("id") % 4 == 0, "id", "v", 5).collect()}
    want = {}
    for q in range(0, 46, 4):
        best = sorted((-round(cosine(VECTORS[q], v), 9), i) for i, v in VECTORS.items() if i != q)[:5]
        want |= {(q, n): (i, pytest.approx(-s)) for n, (s, i) in enumerate(best, 1)}
    assert got == want


def test_blend_search_equals_brute_force(spark, small):
    tags = {i: [str(i % 3), str(i % 5)][: i % 4] for i in VECTORS}
    rows = spark.createDataFrame([(i, v, tags[i]) for i, v in VECTORS.items()], "id long, v array<float>, t array<string>")
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in S.blend_search(rows, F.col("id") % 4 == 0, "id", "v", "t", 0.5, 6).collect()}
    want = {}
    for q in range(0, 46, 4):
        d = {i: distance(VECTORS[q], v) for i, v in VECTORS.items()}
        known = sorted(x for x in d.values() if x is not None)
        scale = known[math.floor(len(known) * 0.95)] or 1
        j = {i: len({*tags[q]} & {*t}) / len({*tags[q]} | {*t}) if tags[q] or t else 0 for i, t in tags.items()}
        score = {i: 0.5 * j[i] + (0 if d[i] is None else 0.5 * max(0, 1 - d[i] / scale)) for i in VECTORS if i != q}
        best = sorted((-round(s, 9), i) for i, s in score.items())[:6]
        want |= {(q, n): (i, pytest.approx(-s)) for n, (s, i) in enumerate(best, 1)}
    assert got == want
