"""Feature spaces, components, clusters and incremental loads: invariants and round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graindex.operators import clusters, features, similarity
from graindex.streaming import incremental


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, v array<double>")


def test_components_of_a_line(spark):
    rng = np.random.default_rng(1)
    t = rng.normal(size=200)
    df = vectors(spark, np.stack([t, 2 * t + 0.05 * rng.normal(size=200)], 1))
    got = features.principal_components(df, "v", 2)
    assert abs(got.axes[0, 1] / got.axes[0, 0]) == pytest.approx(2, abs=0.05) and got.shares[0] > 0.99
    assert abs(got.axes[0] @ got.axes[1]) < 1e-9 and got.shares.sum() == pytest.approx(1)
    mean = np.array([r[0] for r in df.select(got.project(F.col("v"))).collect()]).mean(0)
    assert np.abs(mean).max() < 1e-9


def test_components_of_nothing(spark):
    assert len(features.principal_components(spark.createDataFrame([], "v array<double>"), "v", 2).shares) == 0


def test_space_transforms_its_own_rows(spark):
    rows = [("a", 1.0, ["p", "h"]), ("b", 2.0, ["p", "m"]), ("c", 6.0, ["d", "m"])]
    df = spark.createDataFrame(rows, "id string, og double, tags array<string>").withColumn("flat", F.lit(3.0))
    space = features.fit_space(df, ["og", "flat"], "tags", 0.35, spark.createDataFrame([("m",), ("p",)], "tag string"))
    x = np.array([r[0] for r in df.orderBy("id").select(space.vector("tags")).collect()])
    assert x.shape == (3, 4) and np.abs(x[:, :2].mean(0)).max() < 1e-9 and (x[:, 1] == 0).all()
    assert features.fit_space(df, ["og"], "tags", 0.0, spark.createDataFrame([("m",)], "tag string")).scale.stds[0] == pytest.approx(np.std([1, 2, 6]))
    assert not np.array([r[0] for r in df.select(features.Space(space.scale, ["m"], 0.0).vector("tags")).collect()])[:, 2:].any()


def test_kmeans_finds_two_blobs(spark):
    rng = np.random.default_rng(3)
    df = vectors(spark, np.vstack([rng.normal(0, 0.3, (40, 2)), rng.normal(5, 0.3, (40, 2))]))
    got, centres = clusters.kmeans(df, "id", "v", 2)
    by = {r.id: r.cluster for r in got.collect()}
    assert len({by[i] for i in range(40)}) == 1 and len({by[i] for i in range(40, 80)}) == 1 and by[0] != by[40]
    again, _ = clusters.kmeans(df, "id", "v", 2)
    assert {r.id: r.cluster for r in again.collect()} == by
    labelled = df.join(got, "id")
    mean = similarity.mean_silhouette(labelled, "id", "v", "cluster").first()
    assert mean.n == 80 and mean.mean_silhouette > 0.9
    assert tuple(similarity.mean_silhouette(labelled.where("cluster = 0"), "id", "v", "cluster").first()) == (0, 0.0)


def test_kmeans_takes_the_best_start_and_fills_empty_clusters(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(c, 0.05, (12, 2)) for c in ((0, 0), (4, 0), (0, 4), (9, 9))])
    got, centres = clusters.kmeans(vectors(spark, x), "id", "v", 4)
    assert sorted(np.bincount([r.cluster for r in got.collect()]).tolist()) == [12] * 4
    rows = got.collect()
    for r in rows:
        assert r.distance == pytest.approx(min(np.sqrt(((x[r.id] - c) ** 2).sum()) for c in centres))


def test_kmeans_with_more_clusters_than_rows(spark):
    assert clusters.kmeans(vectors(spark, [[0, 0], [1, 1]]), "id", "v", 5)[0].count() == 2


def test_average_linkage():
    d = [[0, 1, 5, 5], [1, 0, 5, 5], [5, 5, 0, 1], [5, 5, 1, 0]]
    merges = clusters.average_linkage(d)
    assert merges[-1][2] == pytest.approx(5) and merges[0][:2] == (0, 1) and merges[1][:2] == (2, 3)
    assert clusters.leaf_order(merges, 4) == [0, 1, 2, 3]


def test_jaccard_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    sets = {i: set(rng.choice(12, rng.integers(1, 7), replace=False).tolist()) for i in range(60)}
    df = spark.createDataFrame([(i, int(m)) for i, s in sets.items() for m in s] + [(99, None)], "k int, m int")
    rep = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    assert {r.k: r.rep for r in similarity.set_classes(df, "k", "m").collect()} == rep and len(set(rep.values())) < len(rep)
    for least in (0.6, 0.3, 1.0):
        want = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in set(rep.values()) for j in set(rep.values()) if i < j}
        want = {k: v for k, v in want.items() if v >= least}
        got = similarity.jaccard_pairs(df, "k", "m", least).collect()
        assert {(r.a, r.b): r.jaccard for r in got} == pytest.approx(want) and len(got) == len(want)


def test_jaccard_pairs_of_mixed_sizes_intersect_once(spark):
    """Larger and smaller sets have prefixes of their own; what a pair has in common is worked out once a pair that may be alike."""
    rng, sets = np.random.default_rng(11), {}
    for _ in range(25):
        base = rng.choice(400, rng.integers(2, 16), replace=False).tolist()
        for _ in range(4):
            some = set(base[: rng.integers(1, len(base) + 1)]) | set(rng.choice(400, rng.integers(0, 4)).tolist())
            if some not in sets.values():
                sets[int(rng.integers(0, 10**6))] = some
    df = spark.createDataFrame([(f"k{i}", int(m)) for i, s in sets.items() for m in s], "k string, m int")
    for least in (0.5, 0.6, 0.75):
        want = {(f"k{i}", f"k{j}"): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if f"k{i}" < f"k{j}"}
        want = {k: v for k, v in want.items() if v >= least}
        got = similarity.jaccard_pairs(df, "k", "m", least)
        rows = got.collect()
        assert {(r.a, r.b): r.jaccard for r in rows} == pytest.approx(want) and len(rows) == len(want) > 0
    assert got._jdf.queryExecution().optimizedPlan().toString().count("array_intersect") == 1


def test_cosine_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 20)
    monkeypatch.setattr(similarity, "PIVOTS", 7)
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(12, 4)).repeat(6, 0) + 0.4 * rng.normal(size=(72, 4)), np.zeros((1, 4)), np.ones((3, 4))])
    classes = similarity.vector_classes(vectors(spark, x), "id", "v")
    assert {r.rep: r["size"] for r in classes.where("size > 1").collect()} == {73: 3}
    unit = x[:74] / np.maximum(np.sqrt((x[:74] ** 2).sum(1)), 1e-12)[:, None]
    for t in (0.95, 0.5, -0.2):
        want = {(i, j) for i in range(74) for j in range(i + 1, 74) if unit[i].any() and unit[j].any() and unit[i] @ unit[j] >= t}
        got = similarity.cosine_join(classes, t).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    assert similarity.cosine_join(classes.limit(0), 0.5).count() == 0


def test_names_are_matched_as_a_greedy_pass_would(spark):
    from graindex.operators import matching

    rng = np.random.default_rng(9)
    rows = [(a, a, b, b, float(rng.integers(0, 5))) for a in range(30) for b in range(25) if rng.random() < 0.2]
    used, want = set(), set()
    for a in range(30):
        free = sorted((-s, b) for x, _, b, _, s in rows if x == a and b not in used)
        if free:
            used.add(free[0][1])
            want.add((a, free[0][1]))
    found = spark.createDataFrame(rows, "a_id int, a_pos int, b_id int, b_pos int, score double")
    assert {(r.a_id, r.b_id) for r in matching.one_to_one(found).collect()} == want
    names = (["11B Best Bitter", "22A Double IPA", "4A Munich Helles", "Witbier", "Rye Thing"], ["Special Bitter or Best Bitter", "Imperial or Double India Pale Ale", "Münchner Helles", "Belgian-Style Witbier", "Other"])
    a, b = (spark.createDataFrame([(n, n, i, float(i)) for i, n in enumerate(x)], "id string, name string, pos int, abv double") for x in names)
    got = {(r.a_id, r.b_id): r.change for r in matching.guide_difference(a, b, ["abv"]).collect()}
    assert got == {(x, y): "same" for x, y in list(zip(*names, strict=True))[:4]} | {("Rye Thing", None): "removed", (None, "Other"): "added"}


def test_values_at_a_place(spark):
    from graindex.operators import rollups

    rng = np.random.default_rng(10)
    x = {k: np.round(rng.normal(0, 10 ** float(rng.integers(-3, 4)), rng.integers(1, 40)), 3) for k in range(12)} | {None: np.array([0.0, -0.0, 5.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in x.items() for v in vs] + [(3, None)], "k int, v double")
    got = {r.k: r.v for r in rollups.at_place(df, ["k"], "v", lambda n: F.floor(n / 2)).collect()}
    assert got == {k: sorted(v)[len(v) // 2] for k, v in x.items()}


def test_a_dendrogram_is_laid_out(spark):
    points = vectors(spark, [[0, 0], [0, 1], [5, 0], [5, 1]])
    merges = clusters.linkage_of(points, "id", "v")
    places = {node: (x, h) for node, x, h in clusters.layout(merges, 4)}
    assert len(places) == 7 and places[6][0] == 1.5 and places[4] == (0.5, 1.0)
    with pytest.raises(ValueError):
        clusters.linkage_of(points, "id", "v", most=3)


def test_threshold_edges_leave_out_listed_ones(spark):
    pairs = spark.createDataFrame([(1, 2, 0.95), (3, 2, 0.97), (4, 5, 0.5)], "a int, b int, s double")
    listed = spark.createDataFrame([(2, 1)], "a int, b int")
    assert [(r.a, r.b, round(r.weight, 3)) for r in similarity.threshold_edges(pairs, "a", "b", "s", 0.93, listed).collect()] == [(2, 3, 0.571)]


def test_stream_keeps_one_row_a_key_across_restarts(spark, tmp_path):
    schema, inp = "id int, v string", tmp_path / "in"
    run = lambda: incremental.append(incremental.new_rows(spark, str(inp), schema, "id"), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], schema).coalesce(1).write.parquet(str(inp), mode="append")
    run()
    spark.createDataFrame([(2, "d"), (3, "e")], schema).coalesce(1).write.parquet(str(inp), mode="append")
    run()
    assert sorted(r.id for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_rejects_upserts_and_publishing(spark, tmp_path):
    schema = "id int, v string"
    spark.createDataFrame([(1, "a"), (2, None)], schema).write.parquet(str(tmp_path / "in"))
    rows = incremental.new_rows(spark, str(tmp_path / "in"), schema, "id")
    incremental.split_rejects(rows, F.col("v").isNotNull(), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "log")).awaitTermination()
    assert [r.id for r in spark.read.parquet(str(tmp_path / "good")).collect()] == [1] and [r.id for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [2]
    old, new = (spark.createDataFrame(r, schema) for r in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert sorted(tuple(r) for r in incremental.upsert(old, new, "id").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    for _ in range(3):
        version = incremental.publish(spark, lambda p: old.write.parquet(p), str(tmp_path / "pub"))
    assert version == "v3" and (tmp_path / "pub/current").read_text() == "v3" and not (tmp_path / "pub/v1").exists()
    assert spark.read.parquet(incremental.current(spark, str(tmp_path / "pub"))).count() == 2
