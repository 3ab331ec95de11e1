"""Crawls that are killed, retries by a clock, roll-ups of batches, stored projections, boxes, wide spaces, deep pages."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from graindex.functions.rng import Mulberry, random_number
from graindex.operators import boxes, browse, corpus, features, relational, rollups, standing
from graindex.sources import crawl, projected
from graindex.streaming import retries


class Listing(crawl.Site):
    """Pages 1 to ``many`` of each mode with two rows each; a page named in the folder ``broken`` can't be read."""

    def __init__(self, folder, many):
        self.folder, self.many = folder, many

    def last(self, mode, after, most):
        return min(self.many.get(mode, 0), after + most)

    def page(self, mode, number):
        if (self.folder / f"{mode}-{number}").exists():
            raise OSError(f"{mode} {number}")
        return [(number * 10 + i, f"{mode}{number}") for i in range(2)] if number % 4 else []


def run(spark, site, modes, out, pages=3):
    rows = crawl.crawl(spark, "crawl_of_tests", site, modes, "id bigint, text string", pages)
    query = rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p.numInputRows for p in query.recentProgress)


def test_a_killed_crawl_goes_on_without_loss_or_repeat(spark, tmp_path):
    broken, many = tmp_path / "broken", {"new": 8, "search:ale": 2}
    broken.mkdir()
    modes = ["new", "search:ale"]
    taken = lambda: sorted((r.mode, r.page, r.id) for r in spark.read.parquet(f"{tmp_path}/rows").collect())
    want = lambda last: sorted((m, n, n * 10 + i) for m, k in last.items() for n in range(1, k + 1) if n % 4 for i in range(2))
    assert run(spark, Listing(broken, many), modes, tmp_path) == 5  # pages 1 to 3, and both of the search
    assert taken() == want({"new": 3, "search:ale": 2})
    (broken / "new-5").touch()
    with pytest.raises(StreamingQueryException):
        run(spark, Listing(broken, many), modes, tmp_path)
    assert taken() == want({"new": 3, "search:ale": 2})  # page 4 isn't kept without 5 and 6
    (broken / "new-5").unlink()
    run(spark, Listing(broken, many), modes, tmp_path)
    assert taken() == want({"new": 6, "search:ale": 2})
    many |= {"new": 9, "search:ale": 3, "other": 1}
    for _ in range(3):
        run(spark, Listing(broken, many), [*modes, "other"], tmp_path)
    assert taken() == want(many)
    assert run(spark, Listing(broken, many), [*modes, "other"], tmp_path) == 0


def test_a_folder_of_pages_ends_at_the_first_gap(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 2, None), ("a", 4, 4, "z")], "mode string, page int, id bigint, text string")
    df.write.partitionBy("mode", "page").parquet(f"{tmp_path}/site")
    site = crawl.Folder(f"file://{tmp_path}/site")
    assert [site.last("a", k, 10) for k in (0, 1, 2, 3)] == [2, 2, 2, 4] and site.last("b", 0, 5) == 0 and site.last("a", 0, 1) == 1
    assert list(site.page("a", 2)) == [(2, None)]


class Clock:
    """The handle, list state and clock of a processor without a stream."""

    def __init__(self):
        self.now, self.timers, self.rows, self.touched = 0, set(), [], 0

    def getListState(self, name, schema):
        return self

    def registerTimer(self, at):
        self.timers.add(at)

    def listTimers(self):
        return iter(sorted(self.timers))

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows, self.touched = list(rows), self.touched + 1

    def appendList(self, rows):
        self.rows, self.touched = self.rows + list(rows), self.touched + 1

    def clear(self):
        self.rows = []

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def run(self, processor, until):
        """Let the clock run; expired timers are listed until they have been handled, as Spark does."""
        out = []
        while (due := [t for t in self.timers if t <= until]) and (at := min(due)) is not None:
            self.now = max(self.now, at)
            out += [(self.now, r.item, r.outcome, r.tries) for r in processor.handleExpiredTimer((0,), self, None)]
            self.timers.discard(at)
        self.now = until
        return out


def test_retries_by_a_clock():
    fails = {1: 0, 2: 1, 3: 4, 4: 2}
    processor = retries.Retries(lambda item, n: retries.LATER if n <= fails[item["id"]] else retries.GONE if item["id"] == 4 else retries.DONE, 100, 500)
    clock = Clock()
    processor.init(clock)
    row = lambda i: type("R", (), {"__getitem__": lambda self, _: f'{{"id":{i}}}'})()
    assert [(r.item, r.outcome, r.tries) for r in processor.handleInputRows((0,), iter([row(1)]), clock)] == [('{"id":1}', "done", 1)]
    assert not clock.touched and not clock.timers  # what ends well at once leaves no state
    assert list(processor.handleInputRows((0,), iter([row(2), row(3)]), clock)) == []
    clock.now = 50
    assert list(processor.handleInputRows((0,), iter([row(4)]), clock)) == []
    assert clock.run(processor, 99) == []
    assert clock.run(processor, 160) == [(100, '{"id":2}', "done", 2)]
    # 3 fails at 0, 100, 300 and 700, 4 at 50 and 150
    assert clock.run(processor, 2000) == [(350, '{"id":4}', "gone", 3), (1200, '{"id":3}', "done", 5)]
    assert not clock.rows
    assert [retries.delay(n, 100, 500) for n in (1, 2, 3, 4, 60)] == [100, 200, 400, 500, 500]


def test_packs_wait_as_one_row_and_split_by_outcome():
    fails = {1: 0, 2: 1, 3: 1, 4: 2, 5: 0}
    processor, clock = retries.Retries(lambda item, n: retries.LATER if n <= fails[item["id"]] else retries.GONE if item["id"] == 3 else retries.DONE, 100, 500), Clock()
    processor.init(clock)
    lines = lambda *ids: "\n".join(f'{{"id":{i}}}' for i in ids)
    assert [(r.item, r.outcome, r.tries) for r in processor.handleInputRows((0,), iter([{"item": lines(1, 2, 3, 4, 5)}]), clock)] == [(lines(1, 5), "done", 1)]
    assert clock.rows == [(100, 1, lines(2, 3, 4))]
    assert clock.run(processor, 2000) == [(100, lines(2), "done", 2), (100, lines(3), "gone", 2), (300, lines(4), "done", 3)]
    assert not clock.rows and not clock.timers


def test_retried_events_run_to_their_end(spark, monkeypatch):
    """No limit of time cuts the query short, and shards grow with the table."""
    from graindex.plans import standing as plans

    asked, run, dealt = [], retries.run_settled, retries.with_retries
    monkeypatch.setattr(retries, "run_settled", lambda *a, **k: asked.append(k.get("limit", 600)) or run(*a, **k))
    monkeypatch.setattr(retries, "with_retries", lambda *a: asked.append(a[4]) or dealt(*a))
    monkeypatch.setattr(plans, "SHARD", 20, raising=False)
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    got = plans.retried_events(spark, sf)
    assert got.count() == n == got.select("event_id").distinct().count() and asked == [n // 20, math.inf]


def test_every_item_is_settled_whatever_the_order():
    rng = random.Random(4)
    fails = {i: rng.randint(0, 5) for i in range(200)}
    processor, clock, out = retries.Retries(lambda item, n: retries.LATER if n <= fails[item["id"]] else retries.DONE, 70, 900), Clock(), []
    processor.init(clock)
    for at in range(0, 200, 20):
        out += clock.run(processor, at * 7)
        rows = [type("R", (), {"__getitem__": lambda self, _, i=i: f'{{"id":{i}}}'})() for i in range(at, at + 20)]
        out += [(clock.now, r.item, r.outcome, r.tries) for r in processor.handleInputRows((0,), iter(rows), clock)]
    out += clock.run(processor, 10**6)
    assert sorted((item, tries) for _, item, _, tries in out) == sorted((f'{{"id":{i}}}', n + 1) for i, n in fails.items())


def bill_rows(spark):
    rng = random.Random(8)
    rows = []
    for g in range(120):
        for _ in range(rng.randint(0, 5)):
            rows.append((rng.choice(["ale", "lager", None]) if g % 7 == 0 else "ale", g, rng.choice(["citra", "saaz", "fuggle", None]), rng.choice(["malt", "base"]), rng.choice("xyz"), float(rng.randint(1, 40)), rng.random(), rng.choice([None, 0.0, 20.0, 25.0]) if g % 3 else 20.0))
    lines = spark.createDataFrame(rows, "family string, group int, item string, kind string, stage string, amount double, share double, batch double")
    groups = spark.createDataFrame([(g, "ale" if g % 2 else "lager", float(g) if g % 5 else None) for g in range(120)], "group int, family string, price double")
    return lines, groups


def test_batches_of_roll_ups_equal_one_build(spark, tmp_path):
    lines, groups = bill_rows(spark)
    whole = standing.state_of(lines, groups, ["x", "y"], ["price"])
    for batch in range(3):
        part = standing.state_of(lines.where(F.col("group") % 3 == batch), groups.where(F.col("group") % 3 == batch), ["x", "y"], ["price"])
        assert standing.fold(spark, str(tmp_path), batch, part)
        assert not standing.fold(spark, str(tmp_path), batch, part)
    kept = standing.stored(spark, str(tmp_path))
    key = lambda r: tuple("" if v is None else round(v, 9) if isinstance(v, float) else v for v in r)
    for board in (standing.leaderboard, standing.mean_shares, lambda s: standing.outcomes(s, ["price"])):
        assert sorted(map(str, map(key, board(kept).collect()))) == sorted(map(str, map(key, board(whole).collect())))
    direct = rollups.leaderboard(lines, "family", "group", "item", "stage", ["x", "y"], "amount", "batch")
    got = {(r.family, r.item): (r.n_groups, round(r.total, 9), r.median_dose) for r in standing.leaderboard(kept).collect()}
    assert got == {(r.family, r.item): (r.n_groups, round(r.total, 9), r.median_dose) for r in direct.collect()}


def test_a_stream_keeps_roll_ups(spark, tmp_path):
    lines, groups = bill_rows(spark)
    for part in range(2):
        lines.where(F.col("group") % 2 == part).write.parquet(f"{tmp_path}/in/{part}")
        rows = spark.readStream.schema(lines.schema).parquet(f"{tmp_path}/in/*")
        made = lambda batch: standing.state_of(batch, batch.select("group", "family", F.lit(1.0).alias("price")).distinct(), ["x"], ["price"])
        standing.keep_up(rows, made, f"{tmp_path}/state", f"{tmp_path}/log").awaitTermination()
    n = {r.family: r.n_groups for r in standing.stored(spark, f"{tmp_path}/state")["groups"].collect()}
    assert n["all"] == lines.select("family", "group").distinct().count()


def test_stored_projections_are_read_by_folder_and_bucket(spark, tmp_path):
    ids = spark.range(400).withColumnRenamed("id", "k")
    points = ids.crossJoin(spark.createDataFrame([(m, b) for m in ("pca", "umap") for b in (0.0, 0.5, 1.0)], "method string, blend double")).select("k", "method", "blend", (F.col("k") * F.col("blend")).alias("x"))
    variance = spark.createDataFrame([("pca", 0.5, 0, 0.25)], "method string, blend double, axis int, share double")
    projected.store(points, variance, ids.where("k % 3 > 0").withColumn("name", F.col("k").cast("string")), "k", f"{tmp_path}/p", "kept_points_test", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for again in (False, True):
            if again:  # as another session finds it
                projected.attach(spark, f"{tmp_path}/p", "kept_points_test", "k bigint, x double, method string, blend double", "k bigint, name string", "k", 4)
            stored, details, shares = projected.tables(spark, "kept_points_test")
            page = browse.projection_page(stored, details, "k", "pca", 1.0, 50)
            got = [(r.k, r.x, r["name"]) for r in page.collect()]
            assert len(got) == 50 and all(x == k and name == str(k) for k, x, name in got)
            plan = page._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan.split("Initial Plan")[-1] and "SortMergeJoin" in plan
            filters = [line for line in plan.splitlines() if "PartitionFilters" in line and "method" in line.split("PartitionFilters")[1]]
            assert filters and shares.first().share == 0.25
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for what in ("points", "details", "variance"):
            spark.sql(f"DROP TABLE IF EXISTS kept_points_test_{what}")


def test_shares_of_variance_come_with_projections(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, *map(float, rng.normal(size=9))) for i in range(60)], "id int, " + ", ".join(f"v{i} double" for i in range(9)))
    points, shares = corpus.projections_and_variance(rows)
    assert points.count() == 180
    got = {(r.blend, r.axis): r.share for r in shares.collect()}
    assert len(got) == 9 and all(0 <= s <= 1 and round(s, 4) == s for s in got.values()) and got[0.5, 0] >= got[0.5, 1]


def plain_fit(item, ranges, axes):
    best = None
    for name, *ends in sorted(ranges):
        inside, off, n = 0, 0.0, 0
        for i in range(axes):
            v, lo, hi = item[i], ends[2 * i], ends[2 * i + 1]
            if v is None or lo is None or hi is None:
                continue
            n += 1
            inside += lo <= v <= hi
            off += abs(v - (lo + hi) / 2) / max((hi - lo) / 2, 1e-9)
        if n and (best is None or (-inside, off / n) < best[:2]):
            best = (-inside, off / n, name)
    return (best[2], -best[0], best[1]) if best else (None, None, None)


@pytest.mark.parametrize(("many", "chunk", "items"), [(600, 40, 100), (300, 1000, 20_000), (0, 40, 100)])
def test_many_boxes_equal_brute_force(spark, monkeypatch, many, chunk, items):
    monkeypatch.setattr(boxes, "CHUNK", chunk)
    monkeypatch.setattr(boxes, "ITEMS", items)
    monkeypatch.setattr(relational, "FEW_BOXES", 0 if not many else 256)
    rng = random.Random(many)
    end = lambda: (None, None) if rng.random() < 0.15 else (lambda lo: (lo, round(lo + rng.choice([0, 0.3, 2.0]), 1)))(round(rng.gauss(0, 3), 1))
    ranges = [(f"b{i:04d}", *end(), *end(), *end()) for i in range(many)]
    ranges += [("z" + r[0], *r[1:]) for r in ranges[:40]] + [("none", *[None] * 6)] * (many > 0)
    value = lambda: None if rng.random() < 0.1 else round(rng.gauss(0, 3.5), 1)
    rows = [(i, value(), value(), value()) for i in range(250)] + [(7, None, None, None), (None, 1.0, 1.0, 1.0)] + [(1000 + i, 1.0, 0.5, 0.0) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    held = spark.createDataFrame(ranges, "name string, a_lo double, a_hi double, b_lo double, b_hi double, c_lo double, c_hi double")
    got = sorted((tuple(r) for r in relational.best_fit(df, "id", held, ["a", "b", "c"], "name").collect()), key=str)
    want = sorted(((r[0], *plain_fit(r[1:], ranges, 3)) for r in rows), key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(g[3] == w[3] or g[3] == pytest.approx(w[3]) for g, w in zip(got, want, strict=True))


def test_items_are_not_shuffled_to_many_boxes(spark, monkeypatch):
    """Items of many values are searched where they are read, in one or more blocks, whatever boxes tie between these."""
    for name, value in (("SAME", 0), ("SMALL", 0), ("CHUNK", 2), ("BLOCK", 70), ("HELD", 1), ("GATHERED", 100)):
        monkeypatch.setattr(boxes, name, value, raising=False)
    rng = random.Random(5)
    end = lambda: (None, None) if rng.random() < 0.2 else (lambda lo: (lo, lo + rng.choice([0.0, 1.0, 4.0])))(float(rng.randint(-6, 6)))
    ranges = [(f"b{rng.random()}", *end(), *end()) for _ in range(400)]
    rows = [(i, rng.choice([None, float(rng.randint(-9, 9))]), rng.choice([None, rng.gauss(0, 4)])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    held = spark.createDataFrame(ranges, "name string, a_lo double, a_hi double, b_lo double, b_hi double")
    out = relational.best_fit(df, "id", held, ["a", "b"], "name")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(r) for r in out.collect())
    want = [(r[0], *plain_fit(r[1:], ranges, 2)) for r in rows]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(g[3] == w[3] or g[3] == pytest.approx(w[3]) for g, w in zip(got, want, strict=True))


def test_wide_components_equal_the_matrix(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    want, got = features.principal_components(df, "embedding", 4), features.wide_components(df, "embedding", 64, 4)
    assert np.abs(want.axes - got.axes).max() < 1e-6 and np.abs(want.shares - got.shares).max() < 1e-9
    on = {r[0]: r[1] for r in features.coordinates(df, "vec_id", "embedding", got).collect()}
    for r in df.select("vec_id", want.project(F.col("embedding").cast("array<double>")).alias("p")).limit(20).collect():
        assert on[r.vec_id] == pytest.approx(r.p, abs=1e-6)
    assert len(features.wide_components(df.limit(0), "embedding", 64, 4).shares) == 0


def test_coordinates_hold_few_rows_at_a_time(spark, monkeypatch):
    """Full batches of rows, dense or with some entries missing, cost a task a few blocks, not rows x entries x axes."""
    rng, taken = np.random.default_rng(7), []
    df = spark.createDataFrame([(1, [0.0])], "id bigint, v array<double>")
    found = features.Components(np.ones(64), rng.normal(size=(64, 64)), np.ones(64))
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: taken.append(f))
    features.coordinates(df, "id", "v", found)
    project, x = taken[0], rng.normal(size=(10_000, 64))
    short = [row[: 64 - i % 2].tolist() for i, row in enumerate(x[:5000])]
    for rows, size in ((x.tolist(), 64), (short, 63)):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, pa.list_(pa.float64()))], names=["id", "v"])
        tracemalloc.start()
        first = next(got := project(iter([batch])))
        rest = sum(b.num_rows for b in got)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40e6 and first.num_rows + rest == len(rows)
        want = np.array(rows[1]) @ found.axes.T[:size] - found.axes @ found.mean
        assert first.column(1)[1].as_py() == pytest.approx(want.tolist())


def test_components_of_a_restarted_basis(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 40)) * np.linspace(1, 2, 40)
    df = spark.createDataFrame([(row.tolist(),) for row in x], "v array<double>")
    want, got = features.principal_components(df, "v", 2), features.wide_components(df, "v", 40, 2, extra=4, most=18, tolerance=1e-9)
    assert np.abs(want.axes - got.axes).max() < 1e-6


def test_tags_as_sparse_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [f"t{rng.randint(0, 400)}" for _ in range(8)] + ["a"] * (i % 2) + ["b", "b"] * (i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, tags array<string>")
    vectors, placed, many = features.tag_vectors(df, "id", "tags", 2)
    place = {r.tag: r.place for r in placed.collect()}
    assert [place[t] for t in sorted(place)] == list(range(many))
    x = np.zeros((300, many))
    for i, tags in rows:
        for t in set(tags) & set(place):
            x[i, place[t]] = 1
    cov = np.cov(x.T)
    got = features.wide_components(vectors, "v", many, 3)
    values = np.linalg.eigvalsh(cov)[::-1]
    assert got.shares == pytest.approx(values[:3] / values.sum(), abs=1e-9)
    assert np.abs(got.axes @ cov @ got.axes.T - np.diag(values[:3])).max() < 1e-6


def test_deep_pages_equal_pages(spark, monkeypatch):
    monkeypatch.setattr(relational, "HELD", 20)
    monkeypatch.setattr(relational, "CELLS", 7)
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 5.0, 5.0, -1e9, rng.gauss(0, 1), rng.gauss(1000, 1e-3)]), rng.randint(0, 9) * 86_400) for i in range(1500)]
    df = spark.createDataFrame(rows, "k long, v double, s long").withColumn("t", F.col("s").cast("timestamp"))
    for column in ("v", "t"):
        for down in (False, True):
            for offset in (0, 21, 777, 1490, 1600):
                want = [r.k for r in relational.page(df, column, down, "k", 15, offset).collect()]
                assert [r.k for r in relational.deep_page(df, column, down, "k", 15, offset).collect()] == want, (column, down, offset)
    few = relational._around(df, "v", False, 777, 15)[0]
    assert few.count() < 600


def test_random_numbers(spark):
    def plain(seed):
        """The generator as it is published, in 32-bit words."""
        a = seed & 0xFFFFFFFF
        while True:
            a = (a + 0x6D2B79F5) & 0xFFFFFFFF
            t = (a ^ (a >> 15)) * (1 | a) & 0xFFFFFFFF
            t = ((t + ((t ^ (t >> 7)) * (61 | t) & 0xFFFFFFFF)) & 0xFFFFFFFF) ^ t
            yield ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296

    for seed in (0, 42, -1, 2**31 + 5):
        want = [x for x, _ in zip(plain(seed), range(1000))]
        got = [r[0] for r in spark.range(1, 1001).select(random_number(seed, F.col("id"))).collect()]
        draw = Mulberry(seed)
        assert got == want == [draw() for _ in range(1000)]
    assert got[0] < 1 and math.isclose(np.mean(got), 0.5, abs_tol=0.05)
    assert Mulberry(42)() == 0.6011037519201636
    assert spark.range(1).select(random_number(1, F.lit(None))).first()[0] is None


def test_names_in_order_of_a_collation(spark):
    want = ["ab", "ærø", "Apfel", "Äpfel", "apple", "B", "eclair", "éclair", "lodz", "łódź", "Ol", "øl", "strasse", "Strasse", "Straße", "Zebra"]
    df = spark.createDataFrame([(n,) for n in sorted(want)], "n string")
    assert [r.n for r in df.orderBy(*browse.name_order("n")).collect()] == want
    ids = ["9A", "10a", "10B", "10C", "T1", "tø", "u"]
    assert [r.n for r in spark.createDataFrame([(i,) for i in sorted(ids)], "n string").orderBy(*browse.id_order("n")).collect()] == ids
