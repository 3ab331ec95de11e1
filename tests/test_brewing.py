"""Tags, statistics, bills, aroma, oils, imports and corpus steps on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graindex.functions import brewing, domain
from graindex.operators import corpus


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def box(lo, hi):
    return F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))


def test_derived_tags(spark):
    num = [F.lit(x) for x in (1.09, 9.5, 25.0, 25.0)]
    assert one(spark, brewing.derived_tags(F.lit("Imperial Stout"), *num, F.lit("Lager")))[0] == ["very-high-strength", "dark-color", "malty", "bottom-fermented", "lagered", "stout-family"]
    none = F.lit(None).cast("double")
    assert one(spark, brewing.derived_tags(F.lit("x"), none, none, none, none))[0] == []


def test_catch_all_ranges_go_and_final_gravity_is_estimated(spark):
    s = brewing.sanitised(box(1.05, 1.06), box(0.095, 1.06), box(5, 6), box(0, 100), box(0, 50))
    r = one(spark, *[c.alias(k) for k, c in s.items()])
    assert r.ibu is None and r.srm is None and r.og.lo == 1.05 and (r.fg.lo, r.fg.hi) == (1.012, 1.014)
    junk = brewing.sanitised(box(1.0, 1.12), box(1.0, 1.01), box(0, 25), box(1, 2), box(1, 2))
    r = one(spark, *[c.alias(k) for k, c in junk.items()])
    assert r.og is None and r.abv is None and r.fg.hi == 1.01


def test_bills(spark):
    df = spark.createDataFrame([([("Pale Malt", 9.0), ("Black Malt", 1.0)], [("a", 20.0), ("b", 30.0)]), ([], [])], "malts array<struct<name:string,kg:double>>, hops array<struct<name:string,g:double>>").coalesce(1)
    g = df.withColumn("malts", brewing.grist(F.col("malts")))
    rows = g.select("malts", brewing.grist_share(F.col("malts"), "roasted").alias("dark"), brewing.hop_dose(F.col("hops"), F.lit(20.0)).alias("dose"), brewing.hop_dose(F.col("hops"), F.lit(None).cast("double")).alias("none")).collect()
    assert [tuple(m) for m in rows[0].malts] == [("Pale Malt", 9.0, "base", 90.0), ("Black Malt", 1.0, "roasted", 10.0)]
    assert rows[0].dark == 10 and rows[0].dose == 2.5 and rows[0].none is None and rows[1].dose == 0


def test_names(spark):
    assert one(spark, brewing.malt_key(F.lit("Weyermann Carafa Special Malt Type 1")))[0] == "carafa special 1"
    assert one(spark, brewing.examples(F.lit("Germany - Alpha Pils; Beta, C, Gamma Beer")))[0] == ["Alpha Pils", "Beta", "Gamma Beer"]


def test_aroma(spark):
    found = domain.descriptors(F.lit("citrus and pine"), F.lit("citrus"), F.lit(None).cast("string"))
    target, notes = brewing.style_aroma(found), brewing.hop_aroma(F.lit(None).cast("array<double>"), F.array(F.lit("Lemon"), F.lit("pine resin")))
    r = one(spark, target, notes, brewing.style_aroma(domain.descriptors(F.lit("plain"), F.lit(""), F.lit(""))))
    assert r[0][:2] == [pytest.approx(2 / 3), pytest.approx(1 / 3)] and r[1][:2] == [0.5, 0.5] and r[2] is None
    tags = F.array(F.lit("north-america"), F.lit("craft-style"))
    t = one(spark, *[brewing.tradition(tags, F.lit(c)) for c in ("USA", "New Zealand", "Germany")], brewing.tradition(F.array().cast("array<string>"), F.lit("USA")))
    assert list(t) == [1.0, 0.85, 0.15, 0.5]


def test_oil_profiles_undo_a_shift(spark):
    rec = lambda **k: F.struct(*[F.lit(k.get(f)).cast("string").alias(f) for f in ("myrcene", "humulene", "caryophyllene", "farnesene", "geraniol", "linalool", "oils")])
    shifted = rec(caryophyllene="60 - 70%", humulene="7-9", geraniol="0-1", farnesene="0.2", myrcene="0.5")
    r = one(spark, brewing.oil_profile(shifted, rec(), rec(oils="2.0", humulene="0.3")).alias("o")).o
    assert (r.myrcene.lo, r.myrcene.hi) == (60, 70) and r.caryophyllene.hi == 9 and r.linalool.hi == 0.5 and (r.humulene.lo, r.humulene.hi) == (12.8, 17.3)


def test_import_json(spark):
    good = '{"recipe": {"name": "A", "og": 1.05, "fg": "1.01", "estimatedIbu": 30, "ebc": 19.7, "yeasts": [{"name": "Y", "type": "Ale"}], "fermentables": [{"name": "Pale", "amount": 4.5}, {"name": "Black", "amount": 0.5}], "hops": [{"name": "H", "amount": 10, "use": "Boil", "time": 60}, {"name": "D", "amount": 5, "use": "Dry Hop"}]}}'
    rows, bad = brewing.import_json(spark.createDataFrame([(1, good), (2, '{"name": "x"}'), (3, "no")], "id int, content string"), "content")
    r = rows.collect()
    assert len(r) == 1 and sorted(x.id for x in bad.collect()) == [2, 3]
    assert r[0].vitals.srm == pytest.approx(10) and r[0].vitals.abv == pytest.approx(5.25) and r[0].fermentables[0].pct == 90 and [h.stage for h in r[0].hop_schedule] == ["bittering", "dry"] and "top-fermented" in r[0].tags


def test_corpus_steps(spark):
    df = spark.createDataFrame([("a", None, 0, "x"), ("a", 1, 1, None), ("b", None, 2, None)], "k string, aroma int, pos int, extra string")
    assert {r.k: r.pos for r in corpus.fullest(df, "k", F.col("aroma").isNotNull(), "pos").collect()} == {"a": 1, "b": 2}
    merged = corpus.merge_sources(df.select("k").distinct(), [("s", spark.createDataFrame([("a", 7)], "k string, v int"))], "k")
    assert {r.k: r.s and r.s.v for r in merged.collect()} == {"a": 7, "b": None}
    hops = spark.createDataFrame([(1, "Citra", ["mosaic", "Nope"]), (2, "Mosaic", ["CITRA"])], "id int, name string, subs array<string>")
    assert [tuple(r) for r in corpus.substitute_edges(hops, "id", "name", "subs").collect()] == [(1, 2)]
    assert corpus.duplicate_ids(df.withColumn("g", F.lit(1)), "g", "k").first().k == "a"
    assert corpus.nearest_blend(0.25) == 0.5 and corpus.nearest_blend(0.9) == 1.0
    m = spark.createDataFrame([(1, 5.0, 5.01), (2, 5.0, 5.06), (3, None, 1.0)], "id int, abv_a double, abv_b double")
    assert [r.id for r in corpus.drifted(m, ["abv"]).collect()] == [2]


def test_recipe_projections(spark):
    rng = np.random.default_rng(1)
    rows = [(i, tuple(float(x) for x in (1.04 + 0.03 * rng.random(), 1.01, 4 + 3 * rng.random(), 50 * rng.random(), 30 * rng.random())), [("base", 90.0), ("roasted", 10.0 * (i % 2))], [("K", "h%d" % (i % 3))]) for i in range(40)]
    rows.append((99, (1.05, None, 5.0, 5.0, 5.0), [], []))
    df = spark.createDataFrame(rows, "id int, vitals struct<og:double,fg:double,abv:double,ibu:double,srm:double>, malts array<struct<class:string,pct:double>>, hops array<struct<name:string,key:string>>")
    features, keys = corpus.recipe_rows(df, ["base", "roasted"])
    assert features.count() == 40 and keys == ["h0", "h1", "h2"] and len(features.columns) == 1 + 7 + 2 + 3
    v = np.array([r.vector for r in corpus.blended(features, 0.0).collect()])
    assert not v[:, 7:].any() and np.abs(v.mean(0)).max() < 1e-9
    got = corpus.projections(features).collect()
    assert len(got) == 120 and {r.blend for r in got} == {0.0, 0.5, 1.0}
    assert 0.9 < np.quantile([max(abs(r.x), abs(r.y), abs(r.z)) for r in got if r.blend == 0.5], 0.96) <= 1.01
