"""Views of styles and recipes, records of rows, and lookups by name."""

import pytest
from pyspark.sql import functions as F

from graindex.operators import rollups, views
from graindex.sources import documents

RANGE = "struct<lo:double,hi:double>"
STATS = "id string, stats struct<" + ", ".join(f"{v}:{RANGE}" for v in views.VITALS) + ">"


def style(key, **ranges):
    base = {"og": (1.04, 1.06), "fg": (1.01, 1.02), "abv": (4.0, 6.0), "ibu": (20.0, 40.0), "srm": (10.0, 20.0)}
    return (key, tuple((base | ranges)[v] for v in views.VITALS))


def test_middles_ladder_and_chart(spark):
    rows = [style("a"), style("b", srm=(40.0, 60.0)), style("c", fg=None), style("d", abv=(None, 5.0)), style("e", og=(0.99, 1.01), srm=(10.0, 20.0)), ("f", None)]
    df = spark.createDataFrame(rows, STATS)
    got = {r.id: (r.has, r.m) for r in df.select("id", views.has_stats("stats").alias("has"), views.middle_vitals("stats").alias("m")).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": True, "b": True, "c": False, "d": False, "e": True, "f": False}
    assert got["c"][1] is None and got["a"][1].og == pytest.approx(1.05) and got["a"][1].ibu == 30
    assert [tuple(r) for r in views.colour_ladder(df, "stats", "id").collect()] == [("a", 10.0, 15.0, 20.0), ("e", 10.0, 15.0, 20.0), ("b", 40.0, 45.0, 45.0)]
    chart = {r.id: r.attenuation for r in views.fermentability(df, "stats", "id").collect()}
    assert chart["a"] == pytest.approx(70.0) and chart["e"] == 55.0


def test_later_entries_of_an_index_win(spark):
    hops = spark.createDataFrame([(0, "Cascade", "cascade"), (1, "US Cascade", "cascade-us"), (2, "Kent Golding", "east-kent-golding"), (3, "East Kent Goldings", "ekg")], "pos long, name string, key string")
    index = views.name_index(hops, "name", "key", "pos")
    assert {r.wanted: r.key for r in index.collect()} == {"cascade": "cascade-us", "cascade us": "cascade-us", "east kent golding": "ekg", "ekg": "ekg"}
    lines = spark.createDataFrame([(1, "Cascade (pellets)"), (2, "EKG"), (3, "coffee"), (4, None)], "id int, hop string")
    assert {r.id: r.hop_key for r in views.hop_keys(lines, "hop", index).collect()} == {1: "cascade-us", 2: "ekg", 3: None, 4: None}


def test_records_of_rows(spark):
    rows = spark.createDataFrame([(1, None, "S1", None, None, 5.0, None), (2, "x", "", "n", 2010, None, "z")], "id long, name string, style_code string, style_name string, year int, batch_l double, tagline string")
    for c in (*views.VITALS, "attenuation", "hop_dose", "roast"):
        rows = rows.withColumn(c, F.lit(1.0))
    rows = rows.withColumns({"family": F.lit("ipa"), "origin": F.lit("o"), "yeast": F.lit(None).cast("string")})
    whole = views.row_records(rows).orderBy("id").collect()
    assert whole[0].styleGuess.asDict() == {"code": "S1", "name": "", "inRange": 0} and whole[1].styleGuess is None and whole[0].malts == [] and whole[0].tagline == ""
    assert views.point_records(rows).first().vitals.og is None
    malts, hops = F.array(F.struct(F.lit("m").alias("name"), F.lit(9.0).alias("pct"), F.lit("base").alias("class"))), F.array(F.struct(F.lit("h").alias("name"), F.lit("k").alias("key"), F.lit(2.0).alias("g"), F.lit(None).cast("string").alias("stage")))
    one = views.detail_records(rows.withColumns({"malts": malts, "hops": hops})).orderBy("id").first()
    assert (one.name, one.tagline, one.malts[0].kg, one.hops[0].stage) == ("", "", 0.0, "late")


def test_links_of_several_pages(spark):
    link = lambda k, s: f'<a href="/view/{k}/{s}">x</a>'
    df = spark.createDataFrame([(1, link("p1", "a") + link("p2", "b")), (2, link("p1", "c")), (3, None)], "page int, html string")
    got = {r.id: (r.page, r.pos, r.slug) for r in documents.listing_links(df, "html", r"/view/(p[0-9]+)/([a-z])", "page").collect()}
    assert got == {"p1": (1, 0, "c"), "p2": (1, 1, "b")}


def test_weighted_values_at_a_place(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 1), ("a", None, 9), ("b", -2.0, 1), ("b", 0.0, 1), ("b", 7.0, 5)], "k string, v double, n long")
    assert {r.k: r.v for r in rollups.at_place(df, ["k"], "v", lambda n: F.floor(n / 2), "n").collect()} == {"a": 1.0, "b": 7.0}
