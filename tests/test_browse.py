"""Sources, shapes and functions of the explorer: exact expectations on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from graindex.functions import brewing, domain, text, units
from graindex.operators import browse, corpus
from graindex.sources import documents, paged
from graindex.streaming import incremental

PAGE = """<html><head><title>Fine Ale - Beer Recipe - Site</title>
<script type="application/ld+json">[{"@type": "Person", "name": "x"}, {"@type": ["Thing", "Recipe"], "name": "Ale", "recipeCategory": "Best Bitter"}]</script>
<script type="application/ld+json">{broken</script></head><body>Style: Other Batch Size: 5 gallons Yeast: US-05 Fermentis  Starter no
<a href="/x/beerxml1.0/12">xml</a></body></html>"""
XML = "<RECIPES><RECIPE><NAME>One</NAME><BATCH_SIZE>20</BATCH_SIZE>{}<IBU>30</IBU></RECIPE></RECIPES>"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_json_ld_looks_at_all_objects(spark):
    pages = spark.createDataFrame([("u", PAGE), ("v", "<p>none</p>")], "url string, html string")
    got = {r.url: r for r in documents.parse_recipe_page(pages, "url", "html").collect()}
    assert (got["u"].name, got["u"].style, got["u"].yeast, got["u"].batchL) == ("Ale", "Best Bitter", "US-05 Fermentis", 18.9) and got["v"].name is None
    assert one(spark, text.export_link(F.lit(PAGE), F.lit("7"), "http://s", "beerxml")) == "http://s/x/beerxml1.0/12"
    assert one(spark, text.export_link(F.lit("<p>"), F.lit("7"), "http://s", "beerxml")) == "http://s/homebrew/recipe/beerxml1.0/7"
    assert one(spark, text.export_link(F.lit("<p>"), F.lit(None).cast("string"), "http://s", "beerxml")) is None


def test_xml_without_a_number_is_rejected(spark):
    full = XML.format("<OG>1.056 SG</OG><FG>1.012 SG</FG><COLOR>9</COLOR>")
    docs = spark.createDataFrame([(1, full), (2, XML.format("<OG>1.05</OG>")), (3, "nonsense")], "n int, xml string")
    good, bad = documents.import_xml(docs, "xml")
    r = good.first()
    assert r.n == 1 and r.vitals.og == 1.056 and r.vitals.abv == pytest.approx(0.044 * 131.25) and sorted(x.n for x in bad.collect()) == [2, 3]


def test_json_sinks_and_views(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i == 2 else f"n{i}") for i in range(5)], "id int, name string")
    documents.write_json({"t": df}, str(tmp_path))
    assert spark.read.schema("id int, name string").json(str(tmp_path / "t")).count() == 5
    (tmp_path / "array.json").write_text('[\n{"id": 1, "name": "a"},\n{"id": 2}]')
    assert sorted(tuple(r) for r in documents.read_array(spark, str(tmp_path / "array.json"), None, "id int, name string").collect()) == [(1, "a"), (2, None)]
    documents.export_views({"v": (df, [F.desc("id")], 3)}, str(tmp_path))
    files = list((tmp_path / "v").glob("*.json"))
    assert [json.loads(x)["id"] for x in files[0].read_text().splitlines()] == [4, 3, 2] and len(files) == 1
    assert {"id": 2, "name": None} in [json.loads(x) for x in files[0].read_text().splitlines()]  # nulls are written


def test_pages_of_a_service(spark):
    def service(first, n):
        def fetch(cursor, size):
            at = 0 if cursor is None else cursor
            return [((first + i, f"r{first + i}"), i + 1) for i in range(at, min(n, at + size))]

        return fetch

    got = paged.read_pages(spark, "service_test", [service(0, 120), service(1000, 50), service(2000, 0)], "id int, name string", 50)
    assert sorted(r.id for r in got.collect()) == [*range(120), *range(1000, 1050)]


def test_replay_of_a_cache(spark, tmp_path):
    for name, content in (("1.xml", "xml one"), ("1.html", "page one"), ("2.html", "page two")):
        (tmp_path / name).write_text(content)
    parse = lambda rows, content: rows.select("id", F.col(content).alias("v"))
    existing = spark.createDataFrame([("2", "old"), ("3", "old")], "id string, v string")
    got = incremental.replay(spark, existing, str(tmp_path), parse, parse)
    assert sorted(tuple(r) for r in got.collect()) == [("1", "xml one"), ("2", "page two"), ("3", "old")]


def test_projection_parameters(spark):
    points = spark.createDataFrame([(i, "pca", b, float(i)) for i in range(20) for b in (0.0, 0.5, 1.0)], "id int, method string, blend double, x double")
    details = spark.createDataFrame([(i, f"n{i}") for i in range(15)], "id int, name string")
    n = lambda **k: browse.projection_page(points, details, "id", **k).count()
    assert (n(), n(blend="1"), n(blend=0.3, limit=0), n(method="umap"), n(limit="4"), n(limit=-3)) == (15, 15, 15, 0, 4, 1)
    assert [r.id for r in browse.aligned(points.withColumn("pos", -F.col("id")), details, "id", "pos", 0.75).collect()] == list(range(14, -1, -1))


def test_details_and_orders(spark):
    recipes = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    malts = spark.createDataFrame([(1, "x", 20.0), (1, "y", 80.0)], "recipe_id int, malt string, pct double")
    got = browse.detail(recipes, "id", 1, {"malts": (malts, "recipe_id", "pct", "malt")}).first()
    assert [m.malt for m in got.malts] == ["y", "x"] and browse.detail(recipes, "id", 2, {"malts": (malts, "recipe_id", "pct", "malt")}).first().malts == []
    assert browse.detail(recipes, "id", 9, {"malts": (malts, "recipe_id", "pct", "malt")}).count() == 0
    ids = spark.createDataFrame([(x,) for x in ("10A", "2B", "T1", "2a", "21")], "id string")
    assert [r.id for r in ids.orderBy(*browse.id_order("id")).collect()] == ["2a", "2B", "10A", "21", "T1"]
    names = spark.createDataFrame([(x,) for x in ("Zed", "Élan", "elan", "Apple", "elf")], "n string")
    assert [r.n for r in names.orderBy(*browse.name_order("n")).collect()] == ["Apple", "elan", "Élan", "elf", "Zed"]


def test_slim_recipes_and_scatter_points(spark):
    rows = [(1, (1.05, 1.01, 5.0, 30.0, 90.0), 20.0, [("m", 1.0, "roasted", 10.0)], [("h", "k", 40.0, "late", "5")], "prose"), (2, (1.05, 1.01, 5.0, None, None), None, [], [], "prose")]
    df = spark.createDataFrame(rows, f"id int, vitals {documents.VITALS}, batchL double, malts array<struct<name:string,kg:double,class:string,pct:double>>, hops array<struct<name:string,key:string,g:double,stage:string,timeMin:string>>, description string")
    slim = corpus.slim(df)
    r = slim.orderBy("id").first()
    assert "description" not in slim.columns and (r.hop_dose, r.roast) == (2.0, 10.0) and r.malts[0].asDict() == {"name": "m", "pct": 10.0, "class": "roasted"} and "timeMin" not in r.hops[0].asDict()
    assert [tuple(x) for x in corpus.scatter_points(slim, "hops").collect()] == [(1, 2.0, 30.0)] and [tuple(x) for x in corpus.scatter_points(slim, "roast").collect()] == [(1, 10.0, 80.0)]


def test_manual_entries(spark):
    entries = spark.createDataFrame([("", "1.05", "1.01", "", "30", "8"), ("x", "1.05", "?", "5", "30", "8")], "name string, og string, fg string, abv string, ibu string, srm string")
    good, bad = corpus.manual_recipe(entries)
    r = good.first()
    assert r.name == "My recipe" and r.vitals.abv == pytest.approx(5.25) and "pale-color" in r.tags and bad.count() == 1


def test_guides_share_a_space(spark):
    schema = "id string, og double, abv double, tags array<string>"
    a = spark.createDataFrame([("a", 1.04, 4.0, ["p", "h"]), ("b", 1.05, 5.0, ["p"]), ("n", None, 5.0, ["p"])], schema)
    b = spark.createDataFrame([("c", 1.09, 9.0, ["d", "h"]), ("d", 1.10, 10.0, ["d"])], schema)
    got = corpus.shared_projection(a, b, ("A", "B"), ["og", "abv"], "tags").collect()
    x = {r.id: r.x for r in got}
    assert set(x) == set("abcd") and (x["a"] - x["c"]) * (x["b"] - x["d"]) > 0 and sum(x.values()) == pytest.approx(0, abs=1e-9)
    cube = corpus.unit_cube(spark.createDataFrame([([1.0, -4.0],), ([0.5, 2.0],)], "p array<double>"), "p")
    assert sorted(r.p for r in cube.collect()) == [[pytest.approx(0.14375), pytest.approx(0.575)], [pytest.approx(0.2875), pytest.approx(-1.15)]]


def test_repeated_ids_stop_a_build(spark):
    good = spark.createDataFrame([("g", "1"), ("g", "2")], "guide string, id string")
    assert corpus.assert_unique(good, "guide", "id") is good
    with pytest.raises(ValueError, match="g has 2 2 times"):
        corpus.assert_unique(good.union(spark.createDataFrame([("g", "2")], good.schema)), "guide", "id")


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: domain.producer_name(F.lit("HBC 123™")), "hbc123"),
        (lambda: domain.producer_name(F.lit("Hallertau Mittelfrueh")), "hallertauer mittelfruh"),
        (lambda: domain.yeast_key(F.lit("Wyeast WLP 001 California!")), "wlp001"),
        (lambda: domain.yeast_key(F.lit("- -")), None),
        (lambda: domain.fermentation(F.array(F.lit("top-fermented")), F.lit("Bock"), F.lit("x")), "Ale"),
        (lambda: domain.fermentation(F.expr("cast(array() as array<string>)"), F.lit("Märzen"), F.lit("x")), "Lager"),
        (lambda: domain.fermentation(F.expr("cast(array() as array<string>)"), F.lit("Mead"), F.lit("x")), "Any yeast / specialty"),
        (lambda: text.last_year(F.lit("09/2010")), 2010),
        (lambda: text.last_year(F.lit("soon")), None),
        (lambda: text.file_name(F.lit(" My Recipe: #2! ")), "my-recipe-2"),
        (lambda: units.difference(F.lit(5.0), F.lit(4.7)), "-0.3"),
        (lambda: units.difference(F.lit(5.0), F.lit(5.04)), "="),
        (lambda: units.difference(F.lit(5.0), F.lit(None).cast("double")), "—"),
        (lambda: units.strength_colour(F.lit(4.0), F.lit(4.0), F.lit(9.0)), "#f2d98c"),
        (lambda: units.similarity_colour(F.lit(2.0)), "#3987e5"),
        (lambda: brewing.cohumulone(F.lit(0.0), F.lit(None).cast("double"), F.lit("Non"), F.lit("20 - 25"))["hi"], 25.0),
        (lambda: brewing.cohumulone(F.lit(18.0), F.lit(22.0), F.lit("1"))["lo"], 18.0),
    ],
)
def test_functions(spark, column, want):
    assert one(spark, column()) == want
