"""Text rules, units, parsers and matching on small fixtures."""

import pytest
from pyspark.sql import functions as F

from graindex.functions import domain, text, units
from graindex.operators import matching, relational, rollups
from graindex.sources import documents


def values(spark, rows, f, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).coalesce(1).select(f).collect()]


def test_units_in_text(spark):
    assert values(spark, ["10 lb", "2.5 kg", "16 oz", "1,000 g", "none"], F.round(text.in_unit(F.col("x"), text.KILOGRAMS, "kg"), 3)) == [4.536, 2.5, 0.454, 1.0, None]
    assert values(spark, ["0.5 oz", "28 g"], F.round(text.in_unit(F.col("x"), text.GRAMS, "g"), 1)) == [14.2, 28.0]
    assert values(spark, ["5.5 gallons", "19 L"], F.round(text.in_unit(F.col("x"), text.LITRES, "l"), 1)) == [20.8, 19.0]


def test_number_ranges(spark):
    got = values(spark, ["39 - 48%", "1,0 - 1,7", "68 -70", "Non", "<1%", "9 - 4"], text.number_range(F.col("x")))
    assert [tuple(r) if r else None for r in got] == [(39, 48), (1.0, 1.7), (68, 70), None, (1, 1), (4, 9)]


def test_stages_and_classes(spark):
    assert values(spark, ["90", "15 min", "Dry Hop, at Day 6", "first wort", "whirlpool", "boil", "boil 60", None, "start"], domain.stage(F.col("x"))) == ["bittering", "late", "dry", "bittering", "late", "bittering", "bittering", "late", "bittering"]
    assert values(spark, ["Chocolate Wheat", "Caramalt", "Flaked Oats", "Cane sugar", "Rauchmalz", "Maris Otter", "Rice hulls"], domain.malt_class(F.col("x"))) == ["roasted", "crystal & caramel", "wheat, oats & rye", "sugars & adjuncts", "smoked", "base", "other"]
    rows = [("x", "Imperial Stout"), ("Pale Ale", "Stout"), (None, ""), ("Märzen", "a lager")]
    assert values(spark, rows, domain.family(F.col("a"), F.col("b")), "a string, b string") == ["stout", "pale ale", "other", "lager & pilsner"]


def test_hop_names(spark):
    got = values(spark, ["Columbus", "Citra 11 AA", "Saaz (Czech) pellets", "Czech Saaz", "German Cascade", "Hallertauer Mittelfrüh", "US Goldings"], domain.hop_name(F.col("x")))
    assert got == ["ctz", "citra", "saaz", "saaz", "cascade", "hallertauer mittelfruh", "goldings"]


def test_style_names(spark):
    assert values(spark, ["11B Best Bitter", "American-Style India Pale Ale"], domain.style_name(F.col("x"))) == ["best bitter", "american style ipa"]
    got = values(spark, ["Special Bitter or Best Bitter", "Golden or Blonde Ale", "Imperial or Double India Pale Ale"], domain.alternative_names(F.col("x")))
    assert {"special bitter", "best bitter"} <= set(got[0]) and "golden ale" in got[1] and "double ipa" in got[2] and got[2][0] == "imperial or double ipa"


def test_descriptors(spark):
    rows = [("Rich caramel and toffee with orange.", "Caramel, creamy; finishes dry.", None), (None, None, None)]
    got = spark.createDataFrame(rows, "a string, b string, c string").coalesce(1).select(domain.descriptors(F.col("a"), F.col("b"), F.col("c")).alias("d")).collect()
    found = {d.name: (d.family, d.strength) for d in got[0].d}
    assert found["caramel"] == ("malt", 2) and found["citrus"] == ("hops", 1) and {"dry finish", "creamy"} <= set(found) and "banana" not in found and got[1].d == []


def test_gravity_and_colour(spark):
    assert values(spark, [1056.0, 1.056, 3.0, None], units.gravity(F.col("x")), "x double") == [1.056, 1.056, None, None]
    assert values(spark, [1.0, 2.5, 40.0, 99.0, 0.0, None], units.colour_hex(F.col("x")), "x double") == ["#ffe699", "#ffd169", "#36080a", "#36080a", "#ffe699", None]
    r = spark.range(1).select(units.attenuation(F.lit(1.05), F.lit(1.01)), units.attenuation(F.lit(1.0), F.lit(1.0)), F.round(units.alcohol(F.lit(1.065), F.lit(1.014)), 1)).first()
    assert r[0] == pytest.approx(80) and r[1] is None and r[2] == 6.7


def test_names_match_one_to_one(spark):
    a = ["11B Best Bitter", "22A Double IPA", "Witbier", "International Pale Lager", "Strong"]
    b = ["Special Bitter or Best Bitter", "Imperial or Double India Pale Ale", "Belgian-Style Witbier", "International-Style Pale Ale", "Strong Things Here"]
    left, right = (spark.createDataFrame([(x, x, i) for i, x in enumerate(n)], "id string, name string, pos int") for n in (a, b))
    got = {r.a_id: (r.b_id, r.fuzzy) for r in matching.match_names(left, right).collect()}
    assert got == {"11B Best Bitter": (b[0], False), "22A Double IPA": (b[1], False), "Witbier": (b[2], True)}


def test_pairing_prefers_the_aroma_asked_for(spark):
    score = lambda target, profile, home, alpha, cohu, ibu: matching.pairing_score(F.lit(None).cast("array<double>") if target is None else F.array(*map(F.lit, target)), F.array(*map(F.lit, profile)), F.lit(home), F.lit(alpha), F.lit(cohu), F.lit(ibu))
    r = spark.range(1).select(score([1.0, 0.0], [0.9, 0.1], 0.85, 12.0, 22.0, 60.0), score([1.0, 0.0], [0.1, 0.9], 0.15, 3.5, 26.0, 60.0), score(None, [1.0, 0.0], 0.5, 5.0, 20.0, 25.0)).first()
    assert 1 >= r[0] > r[1] >= 0 and r[2] == pytest.approx(0.82 * (0.55 * 0.5 + 0.45 * 1.0))


PAGE = """<html><head><title>Test Ale - Beer Recipe | A Site</title><script type="application/ld+json">{"@type": ["Thing", "Recipe"], "name": "LD Ale"}</script></head>
<body><a href="/recipe/view/999123/test-ale">x</a> Batch Size: 5.5 gallons <b>All Grain</b> Original Gravity: 1.065 Final Gravity: 1.014 ABV: 6.7% IBU: 42.3 SRM: 4.9
<table><tr><th>Amount</th><th>Fermentable</th><th>PPG</th></tr><tr><td>10 lb</td><td>Pale Malt (US)</td><td>37</td></tr><tr><td>1 kg</td><td>Wheat &amp; Rye</td><td>35</td></tr><tr><td>11 lb</td><td>Total</td></tr></table>
<table><tr><th>Amount</th><th>Variety</th><th>Use</th><th>Time</th></tr><tr><td>1 oz</td><td>Magnum</td><td>Boil</td><td>60 min</td></tr><tr><td>28 g</td><td>Citra</td><td>Boil</td><td>5 min</td></tr><tr><td>2 oz</td><td>Mosaic</td><td>Dry Hop</td><td>3 days</td></tr></table></body></html>"""


def test_recipe_page(spark):
    pages = spark.createDataFrame([("http://x/view/7/a", PAGE)], "url string, html string")
    r = documents.parse_recipe_page(pages, "url", "html").first()
    assert (r.id, r.name, r.method, r.batchL) == ("7", "LD Ale", "All Grain", 20.8)
    assert tuple(r.vitals) == (1.065, 1.014, 6.7, 42.3, 4.9)
    assert [tuple(m) for m in r.malts] == [("Pale Malt", 4.536), ("Wheat & Rye", 1.0)]
    assert [(h.name, h.g, h.stage) for h in r.hops] == [("Magnum", 28.3, "bittering"), ("Citra", 28.0, "late"), ("Mosaic", 56.7, "dry")]


def test_listing(spark):
    html = '<a href="/recipe/view/2/old">a</a><a href="/recipe/view/1/b">b</a><a href="/recipe/view/2/new">c</a>'
    got = documents.listing_links(spark.createDataFrame([(html,)], "html string"), "html", r"/view/(\d+)/([a-z0-9_-]+)").orderBy("pos").collect()
    assert [(r.id, r.slug) for r in got] == [("2", "new"), ("1", "b")]


XML = """<RECIPES><RECIPE><NAME>X Ale</NAME><TYPE>All Grain</TYPE><STYLE><NAME>Pale</NAME></STYLE><BATCH_SIZE>20.8</BATCH_SIZE><OG>1.065 SG</OG><EST_FG>1.014</EST_FG><IBU>40</IBU>
<FERMENTABLES><FERMENTABLE><NAME>Pale</NAME><AMOUNT>4.536</AMOUNT></FERMENTABLE></FERMENTABLES>
<HOPS><HOP><NAME>A</NAME><AMOUNT>0.028</AMOUNT><USE>Boil</USE><TIME>60</TIME></HOP><HOP><NAME>B</NAME><AMOUNT>0.03</AMOUNT><USE>Aroma</USE><TIME>5</TIME></HOP><HOP><NAME>C</NAME><AMOUNT>0.05</AMOUNT><USE>Dry Hop</USE><TIME>0</TIME></HOP></HOPS></RECIPE></RECIPES>"""


def test_recipe_xml(spark):
    r = documents.parse_recipe_xml(spark.createDataFrame([("u", XML), ("v", "{}")], "url string, xml string"), "xml").collect()
    assert len(r) == 1 and r[0].name == "X Ale" and r[0].vitals.og == 1.065 and r[0].vitals.fg == 1.014 and r[0].batchL == 20.8 and r[0].malts[0].kg == 4.536
    assert [(h.name, h.g, h.stage) for h in r[0].hops] == [("A", 28.0, "bittering"), ("B", 30.0, "late"), ("C", 50.0, "dry")]


def test_star_schema_and_lines(spark, tmp_path):
    good = '{"id": 1, "name": "A", "year": "x", "malts": [{"name": "Pale ", "kg": 1, "class": "base", "pct": 100}], "hops": [{"name": " Coffee", "key": "", "g": 3}]}'
    (tmp_path / "r.jsonl").write_text(good + '\n{"id": 2, "name": "B", "malts": []}\nnot json\n{"id": 3, "malts": [{"name": "x"}]}\n')
    rows, bad = documents.read_lines(spark, str(tmp_path / "r.jsonl"), documents.RECIPE, ["name", "malts"])
    assert [r.id for r in rows.collect()] == [1] and bad.count() == 3
    star = documents.star_schema(rows)
    assert star["recipes"].first().year is None and star["recipe_hops"].first().hop_key == "coffee" and star["malts"].first().malt_key == "pale"
    (tmp_path / "d.json").write_text('{"source": "s", "recipes": [\n' + good + "\n]}")
    assert documents.read_array(spark, str(tmp_path / "d.json"), "recipes", documents.RECIPE).first().id == 1
    documents.write_tables(star, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/recipes")).count() == 1


def test_parameters():
    assert relational.clamp_int("0", 100, 60000) == 100 and relational.clamp_int(-4, 100, 60000) == 1 and relational.clamp_int("70000", 100, 60000) == 60000 and relational.clamp_int(None, 7, 9) == 7
    assert relational.number("nan") is None and relational.number("x") is None and relational.number("1.5") == 1.5


def test_page_puts_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 7.0), (4, 5.0)], "id int, v double")
    assert [r.id for r in relational.page(df, "v", True, "id").collect()] == [3, 2, 4, 1] and [r.id for r in relational.page(df, "v", False, "id").collect()] == [2, 4, 3, 1]


def test_best_fit_passes_over_missing_axes(spark):
    items = spark.createDataFrame([(1, 5.0, None), (2, None, None), (3, 5.0, 5.0)], "id int, a double, b double")
    boxes = spark.createDataFrame([("x", 0.0, 10.0, 4.0, 6.0), ("y", 4.0, 7.0, None, None)], "name string, a_lo double, a_hi double, b_lo double, b_hi double")
    assert {r.id: (r.name, r.inside) for r in relational.best_fit(items, "id", boxes, ["a", "b"], "name").collect()} == {1: ("x", 1), 2: (None, None), 3: ("x", 2)}


def test_empty_histogram_is_50(spark):
    df = spark.createDataFrame([], "v double")
    assert rollups.percentile_of(rollups.histogram(df, "v", 0.0, 1.0, 0.1), 0.3, 0.0, 0.1).first()[0] == 50
