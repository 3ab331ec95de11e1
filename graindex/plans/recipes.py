"""The recipe domain over made-up records: every part is a malt, hop, style or page whose fields follow from its numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import brewing, domain, text, units
from ..operators import corpus, features, matching
from ..operators import relational as R
from ..operators.steps import dealt
from ..sources import documents
from ..streaming import incremental
from .tables import Registry, table
from .texts import new_folder

REGISTRY = Registry()
query = REGISTRY.add


def _size() -> Column:
    return F.col("p_size")


def _key() -> Column:
    return F.col("p_partkey")


def _text(x: Column | int) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("string")


def _pick(key: Column, words: list[str]) -> Column:
    """A word by number, as list_value(...)[key % n + 1] in SQL."""
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(key, F.lit(len(words))) + 1).cast("int"))


def _sql_pick(key: str, words: list[str]) -> str:
    listed = ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    return f"(list_value({listed}))[({key}) % {len(words)} + 1]"


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part")


def _dealt_parts(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(_parts(spark, sf))


@query("""WITH v AS (SELECT p_partkey, p_size * 50.0 AS raw, CASE WHEN p_size % 3 = 0 THEN 1.0 ELSE 1 + p_size / 500.0 END AS og, 1 + p_size / 2000.0 AS fg FROM part), g AS (SELECT *, CASE WHEN raw > 100 THEN raw / 1000 ELSE raw END AS s FROM v)
  SELECT p_partkey, round((CASE WHEN s <= 2 THEN s END)::DOUBLE, 9) AS gravity, round((CASE WHEN og > 1 THEN (og - fg) / (og - 1) * 100 END)::DOUBLE, 6) AS attenuation, round(((og - fg) * 131.25)::DOUBLE, 6) AS abv,
    round((raw / 1.97)::DOUBLE, 6) AS from_ebc, round((raw * 1.3546 - 0.76)::DOUBLE, 6) AS from_lovibond, round(((raw - 32) * 5 / 9)::DOUBLE, 6) AS celsius FROM g""")
def gravity_units(spark: SparkSession, sf: str) -> DataFrame:
    raw, og, fg = _size() * 50.0, F.when(_size() % 3 == 0, 1.0).otherwise(1 + _size() / 500.0), 1 + _size() / 2000.0
    return _dealt_parts(spark, sf).select(
        "p_partkey", F.round(units.gravity(raw), 9).alias("gravity"), F.round(units.attenuation(og, fg), 6).alias("attenuation"), F.round(units.alcohol(og, fg), 6).alias("abv"),
        F.round(units.srm_from_ebc(raw), 6).alias("from_ebc"), F.round(units.srm_from_lovibond(raw), 6).alias("from_lovibond"), F.round(units.celsius(raw), 6).alias("celsius"),
    )


ADDITIONS = ["Dry Hop", "start", "First Wort", "flame out", "Whirlpool", "boil 60", "45 min", "10", "Boil", "FV", "odd", "hopstand"]
STAGES = ["dry", "bittering", "bittering", "late", "late", "bittering", "bittering", "late", "bittering", "dry", "late", "late"]


@query(f"SELECT p_partkey, {_sql_pick('p_partkey', STAGES)} AS stage FROM part")
def hop_stages(spark: SparkSession, sf: str) -> DataFrame:
    return _dealt_parts(spark, sf).select("p_partkey", domain.stage(_pick(_key(), ADDITIONS)).alias("stage"))


HOPS = ["East Kent Goldings", "Columbus (US) Pellets", "German Tettnang", "Saaz 3.5% AA", "Citra® Cryo", "US Cascade", "H. Blanc", "Nelson"]
HOP_NAMES = ["east kent golding", "ctz", "tettnanger", "saaz", "citra", "cascade", "hallertau blanc", "nelson"]


@query(f"SELECT p_partkey, {_sql_pick('p_partkey', HOP_NAMES)} AS hop FROM part")
def hop_names(spark: SparkSession, sf: str) -> DataFrame:
    return _dealt_parts(spark, sf).select("p_partkey", domain.hop_name(_pick(_key(), HOPS)).alias("hop"))


MALTS = ["Weyermann Pale Ale Malt", "Flaked Oats", "Malt Type 2-Row!", "Crystal  60L", "crisp Brown Malt"]
MALT_KEYS = ["pale ale", "flaked oat", "2 row", "crystal 60l", "brown"]


@query(f"SELECT p_partkey, {_sql_pick('p_size', MALT_KEYS)} AS malt FROM part")
def malt_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _dealt_parts(spark, sf).select("p_partkey", brewing.malt_key(_pick(_size(), MALTS)).alias("malt"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || '|' || CASE lower(p_type) WHEN 'economy' THEN 'cheap' ELSE lower(p_type) END ELSE p_name END AS tags,
  CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN p_brand ELSE p_name END AS first FROM part""")
def tag_lists(spark: SparkSession, sf: str) -> DataFrame:
    listed = F.when(_size() % 2 == 0, F.concat_ws(", ", "p_name", "p_type", F.lit(""), F.upper("p_name"))).otherwise(F.concat_ws(",", F.lit(" "), "p_name"))
    first = text.first_text(F.when(_size() % 3 == 1, F.concat(F.lit(" "), "p_brand")), F.when(_size() % 3 == 0, F.lit("  ")), F.when(_size() % 3 == 2, F.col("p_name")))
    return _dealt_parts(spark, sf).select("p_partkey", F.array_join(text.clean_tags(listed, {"economy": "cheap"}), "|").alias("tags"), first.alias("first"))


VITALS_SQL = "v AS (SELECT p_partkey, p_name, 1 + p_size / 500.0 AS og, p_size / 4.0 AS abv, p_partkey % 90 AS ibu, p_size * 0.7 AS srm, CASE p_partkey % 3 WHEN 0 THEN 'Lager' WHEN 1 THEN 'Ale' ELSE 'Brett blend' END AS yeast FROM part)"


@query(f"""WITH {VITALS_SQL}, t AS (SELECT p_partkey, concat_ws(',',
    CASE WHEN abv < 4.3 THEN 'session-strength' WHEN abv < 6.3 THEN 'standard-strength' WHEN abv < 9 THEN 'high-strength' ELSE 'very-high-strength' END,
    CASE WHEN srm < 9 THEN 'pale-color' WHEN srm < 20 THEN 'amber-color' ELSE 'dark-color' END,
    CASE WHEN ibu / ((og - 1) * 1000) >= 0.85 THEN 'hoppy' WHEN ibu / ((og - 1) * 1000) <= 0.45 THEN 'malty' ELSE 'balanced' END,
    CASE yeast WHEN 'Lager' THEN 'bottom-fermented' WHEN 'Ale' THEN 'top-fermented' ELSE 'wild-fermented' END, CASE yeast WHEN 'Lager' THEN 'lagered' END,
    CASE WHEN p_size % 5 = 0 THEN 'stout-family' END) AS tags FROM v JOIN part USING (p_partkey))
  SELECT p_partkey, tags FROM t""")
def style_tags(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(_size() % 5 == 0, "Oat Stout").otherwise("Plain")
    yeast = F.when(_key() % 3 == 0, "Lager").when(_key() % 3 == 1, "Ale").otherwise("Brett blend")
    tags = brewing.derived_tags(name, 1 + _size() / 500.0, _size() / 4.0, _key() % 90, _size() * 0.7, yeast)
    return _dealt_parts(spark, sf).select("p_partkey", F.array_join(tags, ",").alias("tags"))


@query("""WITH p AS (SELECT p_partkey, p_size, CASE WHEN p_size % 4 = 0 THEN 1.0 ELSE 1.04 END AS a, 1.05 + p_size / 1000.0 AS b, CASE WHEN p_size % 5 = 0 THEN 0.095 ELSE 1.008 END AS c, CASE WHEN p_size % 6 = 0 THEN 0 ELSE 4 END AS d, CASE WHEN p_size % 6 = 0 THEN 25 ELSE 5 END AS e, CASE WHEN p_size % 7 = 0 THEN 100 ELSE 40 END AS f FROM part),
  o AS (SELECT *, a > 1.0 AS og, c >= 0.98 AS fg, NOT (d <= 0 AND e >= 20) AS abv FROM p)
  SELECT p_partkey, CASE WHEN og THEN a END::DOUBLE AS og_lo, round((CASE WHEN fg THEN c WHEN og AND abv THEN least(round((a - d / 131.25)::DOUBLE, 3), round((b - e / 131.25)::DOUBLE, 3)) END)::DOUBLE, 3) AS fg_lo,
    CASE WHEN abv THEN e END::DOUBLE AS abv_hi, CASE WHEN f < 95 THEN f END::DOUBLE AS ibu_hi FROM o""")
def sanitised_ranges(spark: SparkSession, sf: str) -> DataFrame:
    box = lambda lo, hi: F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    og = box(F.when(_size() % 4 == 0, 1.0).otherwise(1.04), 1.05 + _size() / 1000.0)
    fg = box(F.when(_size() % 5 == 0, 0.095).otherwise(1.008), F.lit(1.02))
    abv = box(F.when(_size() % 6 == 0, 0).otherwise(4), F.when(_size() % 6 == 0, 25).otherwise(5))
    ibu = box(F.lit(0), F.when(_size() % 7 == 0, 100).otherwise(40))
    got = brewing.sanitised(og, fg, abv, ibu, box(F.lit(2), F.lit(9)))
    return _dealt_parts(spark, sf).select("p_partkey", got["og"]["lo"].alias("og_lo"), F.round(got["fg"]["lo"], 3).alias("fg_lo"), got["abv"]["hi"].alias("abv_hi"), got["ibu"]["hi"].alias("ibu_hi"))


GUIDE_NAMES = ["11B Best Bitter", "American-Style India Pale Ale", "Golden or Blonde Ale", "Münchner Helles", "Barley Wine & Wheatwine", "Gose"]
NORMS = ["best bitter", "american style ipa", "golden or blonde ale", "munchner helles", "barleywine wheatwine", "gose"]
READINGS = ["best bitter", "american style ipa", "golden or blonde ale|golden|golden ale|blonde ale", "munchner helles", "barleywine wheatwine", "gose"]
TOKENS = ["best|bitter", "american|ipa", "golden|blonde", "munich|helles", "barleywine|wheatwine", "gose"]


@query(f"SELECT p_partkey, {_sql_pick('p_size', NORMS)} AS norm, {_sql_pick('p_size', READINGS)} AS readings, {_sql_pick('p_size', TOKENS)} AS tokens FROM part")
def style_names(spark: SparkSession, sf: str) -> DataFrame:
    name = _pick(_size(), GUIDE_NAMES)
    norm = domain.style_name(name)
    return _dealt_parts(spark, sf).select("p_partkey", norm.alias("norm"), F.array_join(domain.alternative_names(name), "|").alias("readings"), F.array_join(domain.name_tokens(norm), "|").alias("tokens"))


@query("""WITH s AS (SELECT l_orderkey, sum(l_quantity) AS t FROM lineitem GROUP BY 1) SELECT l_orderkey, count(*) AS n, round(sum(round(l_quantity / t * 100, 1)), 1) AS pct,
  round(sum(CASE WHEN l_returnflag = 'A' THEN round(l_quantity / t * 100, 1) ELSE 0 END), 1) AS roasted, round(CASE WHEN l_orderkey % 4 > 0 THEN sum(l_quantity) / (l_orderkey % 4) END, 6) AS dose
  FROM lineitem JOIN s USING (l_orderkey) GROUP BY l_orderkey""")
def grist_bills(spark: SparkSession, sf: str) -> DataFrame:
    """Percentages and classes of bills, their roasted share, and a dose over a batch that may be 0."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "A", "Black malt").otherwise("Pale malt").alias("name"), F.col("l_quantity").alias("kg"), F.col("l_quantity").alias("g"))
    bills = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("name", "kg")).alias("malts"), F.collect_list(F.struct("g")).alias("hops")).withColumn("malts", brewing.grist(F.col("malts")))
    total = F.aggregate("malts", F.lit(0.0), lambda s, m: s + m["pct"])
    dose = brewing.hop_dose(F.col("hops"), F.col("l_orderkey") % 4)
    return bills.select("l_orderkey", F.size("malts").cast("long").alias("n"), F.round(total, 1).alias("pct"), F.round(brewing.grist_share(F.col("malts"), "roasted"), 1).alias("roasted"), F.round(dose, 6).alias("dose"))


def _recipes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as recipes: lines with even numbers are malts, the others hops, every third without a key."""
    line = F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").join(_parts(spark, sf), F.col("l_partkey") == _key())
    malt = F.when(line % 2 == 0, F.struct(F.concat(F.lit(" "), F.initcap("p_name")).alias("name"), F.col("l_quantity").alias("kg"), F.lower("p_type").alias("class"), F.col("l_quantity").alias("pct")))
    hop = F.when(line % 2 == 1, F.struct(F.col("p_brand").alias("name"), F.when(F.col("l_partkey") % 3 > 0, F.lower("p_brand")).otherwise("").alias("key"), F.col("l_quantity").alias("g"), F.col("l_returnflag").alias("stage"), F.lit(None).cast("string").alias("timeMin")))
    bills = rows.groupBy("l_orderkey").agg(F.collect_list(malt).alias("malts"), F.collect_list(hop).alias("hops"))
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("family"), "o_totalprice")
    n = F.col("o_orderkey")
    vitals = F.struct((1 + n % 90 / 1000).alias("og"), (1 + n % 20 / 1000).alias("fg"), (n % 12).cast("double").alias("abv"), F.when(n % 5 > 0, n % 70).cast("double").alias("ibu"), (n % 40 + 1).cast("double").alias("srm"))
    return orders.join(bills, n == F.col("l_orderkey")).select(
        n.alias("id"), F.concat(F.lit("r"), _text(n)).alias("name"), "family", F.lit("tpch").alias("origin"), F.when(n % 2 == 0, "2010").otherwise("soon").alias("year"), vitals.alias("vitals"),
        (n % 4).cast("double").alias("batchL"), "malts", "hops", F.lit(None).cast("string").alias("yeast"),
    )


STAR = """l AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, p_name, p_brand, p_type, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query(f"""WITH {STAR}, h AS (SELECT coalesce(nullif(CASE WHEN p_partkey % 3 > 0 THEN lower(p_brand) ELSE '' END, ''), lower(trim(p_brand))) AS k, * FROM l WHERE l_linenumber % 2 = 1)
  SELECT 'hop' AS kind, k AS key, min(p_brand) AS name, count(DISTINCT l_orderkey)::INT AS n_recipes, count(*) AS n_rows FROM h GROUP BY 2
  UNION ALL SELECT 'malt', lower(p_name), min(' ' || (SELECT string_agg(upper(w[1]) || w[2:], ' ') FROM (SELECT unnest(string_split(p_name, ' ')) AS w))), count(DISTINCT l_orderkey)::INT, count(*) FROM l WHERE l_linenumber % 2 = 0 GROUP BY 2""")
def star_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """Malts and hops of the star schema of nested recipes, with the rows of their facts."""
    star = documents.star_schema(_recipes(spark, sf))
    hops = star["hops"].join(star["recipe_hops"].groupBy("hop_key").agg(F.count(F.lit(1)).alias("n_rows")), "hop_key")
    malts = star["malts"].join(star["recipe_malts"].groupBy(F.lower(F.trim("malt_name")).alias("malt_key")).agg(F.count(F.lit(1)).alias("n_rows")), "malt_key")
    return hops.select(F.lit("hop").alias("kind"), F.col("hop_key").alias("key"), "name", "n_recipes", "n_rows").union(malts.select(F.lit("malt"), "malt_key", "name", "n_recipes", "n_rows"))


@query("""SELECT o_orderkey AS id, 'r' || o_orderkey AS name, o_orderpriority AS family, CASE WHEN o_orderkey % 2 = 0 THEN 2010 END AS year, round((1 + o_orderkey % 90 / 1000)::DOUBLE, 6) AS og, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 70 END::DOUBLE AS ibu
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def star_facts(spark: SparkSession, sf: str) -> DataFrame:
    return documents.star_schema(_recipes(spark, sf))["recipes"].select("id", "name", "family", "year", F.round("og", 6).alias("og"), "ibu")


@query("""WITH o AS (SELECT o_orderkey AS id, 1 + o_orderkey % 90 / 1000 AS og, 1 + o_orderkey % 20 / 1000 AS fg, (o_orderkey % 12)::DOUBLE AS abv, o_orderkey % 70 AS ibu, o_orderkey % 40 + 1 AS srm FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem))
  SELECT id, round(ln(greatest(srm, 0.5)), 6) AS colour, round((CASE WHEN og > 1 THEN (og - fg) / (og - 1) ELSE 0 END)::DOUBLE, 6) AS attenuation, round((CASE WHEN og > 1 THEN ibu / ((og - 1) * 1000) ELSE 0 END)::DOUBLE, 6) AS ratio FROM o""")
def recipe_numerics(spark: SparkSession, sf: str) -> DataFrame:
    """The derived numbers of recipes with all five vitals."""
    rows = corpus.recipe_rows(_recipes(spark, sf), ["economy", "promo"], 5)[0]
    return rows.select("id", F.round("v4", 6).alias("colour"), F.round("v5", 6).alias("attenuation"), F.round("v6", 6).alias("ratio"))


@query(f"""WITH {STAR}, h AS (SELECT DISTINCT l_orderkey, coalesce(CASE WHEN p_partkey % 3 > 0 THEN lower(p_brand) ELSE '' END, lower(p_brand)) AS k FROM l WHERE l_linenumber % 2 = 1 AND l_orderkey % 5 > 0)
  SELECT k AS hop, count(*) AS n FROM h GROUP BY 1 ORDER BY n DESC, k LIMIT 40""")
def hop_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """How many recipes with all vitals use each of the most frequent hops that become feature columns."""
    rows, keys = corpus.recipe_rows(_recipes(spark, sf), ["economy"], 40)
    first = len(rows.columns) - 1 - len(keys)
    return rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("hop"), F.col(f"v{first + i}").alias("x")) for i, k in enumerate(keys)])).alias("c")).groupBy("c.hop").agg(F.sum("c.x").cast("long").alias("n"))


@query("""WITH p AS (SELECT p_partkey, p_size, p_name FROM part) SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN (1 + p_size / 500.0)::DOUBLE END AS og, (p_size / 4.0)::DOUBLE AS abv FROM p""")
def labelled_numbers(spark: SparkSession, sf: str) -> DataFrame:
    told = F.concat(F.when(_size() % 2 == 0, F.concat(F.lit("Original Gravity: about "), _text(1 + _size() / 500.0))).otherwise("FOG 3"), F.lit(" and ABV = "), _text(_size() / 4.0), F.lit("%"))
    return _dealt_parts(spark, sf).select("p_partkey", F.coalesce(text.labelled_number(told, "Original Gravity"), text.labelled_number(told, "OG")).alias("og"), text.labelled_number(told, "ABV").alias("abv"))


@query("SELECT p_partkey, p_name || '|' || p_brand || CASE WHEN p_size % 2 = 0 THEN '|third one' ELSE '' END AS examples FROM part")
def example_lists(spark: SparkSession, sf: str) -> DataFrame:
    listed = F.concat(F.lit("Dark Versions – "), "p_name", F.lit(", "), "p_brand", F.lit("; X,"), F.when(_size() % 2 == 0, "third one").otherwise(F.repeat(F.lit("z"), 60)))
    return _dealt_parts(spark, sf).select("p_partkey", F.array_join(brewing.examples(listed), "|").alias("examples"))


@query("""SELECT p_name AS k, count(*) AS n, arg_min(p_partkey, (CASE WHEN p_size % 3 = 0 THEN -100 ELSE 0 END - CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END, p_partkey)) AS fullest, max(p_partkey) AS last FROM part GROUP BY 1""")
def merged_records(spark: SparkSession, sf: str) -> DataFrame:
    """Of records with the same name the fullest and the last, joined as two sources."""
    rows = _parts(spark, sf).select(F.col("p_name").alias("k"), _key().alias("pos"), F.when(_size() % 3 == 0, 1).alias("aroma"), F.when(_size() % 2 == 0, 1).alias("more"))
    base = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    # a profile is also a field
    fullest = corpus.fullest(rows.withColumn("profile", F.col("aroma").isNotNull()).drop("aroma"), "k", F.col("profile"), "pos").drop("profile")
    got = corpus.merge_sources(base, [("one", fullest), ("two", R.last_wins(rows, "k", "pos"))], "k")
    return got.select("k", "n", F.col("one.pos").alias("fullest"), F.col("two.pos").alias("last"))


@query("""WITH p AS (SELECT min(p_partkey) AS id, p_name || p_brand AS name FROM part GROUP BY 2), e AS (SELECT a.id AS x, b.id AS y FROM (SELECT id, name, row_number() OVER (ORDER BY id) AS i FROM p) a JOIN (SELECT id, name, row_number() OVER (ORDER BY id) AS i FROM p) b ON b.i = a.i + 3 OR (a.i % 5 = 0 AND b.i = a.i + 1))
  SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM e""")
def substitute_edges(spark: SparkSession, sf: str) -> DataFrame:
    names = _parts(spark, sf).groupBy(F.concat("p_name", "p_brand").alias("name")).agg(F.min("p_partkey").alias("id"))
    i = features.numbered(names, "id", "place").select("id", "name", (F.col("place") + 1).alias("i"))
    third, next_one = (i.select((F.col("i") - d).alias("i"), F.upper("name").alias(f"n{d}")) for d in (3, 1))
    listed = i.join(third, "i", "left").join(next_one, "i", "left").select("id", "name", F.array_compact(F.array(F.concat(F.lit(" "), "n3"), F.when(F.col("i") % 5 == 0, F.col("n1")), F.lit("nobody"))).alias("substitutes"))
    return corpus.substitute_edges(listed, "id", "name", "substitutes")


@query("""WITH k AS (SELECT l_orderkey, lower(p_name) AS name, CASE WHEN p_size > 10 THEN p_brand END AS key FROM lineitem JOIN part ON l_partkey = p_partkey)
  SELECT name, count(*) AS n, (SELECT round(avg((key IS NOT NULL)::INT), 9) FROM k) AS rate FROM k WHERE key IS NULL GROUP BY 1 ORDER BY n DESC, name LIMIT 12""")
def unmatched_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").join(_parts(spark, sf), F.col("l_partkey") == _key()).withColumn("key", F.when(_size() > 10, F.col("p_brand")))
    rate = corpus.match_rate(rows, "key").select(F.round("rate", 9).alias("rate"))
    return corpus.unmatched(rows, "p_name", "key").join(F.broadcast(rate))  # one row


@query("""SELECT c_nationkey AS guide, c_mktsegment AS id, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("guide"), F.col("c_mktsegment").alias("id"))
    return corpus.duplicate_ids(rows, "guide", "id")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size * 10 WHEN p_size % 3 = 1 THEN p_size ELSE NULL END AS a, p_size * 10 AS b FROM part")
def overlaid_maps(spark: SparkSession, sf: str) -> DataFrame:
    bundled = F.create_map(F.lit("a"), F.when(_size() % 3 == 2, F.lit(None)).otherwise(_size()), F.lit("b"), _size())
    live = F.when(_size() % 3 == 0, F.create_map(F.lit("a"), _size() * 10, F.lit("b"), _size() * 10)).otherwise(F.create_map(F.lit("b"), _size() * 10))
    got = corpus.overlaid(bundled, live)
    return _dealt_parts(spark, sf).select("p_partkey", got["a"].alias("a"), got["b"].alias("b"))


@query("""WITH c AS (SELECT avg(p_retailprice) AS x, avg(p_size) AS y FROM part), d AS (SELECT p_partkey, p_retailprice - x AS dx, p_size - y AS dy FROM part, c), q AS (SELECT list_sort(list(greatest(abs(dx), abs(dy))))[least(count(*) - 1, floor(count(*) * 0.975))::INT + 1] AS q FROM d)
  SELECT p_partkey, round(dx / q, 6) AS x, round(dy / q, 6) AS y FROM d, q""")
def rescaled_points(spark: SparkSession, sf: str) -> DataFrame:
    rows = _parts(spark, sf).select("p_partkey", F.array("p_retailprice", F.col("p_size").cast("double"), F.lit(0.0)).alias("p"))
    return corpus.rescaled(rows, "p").select("p_partkey", F.round(F.col("p")[0], 6).alias("x"), F.round(F.col("p")[1], 6).alias("y"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS v FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0""")
def upserted(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer")
    existing = rows.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    return incremental.upsert(existing, rows.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") * 2).alias("v")), "id")


@query("""SELECT event_type, count(*) FILTER (WHERE value > 10) AS good, count(*) FILTER (WHERE NOT value > 10) AS rejected FROM events GROUP BY 1""")
def stream_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Good and rejected events as a stream parts them."""
    schema = ", ".join(f"{n} {t}" for n, t in table(spark, sf, "events").dtypes)
    work = new_folder(spark)
    rows = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")
    incremental.split_rejects(rows, F.col("value") > 10, f"{work}/good", f"{work}/bad", f"{work}/log").awaitTermination()
    kept, bad = (spark.read.parquet(f"{work}/{x}").select("event_type", F.lit(x == "good").alias("ok")) for x in ("good", "bad"))
    return kept.unionByName(bad).groupBy("event_type").agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("rejected"))


@query("SELECT p_partkey AS id, p_name AS name, p_size % 4 AS n_malts FROM part WHERE p_size % 4 > 0 AND p_size % 5 > 0")
def json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of JSON written out and read with rejects: some are cut short, some lack malts."""
    malts = F.transform(F.sequence(F.lit(0), _size() % 4), lambda i: F.struct(_text(i).alias("name")))
    whole = F.to_json(F.struct(_key().alias("id"), F.col("p_name").alias("name"), F.when(_size() % 4 > 0, F.slice(malts, F.lit(1), _size() % 4)).otherwise(F.expr("array()")).alias("malts")))
    path = f"{new_folder(spark)}/lines"
    _parts(spark, sf).select(F.when(_size() % 5 == 0, F.substring(whole, 1, 20)).otherwise(whole)).write.text(path)
    good, _ = documents.read_lines(spark, path, "id bigint, name string, malts array<struct<name:string>>", ["name", "malts"])
    return good.select("id", "name", F.size("malts").alias("n_malts"))


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS v, c_nationkey::BIGINT AS n FROM customer")
def json_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Files of one JSON object with an array each, and objects of objects: both read, and joined by key."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("v"), F.col("c_nationkey").cast("bigint").alias("n"))
    path = f"{new_folder(spark)}/array"
    # a file for each five hundred
    shelf = F.expr("id div 500").alias("shelf")
    rows.groupBy(shelf).agg(F.to_json(F.struct(F.collect_list(F.struct("id", "name")).alias("recipes"))).alias("value")).write.partitionBy("shelf").text(path)
    listed = documents.read_array(spark, path, "recipes", "id bigint, name string")
    entries = F.map_from_entries(F.collect_list(F.struct(_text(F.col("id")).alias("k"), F.struct("v", "n").alias("x"))))
    keyed = documents.object_values(rows.groupBy(shelf).agg(F.to_json(entries).alias("j")), "j", "v double, n bigint")
    return listed.join(keyed.select(F.col("key").cast("bigint").alias("id"), "v", "n"), "id")


@query("SELECT c_custkey AS id, m AS method, b AS blend, round(c_acctbal * f, 6) AS x, c_nationkey::DOUBLE AS y, 0.0::DOUBLE AS z FROM customer, (VALUES ('pca', 0.0::DOUBLE, 1), ('pca', 0.5::DOUBLE, 2), ('umap', 0.5::DOUBLE, 3)) t(m, b, f)")
def parallel_arrays(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    point = lambda f: F.collect_list(F.struct("c_custkey", F.array(F.col("c_acctbal") * f, F.col("c_nationkey").cast("double"), F.lit(0.0)).alias("p")))
    one = c.groupBy(F.expr("c_custkey div 500")).agg(point(1).alias("a"), point(2).alias("b"), point(3).alias("c")).select(F.col("a.c_custkey").alias("ids"), F.col("a.p").alias("a"), F.col("b.p").alias("b"), F.col("c.p").alias("c"))
    got = documents.unpivot_arrays(one, "ids", {("pca", 0.0): "a", ("pca", 0.5): "b", ("umap", 0.5): "c"})
    return got.withColumn("x", F.round("x", 6))


@query("""SELECT p_partkey AS url, p_partkey::VARCHAR AS id, 'Ale ' || p_name AS name, round((1 + p_size / 500.0)::DOUBLE, 3) AS og, round((p_size * 0.45359237)::DOUBLE, 3) AS kg, round((p_size * 28.349523125)::DOUBLE, 1) AS g,
  CASE WHEN p_size >= 45 THEN 'bittering' ELSE 'late' END AS stage, 'All Grain' AS method, CASE WHEN p_size % 2 = 0 THEN 'Porter' ELSE 'Plain' END AS style FROM part""")
def recipe_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages made of parts and parsed: JSON-LD, title, labels, and both tables."""
    c = lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i for i in x])
    size, name = _text(_size()), F.col("p_name")
    ld = F.when(_size() % 2 == 0, c('<script type="application/ld+json">[{"@type":"Person","name":"x"},{"@type":["Thing","Recipe"],"name":"Ale ', name, '","recipeCategory":"Porter"}]</script>')).otherwise(c("<title>Ale ", name, " | Beer Recipe | Site</title>"))
    html = c(
        ld, '<a href="/view/', _text(_key()), '/x">me</a> Method: All Grain Style: Plain  OG: ', F.format_string("%.3f", 1 + _size() / 500.0), "<table><tr><th>Amount</th><th>Fermentable</th></tr><tr><td>", size, " lb</td><td>", name,
        " (note)</td></tr><tr><td>9 lb</td><td>Total</td></tr></table><table><tr><th>Amount</th><th>Variety</th><th>Use</th><th>Time</th></tr><tr><td>", size, " oz</td><td>Hop</td><td>Boil</td><td>", size, " min</td></tr></table>",
    )
    got = documents.parse_recipe_page(_parts(spark, sf).select(_key().alias("url"), html.alias("html")), "url", "html")
    return got.select("url", "id", "name", "vitals.og", F.col("malts")[0]["kg"].alias("kg"), F.col("hops")[0]["g"].alias("g"), F.col("hops")[0]["stage"].alias("stage"), "method", "style")


@query("""SELECT p_partkey, 'xml' AS kind, p_name AS name, round((1 + p_size / 500.0)::DOUBLE, 3) AS og, (p_size * 2)::DOUBLE AS srm, round((p_size / 10.0)::DOUBLE, 3) AS kg, CASE WHEN p_size >= 45 THEN 'bittering' ELSE 'late' END AS stage FROM part WHERE p_size % 3 > 0""")
def recipe_xml(spark: SparkSession, sf: str) -> DataFrame:
    """XML made of parts, told apart from JSON, parsed, and rejected without a final gravity."""
    c = lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i for i in x])
    size = _text(_size())
    xml = c(
        " <RECIPES><RECIPE><NAME>", F.col("p_name"), "</NAME><OG>", F.format_string("%.3f", 1 + _size() / 500.0), " SG</OG>", F.when(_size() % 3 > 0, "<FG>1.010 SG</FG>").otherwise(""), "<IBU>30</IBU><COLOR>", _text(_size() * 2),
        "</COLOR><FERMENTABLES><FERMENTABLE><NAME>m</NAME><AMOUNT>", F.format_string("%.1f", _size() / 10.0), "</AMOUNT></FERMENTABLE></FERMENTABLES><HOPS><HOP><NAME>h</NAME><AMOUNT>0.02</AMOUNT><USE>Boil</USE><TIME>", size, "</TIME></HOP></HOPS></RECIPE></RECIPES>",
    )
    docs = _parts(spark, sf).select("p_partkey", xml.alias("xml")).withColumn("kind", documents.sniff(F.col("xml")))
    got, _ = documents.import_xml(docs, "xml")
    return got.select("p_partkey", "kind", "name", "vitals.og", "vitals.srm", F.col("malts")[0]["kg"].alias("kg"), F.col("hops")[0]["stage"].alias("stage"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'Imported recipe' END AS name, round((p_size / 8.0)::DOUBLE, 6) AS abv, round((CASE WHEN p_size % 5 = 0 THEN p_size / 1.97 ELSE p_size END)::DOUBLE, 6) AS srm, CASE WHEN p_size % 4 = 0 THEN 'dry' ELSE 'late' END AS stage
  FROM part WHERE p_size % 7 > 0""")
def recipe_json(spark: SparkSession, sf: str) -> DataFrame:
    """JSON exports made of parts: some nested, some with colours in EBC, some without a gravity."""
    n = F.nullif(_size() * 0 + 1, F.lit(0))
    colour = F.when(_size() % 5 == 0, F.create_map(F.lit("ebc"), _text(_size()))).otherwise(F.create_map(F.lit("srm"), _text(_size())))
    fields = F.map_concat(colour, F.create_map(F.lit("name"), F.when(_size() % 2 == 0, F.col("p_name")).otherwise(" "), F.lit("og"), F.when(_size() % 7 > 0, "1.050").otherwise(""), F.lit("estimatedFg"), F.lit("1.010"), F.lit("abv"), _text(_size() / 8.0), F.lit("ibu"), _text(n * 20)))
    flat = F.to_json(fields)
    hops = F.concat(F.lit('"hops":[{"name":"h","amount":20,"use":"'), F.when(_size() % 4 == 0, "Dry Hop").otherwise("Aroma"), F.lit('"}]}'))
    whole = F.concat(F.substring(flat, F.lit(1), F.length(flat) - 1), F.lit(","), hops)
    docs = _parts(spark, sf).select("p_partkey", F.when(_size() % 3 == 0, F.concat(F.lit('{"recipe":'), whole, F.lit("}"))).otherwise(whole).alias("content"))
    got, _ = brewing.import_json(docs, "content")
    return got.select("p_partkey", "name", F.round("vitals.abv", 6).alias("abv"), F.round("vitals.srm", 6).alias("srm"), F.col("hop_schedule")[0]["stage"].alias("stage"))


@query("""SELECT 'p' || (p_partkey % 40) AS id, 's' || max(p_partkey) AS slug FROM part GROUP BY 1""")
def listing_links(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct links of the pages of a listing of all parts, a page for each thousand; the last slug of an id wins."""
    link = F.concat(F.lit('<a href="/view/p'), _text(_key() % 40), F.lit("/s"), _text(_key()), F.lit('">x</a>'))
    pages = _parts(spark, sf).groupBy(F.expr("p_partkey div 1000").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", link.alias("l")))), lambda x: x["l"]), " ").alias("html"))
    return documents.listing_links(pages, "html", r"/view/(p[0-9]+)/(s[0-9]+)", "page").select("id", "slug")


@query("""WITH v AS (SELECT p_partkey, p_size::DOUBLE AS a, (p_partkey % 7)::DOUBLE AS b FROM part) SELECT p_partkey, CASE WHEN a + b > 0 THEN round(a / (a + b), 9) END AS citrus, CASE WHEN p_partkey % 2 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS berry,
  round((0.82 * (0.55 * 0.85 + 0.45 * 0.7))::DOUBLE, 9) AS score, CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.15 ELSE 0.5 END::DOUBLE AS tradition FROM v JOIN part USING (p_partkey)""")
def hop_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Aroma of hops by profile and by notes, tradition, and a pairing score without aroma."""
    profile = F.array(F.col("p_size").cast("double"), (_key() % 7).cast("double"), *[F.lit(0.0)] * 7)
    notes = F.when(_key() % 2 == 0, F.array(F.lit("Berry"), F.lit("rose petals"))).otherwise(F.array(F.lit("lemon"), F.lit("pepper")))
    nothing = F.lit(None).cast("array<double>")
    score = matching.pairing_score(nothing, profile, F.lit(0.85), F.lit(None).cast("double"), F.lit(20.0), F.lit(30.0))
    tags = F.when(_size() % 3 == 2, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("british-isles")))
    country = F.when(_size() % 3 == 0, "united kingdom").otherwise("Germany")
    return _dealt_parts(spark, sf).select(
        "p_partkey", F.round(brewing.hop_aroma(profile, notes)[0], 9).alias("citrus"), brewing.hop_aroma(nothing, notes)[6].alias("berry"), F.round(score, 9).alias("score"), brewing.tradition(tags, country).alias("tradition")
    )


@query("""WITH p AS (SELECT p_partkey, p_size AS s FROM part) SELECT p_partkey, CASE WHEN s >= 10 THEN s END::DOUBLE AS myrcene, CASE WHEN s BETWEEN 4 AND 24 THEN s / 2.0 END::DOUBLE AS farnesene FROM p""")
def oil_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Oil shares within their limits; what is beyond is dropped, and the least sizes are read as shifted labels."""
    none = F.lit(None).cast("string")
    record = lambda **k: F.struct(*[k.get(f, none).alias(f) for f in ("myrcene", "humulene", "caryophyllene", "farnesene", "geraniol", "linalool", "oils")])
    first = record(myrcene=F.concat(_text(_size()), F.lit("%")), farnesene=F.when(_size() < 25, _text(_size() / 2)))
    oils = brewing.oil_profile(first, record(), record())
    return _dealt_parts(spark, sf).select("p_partkey", oils["myrcene"]["hi"].alias("myrcene"), oils["farnesene"]["hi"].alias("farnesene"))


@query("""WITH s AS (SELECT avg(p_retailprice) AS a, stddev_pop(p_retailprice) AS b FROM part WHERE p_size <= 25) SELECT p_partkey, round((p_retailprice - a) / b * sqrt(1.4), 6) AS x, round(CASE WHEN p_type = 'PROMO' THEN sqrt(0.6) * sqrt(1 / 2.0) ELSE 0 END, 6) AS flag FROM part, s WHERE p_size > 25""")
def transformed_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points that a space wasn't fitted on."""
    parts = _parts(spark, sf).withColumn("tags", F.array("p_type"))
    space = features.fit_space(parts.where("p_size <= 25"), ["p_retailprice"], "tags", 0.3, spark.createDataFrame([("PROMO",), ("SMALL",)], "tag string"))
    return parts.where("p_size > 25").select("p_partkey", space.vector("tags").alias("v")).select("p_partkey", F.round(F.col("v")[0], 6).alias("x"), F.round(F.col("v")[1], 6).alias("flag"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, md5(l_orderkey || l_linenumber::VARCHAR || l_partkey) AS digest FROM lineitem""")
def written_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Rows written as a table and as lines of JSON, published as a version, and read back from both."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    work = new_folder(spark)

    def build(path: str) -> None:
        documents.write_tables({"t": rows.where("l_linenumber % 2 = 0")}, path)
        documents.write_json({"j": rows.where("l_linenumber % 2 = 1")}, path)

    incremental.publish(spark, build, work)
    at = incremental.current(spark, work)
    both = spark.read.parquet(f"{at}/t").unionByName(spark.read.schema("l_orderkey bigint, l_linenumber int, l_partkey bigint").json(f"{at}/j"))
    return both.select("*", F.md5(F.concat(_text(F.col("l_orderkey")), _text(F.col("l_linenumber")), _text(F.col("l_partkey"))).cast("binary")).alias("digest"))
