"""Records of recipes and styles as views, services, files and entry forms have them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import brewing, text
from ..operators import corpus
from ..operators import relational as R
from ..operators import views
from ..sources import documents, paged
from .recipes import _pick, _sql_pick
from .tables import Registry, table
from .texts import new_folder

REGISTRY = Registry()
query = REGISTRY.add

#: Styles made of parts: five ranges, some without an end.
STYLES_SQL = """s AS (SELECT p_partkey, p_name, 1 + p_size / 1000.0::DOUBLE AS og1, 1.02 + p_size / 900.0::DOUBLE AS og2, CASE WHEN p_partkey % 7 > 0 THEN 1.0 + p_size / 4000.0::DOUBLE END AS fg1, 1.01 + p_size / 3000.0::DOUBLE AS fg2,
  p_size / 10.0::DOUBLE AS abv1, CASE WHEN p_partkey % 11 > 0 THEN p_size / 6.0::DOUBLE END AS abv2, p_size * 1.0::DOUBLE AS ibu1, p_size * 2.0::DOUBLE AS ibu2, p_size * 0.8::DOUBLE AS srm1, p_size * 1.3::DOUBLE AS srm2 FROM part),
  h AS (SELECT * FROM s WHERE fg1 IS NOT NULL AND abv2 IS NOT NULL)"""


def _styles(spark: SparkSession, sf: str) -> DataFrame:
    size, k = F.col("p_size"), F.col("p_partkey")
    box = lambda lo, hi: F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    stats = F.struct(
        box(1 + size / 1000.0, 1.02 + size / 900.0).alias("og"), box(F.when(k % 7 > 0, 1.0 + size / 4000.0), 1.01 + size / 3000.0).alias("fg"), box(size / 10.0, F.when(k % 11 > 0, size / 6.0)).alias("abv"),
        box(size, size * 2).alias("ibu"), box(size * 0.8, size * 1.3).alias("srm"),
    )
    return table(spark, sf, "part").select("p_partkey", "p_name", stats.alias("stats"))


@query(f"""WITH {STYLES_SQL} SELECT p_partkey, h.p_partkey IS NOT NULL AS has_stats, round((h.og1 + h.og2) / 2, 9) AS og, round((h.fg1 + h.fg2) / 2, 9) AS fg, round((h.abv1 + h.abv2) / 2, 9) AS abv, (h.ibu1 + h.ibu2) / 2 AS ibu, round((h.srm1 + h.srm2) / 2, 9) AS srm FROM s LEFT JOIN h USING (p_partkey)""")
def middle_vitals(spark: SparkSession, sf: str) -> DataFrame:
    """The middles of styles that have all five ranges."""
    rows = _styles(spark, sf).select("p_partkey", views.has_stats("stats").alias("has_stats"), views.middle_vitals("stats").alias("m"))
    return rows.select("p_partkey", "has_stats", *[(F.col(f"m.{v}") if v == "ibu" else F.round(f"m.{v}", 9)).alias(v) for v in views.VITALS])


@query(f"""WITH {STYLES_SQL} SELECT p_partkey, round(least(srm1, 45), 6) AS low, round(least((srm1 + srm2) / 2, 45), 6) AS middle, round(least(srm2, 45), 6) AS high FROM h ORDER BY (srm1 + srm2) / 2, p_partkey""")
def colour_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """Styles from pale to dark, colours capped."""
    got = views.colour_ladder(_styles(spark, sf), "stats", "p_partkey")
    return got.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("low", "middle", "high")])


@query(f"""WITH {STYLES_SQL}, m AS (SELECT p_partkey, (og1 + og2) / 2 AS og, (fg1 + fg2) / 2 AS fg, (srm1 + srm2) / 2 AS srm FROM h)
  SELECT p_partkey, round(og, 6) AS og, round(least(greatest(CASE WHEN og > 1 THEN (og - fg) / (og - 1) * 100 ELSE 0 END, 55), 95), 6) AS attenuation, round(srm, 6) AS srm FROM m""")
def fermentability(spark: SparkSession, sf: str) -> DataFrame:
    """Gravity against attenuation, clamped to the chart."""
    got = views.fermentability(_styles(spark, sf), "stats", "p_partkey")
    return got.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("og", "attenuation", "srm")])


@query("""SELECT 'A' AS guide, p_partkey, p_name FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'B', p_partkey, p_name FROM part WHERE p_partkey % 3 = 0""")
def overlaid_guides(spark: SparkSession, sf: str) -> DataFrame:
    """Two guides as one."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    return views.overlay(parts.where("p_partkey % 2 = 0"), parts.where("p_partkey % 3 = 0"))


ROWS_SQL = """r AS (SELECT o_orderkey AS id, o_orderpriority AS name, o_orderstatus AS family, 1 + o_custkey % 90 / 1000.0::DOUBLE AS og, CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 90 * 1.0::DOUBLE END AS ibu,
  CASE WHEN o_custkey % 3 > 0 THEN 'S' || o_custkey % 20 END AS style_code, CASE WHEN o_custkey % 2 > 0 THEN 'Style ' || o_custkey % 20 END AS style_name, (o_custkey % 30)::DOUBLE AS batch_l FROM orders)"""


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("o_custkey")
    s = lambda x: x.cast("string")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("family"), (1 + c % 90 / 1000.0).alias("og"), F.lit(None).cast("double").alias("fg"), F.lit(5.0).alias("abv"),
        F.when(c % 5 > 0, c % 90 * 1.0).alias("ibu"), (c % 40).cast("double").alias("srm"), F.lit(None).cast("double").alias("attenuation"), F.when(c % 3 > 0, F.concat(F.lit("S"), s(c % 20))).alias("style_code"),
        F.when(c % 2 > 0, F.concat(F.lit("Style "), s(c % 20))).alias("style_name"), (c % 30).cast("double").alias("batch_l"), F.lit(1.5).alias("hop_dose"), F.lit(None).cast("double").alias("roast"),
    )


@query(f"""WITH {ROWS_SQL} SELECT id, name, family, og, ibu, style_code AS code, CASE WHEN style_code IS NOT NULL THEN coalesce(style_name, '') END AS style, batch_l, 0 AS n_malts, false AS light FROM r
  UNION ALL SELECT id, name, family, NULL, ibu, style_code, CASE WHEN style_code IS NOT NULL THEN '' END, NULL, 0, true FROM r""")
def row_records(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a page and points of a projection as records."""
    rows = _rows(spark, sf)
    whole = views.row_records(rows).select("id", "name", "family", "vitals.og", "vitals.ibu", F.col("styleGuess.code").alias("code"), F.col("styleGuess.name").alias("style"), F.col("batchL").alias("batch_l"), F.size("malts").alias("n_malts"), F.lit(False).alias("light"))
    light = views.point_records(rows).select("id", "name", "family", "vitals.og", "vitals.ibu", F.col("styleGuess.code").alias("code"), F.col("styleGuess.name").alias("style"), F.lit(None).cast("double").alias("batch_l"), F.lit(0).alias("n_malts"), F.lit(True).alias("light"))
    return whole.unionByName(light)


@query("""WITH l AS (SELECT l_orderkey AS id, count(*) AS n, sum(CASE WHEN l_linenumber % 3 > 0 THEN 0 ELSE 1 END) AS late, string_agg(l_partkey || ':' || l_quantity::INT, ',' ORDER BY l_quantity DESC, l_partkey, l_linenumber) AS bill FROM lineitem GROUP BY 1)
  SELECT id, coalesce(nullif(o_orderpriority, '3-MEDIUM'), '') AS name, n, late, bill FROM l JOIN orders ON id = o_orderkey""")
def detail_records(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a record with both bills; additions without a stage are late."""
    lines = table(spark, sf, "lineitem")
    amount = F.col("l_quantity")
    stage = F.when(F.col("l_linenumber") % 3 > 0, F.lit("dry"))
    order = [-amount, F.col("l_partkey"), F.col("l_linenumber")]
    name = F.col("l_partkey").cast("string").alias("name")
    malts = R.nest(lines.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", name, amount.alias("pct"), F.lit("base").alias("class")), ["l_orderkey"], ["name", "pct", "class"], order, "malts")
    hops = R.nest(lines.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", name, F.lit("k").alias("key"), amount.alias("g"), stage.alias("stage")), ["l_orderkey"], ["name", "key", "g", "stage"], order, "hops")
    none = lambda kind: F.lit(None).cast(kind)
    rows = _rows(spark, sf).withColumn("name", F.nullif("name", F.lit("3-MEDIUM"))).withColumns({"tagline": none("string"), "year": none("int"), "origin": none("string"), "yeast": none("string")})
    got = views.detail_records(rows.join(malts, F.col("id") == F.col("l_orderkey")).drop("l_orderkey").join(hops, F.col("id") == F.col("l_orderkey")))
    bill = F.array_join(F.transform("malts", lambda m: F.concat(m["name"], F.lit(":"), m["pct"].cast("int").cast("string"))), ",")
    return got.select("id", "name", F.size("hops").cast("long").alias("n"), F.size(F.filter("hops", lambda h: h["stage"] == "late")).cast("long").alias("late"), bill.alias("bill"))


HOPS = ["Cascade", "US Cascade", "Citra Pellets", "East Kent Goldings", "Fuggles", "Saaz (CZ)", "Nelson", "Coffee"]
KEYS = ["cascade", "cascade-us", "citra", "east-kent-golding", "fuggle", "saaz", "nelson-sauvin", "coffee"]
PLAIN = ["cascade", "cascade", "citra", "east kent golding", "fuggle", "saaz", "nelson", "coffee"]


@query(f"""WITH n AS (SELECT i, (list_value({", ".join(f"'{x}'" for x in PLAIN)}))[i + 1] AS wanted, (list_value({", ".join(f"'{x}'" for x in KEYS)}))[i + 1] AS key FROM range(7) r(i)),
  x AS (SELECT wanted, key, 2 * i AS pos FROM n UNION ALL SELECT replace(key, '-', ' '), key, 2 * i + 1 FROM n), d AS (SELECT wanted, arg_max(key, pos) AS key FROM x GROUP BY 1),
  w AS (SELECT l_orderkey, l_linenumber, l_partkey, {_sql_pick("l_partkey", [*PLAIN, "nelson sauvin"])} AS wanted FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, key AS hop_key FROM w LEFT JOIN d USING (wanted)""")
def looked_up_hops(spark: SparkSession, sf: str) -> DataFrame:
    """The key of each addition's hop in an index of names and keys, where the later of equal entries counts."""
    hops = spark.range(7).select(F.col("id").alias("at"), _pick(F.col("id"), HOPS[:7] + [""]).alias("name"), _pick(F.col("id"), KEYS[:7] + [""]).alias("key"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", _pick(F.col("l_partkey"), [*HOPS, "Nelson-Sauvin"]).alias("hop"))
    return views.hop_keys(lines, "hop", views.name_index(hops, "name", "key", "at")).select("l_orderkey", "l_linenumber", "l_partkey", "hop_key")


@query("""SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN NULL ELSE 1990 + p_size END::INTEGER AS year, CASE WHEN p_size % 4 > 0 THEN p_size / 2.0 WHEN p_size % 3 = 0 THEN p_size * 1.0 END::DOUBLE AS low FROM part""")
def years_and_cohumulone(spark: SparkSession, sf: str) -> DataFrame:
    """Years of dates as text, and cohumulone of the first source that knows it."""
    size = F.col("p_size")
    date = F.when(size % 9 == 0, "unknown").otherwise(F.concat(F.lit("09/"), (1990 + size).cast("string")))
    low = F.when(size % 4 > 0, size / 2.0).otherwise(0.0)
    told = F.when(size % 3 == 0, F.concat(size.cast("string"), F.lit(" - 99%"))).otherwise("Non")
    return table(spark, sf, "part").select("p_partkey", text.last_year(date).alias("year"), brewing.cohumulone(low, low, F.lit("Non"), told)["lo"].alias("low"))


BILLS_SQL = """b AS (SELECT l_orderkey AS id, sum(l_quantity) AS g, round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END), 2) AS roast FROM lineitem GROUP BY 1),
  v AS (SELECT id, CASE WHEN o_custkey % 4 > 0 THEN round(g / (o_custkey % 4 * 10), 2) END AS dose, roast, CASE WHEN o_custkey % 5 > 0 THEN (o_custkey % 90)::DOUBLE END AS ibu, CASE WHEN o_custkey % 3 > 0 THEN (o_custkey % 120)::DOUBLE END AS srm FROM b JOIN orders ON id = o_orderkey)"""


def _bills(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as fat recipes: lines are both hops and malts."""
    lines = table(spark, sf, "lineitem")
    cls = F.when(F.col("l_returnflag") == "A", "roasted").otherwise("base")
    name, g = F.col("l_partkey").cast("string"), F.col("l_quantity")
    lists = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct(name.alias("name"), g.alias("kg"), cls.alias("class"), g.alias("pct"))).alias("malts"), F.collect_list(F.struct(name.alias("name"), name.alias("key"), g.alias("g"), F.lit("late").alias("stage"), F.lit(5.0).alias("timeMin"))).alias("hops"))
    c, none = F.col("o_custkey"), F.lit(None).cast("double")
    vitals = F.struct(none.alias("og"), none.alias("fg"), none.alias("abv"), F.when(c % 5 > 0, (c % 90).cast("double")).alias("ibu"), F.when(c % 3 > 0, (c % 120).cast("double")).alias("srm"))
    rows = lists.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), vitals.alias("vitals"), F.when(c % 4 > 0, (c % 4 * 10).cast("double")).alias("batchL"), "malts", "hops", F.lit("long prose").alias("description"))


@query(f"""WITH {BILLS_SQL} SELECT id, 'hops' AS mode, dose AS x, ibu AS y FROM v WHERE dose > 0 AND ibu IS NOT NULL UNION ALL SELECT id, 'roast', roast, least(srm, 80) FROM v WHERE srm IS NOT NULL""")
def slim_points(spark: SparkSession, sf: str) -> DataFrame:
    """Both scatter charts of slim recipes."""
    slim = corpus.slim(_bills(spark, sf))
    return corpus.scatter_points(slim, "hops").withColumn("mode", F.lit("hops")).unionByName(corpus.scatter_points(slim, "roast").withColumn("mode", F.lit("roast")))


@query("""SELECT p_partkey, p_size::DOUBLE / 10 + 1 AS og_in, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 3 = 0 THEN round((p_size / 500.0 - 0.01) * 131.25, 6) ELSE p_size / 4.0 END::DOUBLE AS abv, p_size % 5 > 0 AS taken FROM part""")
def entered_recipes(spark: SparkSession, sf: str) -> DataFrame:
    """Recipes entered by hand: strength computed where it is blank, entries without a number left."""
    size, s = F.col("p_size"), lambda x: x.cast("string")
    entries = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("name"), s(1 + size / 500.0).alias("og"), F.when(size % 5 == 0, "?").otherwise("1.01").alias("fg"), F.when(size % 3 == 0, " ").otherwise(s(size / 4.0)).alias("abv"), F.lit("30").alias("ibu"), F.lit("9").alias("srm")
    )
    good, bad = corpus.manual_recipe(entries)
    out = good.select(F.col("name").cast("long").alias("p_partkey"), F.round("vitals.abv", 6).alias("abv"), F.lit(True).alias("taken"))
    out = out.unionByName(bad.select(F.col("name").cast("long").alias("p_partkey"), F.lit(None).cast("double").alias("abv"), F.lit(False).alias("taken")))
    return out.join(table(spark, sf, "part"), "p_partkey").select("p_partkey", (size / 10.0 + 1).alias("og_in"), "abv", "taken")


@query("""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 1000 AND c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 50""")
def json_corpus_page(spark: SparkSession, sf: str) -> DataFrame:
    """The page a service would give, over files that each are one JSON array."""
    folder = f"{new_folder(spark)}/corpus"
    rows = table(spark, sf, "customer")
    # a file for each nation
    rows.groupBy("c_nationkey").agg(F.to_json(F.collect_list(F.struct("c_custkey", "c_name", "c_acctbal", "c_mktsegment"))).alias("value")).select("value", "c_nationkey").write.partitionBy("c_nationkey").text(folder)
    corpus_rows = documents.read_array(spark, folder, None, "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string")
    found = R.range_filters(corpus_rows, {"c_acctbal": (1000, "")}).where("c_mktsegment = 'BUILDING'")
    return R.page(found, "c_acctbal", True, "c_custkey", R.clamp_int("0", 50, 60_000)).select("c_custkey", "c_name", "c_acctbal")


class _Shelf:
    """A paged service over ids from low to high, which answers from the table's own rule (names follow from ids)."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high

    def __call__(self, cursor: object, size: int) -> list[tuple[tuple, object]]:
        first = self.low if cursor is None else int(cursor) + 1
        return [((i, f"Supplier#{i}"), i) for i in range(first, min(first + size, self.high))]


@query("SELECT s_suppkey, n.name IS NOT NULL AS found FROM supplier LEFT JOIN (SELECT s_suppkey, 'Supplier#' || s_suppkey AS name FROM supplier) n USING (s_suppkey)")
def paged_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers pulled page by page from four parts of a service, held against the table."""
    low, high = table(spark, sf, "supplier").agg(F.min("s_suppkey"), F.max("s_suppkey") + 1).first()
    cuts = [low + (high - low) * i // 4 for i in range(5)]
    pulled = paged.read_pages(spark, "supplier_pages", [_Shelf(a, b) for a, b in zip(cuts, cuts[1:], strict=False)], "s_suppkey bigint, name string", 7)
    return table(spark, sf, "supplier").select("s_suppkey").join(pulled, "s_suppkey", "left").select("s_suppkey", F.col("name").isNotNull().alias("found"))


@query("""SELECT 'brands' AS view, p_brand AS name, n FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 20) UNION ALL SELECT 'types', p_type, n FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 3)""")
def exported_views(spark: SparkSession, sf: str) -> DataFrame:
    """Views written as JSON with a limit of their own, and read back."""
    folder = new_folder(spark)
    count = lambda c: table(spark, sf, "part").groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    order: list[Column] = [F.desc("n"), F.col("name")]
    documents.export_views({"brands": (count("p_brand"), order, 20), "types": (count("p_type"), order, 3)}, folder)
    read = lambda v: spark.read.schema("name string, n bigint").json(f"{folder}/{v}").select(F.lit(v).alias("view"), "name", "n")
    return read("brands").unionByName(read("types"))


@query("""SELECT c_custkey, 0.5::DOUBLE AS blend FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN 0.0 ELSE 1.0 END::DOUBLE FROM customer WHERE c_custkey % 3 > 0""")
def nearest_blends(spark: SparkSession, sf: str) -> DataFrame:
    """The precomputed blend nearest to each that is asked for."""
    asked = {0: 0.26, 1: 0.2, 2: 0.8}
    blends = F.create_map(*[F.lit(x) for k, v in asked.items() for x in (k, float(corpus.nearest_blend(v)))])
    return table(spark, sf, "customer").select("c_custkey", blends[(F.col("c_custkey") % 3).cast("int")].alias("blend"))


@query("""WITH p AS (SELECT c_custkey, c_acctbal / 100 - 40 AS x, (c_nationkey - 12)::DOUBLE AS y FROM customer), m AS (SELECT max(greatest(abs(x), abs(y))) AS m FROM p) SELECT c_custkey, round(x * (1.15 / m), 9) AS x, round(y * (1.15 / m), 9) AS y FROM p, m""")
def unit_cubes(spark: SparkSession, sf: str) -> DataFrame:
    """Points scaled by their largest coordinate."""
    points = table(spark, sf, "customer").select("c_custkey", F.array(F.col("c_acctbal") / 100 - 40, (F.col("c_nationkey") - 12).cast("double")).alias("p"))
    return corpus.unit_cube(points, "p").select("c_custkey", F.round(F.col("p")[0], 9).alias("x"), F.round(F.col("p")[1], 9).alias("y"))
