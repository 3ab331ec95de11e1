"""What an explorer asks: boards by family, details, projections, guide differences, orders and small views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import domain, text, units
from ..operators import browse as B
from ..operators import corpus
from ..operators import relational as R
from ..operators import rollups as U
from .bills import LINES
from .tables import Registry, order_parts, table, with_orders

REGISTRY = Registry()
query = REGISTRY.add


@query(f"""WITH {LINES}, r AS (SELECT o_orderpriority AS f, l_orderkey AS g, p_type AS kind, split_part(p_name, ' ', 2) AS k, p_name AS nm,
    CASE WHEN sum(l_quantity) OVER (PARTITION BY l_orderkey) > 0 THEN l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) * 100 ELSE 0 END AS pct
    FROM lines JOIN orders ON l_orderkey = o_orderkey),
  b AS (SELECT * FROM r UNION ALL SELECT 'all', g, kind, k, nm, pct FROM r), n AS (SELECT f, count(DISTINCT g) AS n_groups FROM b GROUP BY 1),
  m AS (SELECT f, kind, k, nm FROM (SELECT f, kind, k, nm, count(*) AS c FROM b GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY f, kind, k ORDER BY c DESC, nm) = 1)
  SELECT f AS family, kind, k AS key, m.nm AS name, round(sum(pct) / any_value(n_groups), 6) AS mean_share, count(DISTINCT g) AS n_with
  FROM b JOIN n USING (f) JOIN m USING (f, kind, k) GROUP BY 1, 2, 3, 4""")
def share_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_orders(U.ratio_to_total(order_parts(spark, sf, by_order=True), "l_orderkey", "l_quantity"), spark, sf)
    rows = rows.select(F.col("o_orderpriority").alias("family"), F.col("l_orderkey").alias("g"), F.col("p_type").alias("kind"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("key"), F.col("p_name").alias("name"), "pct")
    return U.share_breakdown(rows, "family", "g", "kind", "key", "name", "pct").withColumn("mean_share", F.round("mean_share", 6))


@query("""WITH o AS (SELECT o_orderpriority AS f, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 100 END AS code FROM orders),
  b AS (SELECT * FROM o UNION ALL SELECT 'all', price, code FROM o)
  SELECT f AS family, count(*) AS n, round(avg(price), 4) AS avg_price, round(avg(code), 6) AS avg_code FROM b GROUP BY 1""")
def outcomes_by_family(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("family"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 100).alias("code"))
    got = U.outcomes(rows, "family", ["price", "code"])
    return got.select("family", "n", F.round("avg_price", 4).alias("avg_price"), F.round("avg_code", 6).alias("avg_code"))


YEASTS = """y AS (SELECT o_orderkey, o_orderpriority AS family, o_totalprice / 5000 AS attenuation,
  CASE o_custkey % 5 WHEN 0 THEN ' WLP ' || (100 + o_custkey % 40) || ' Ale!' WHEN 1 THEN 'Fermentis US-0' || o_custkey % 10 WHEN 2 THEN 'Wy' || (1000 + o_custkey % 20) || ' strain' WHEN 3 THEN 'House  Strain ' || o_custkey % 3 ELSE '- -' END AS raw FROM orders)"""


def _yeasts(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("o_custkey")
    s = lambda x: x.cast("string")
    raw = F.when(c % 5 == 0, F.concat(F.lit(" WLP "), s(100 + c % 40), F.lit(" Ale!"))).when(c % 5 == 1, F.concat(F.lit("Fermentis US-0"), s(c % 10))).when(c % 5 == 2, F.concat(F.lit("Wy"), s(1000 + c % 20), F.lit(" strain")))
    raw = raw.when(c % 5 == 3, F.concat(F.lit("House  Strain "), s(c % 3))).otherwise("- -")
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("family"), (F.col("o_totalprice") / 5000).alias("attenuation"), raw.alias("raw"))


@query(rf"""WITH {YEASTS}, c AS (SELECT *, trim(regexp_replace(regexp_replace(lower(trim(raw)), '[^a-z0-9/ -]+', ' ', 'g'), '\s+', ' ', 'g')) AS cleaned FROM y),
  k AS (SELECT *, coalesce(nullif(replace(regexp_extract(cleaned, '\b(wlp ?\d{{3,4}}|wy ?\d{{4}}|[a-z]{{1,2}}-\d{{2,3}}|34/70|\d{{4}})\b', 1), ' ', ''), ''), cleaned) AS code FROM c WHERE regexp_matches(cleaned, '[a-z0-9]')),
  n AS (SELECT code, raw FROM (SELECT code, trim(raw) AS raw, count(*) AS m FROM k GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY code ORDER BY m DESC, raw) = 1),
  f AS (SELECT code, family FROM (SELECT code, family, count(*) AS m FROM k GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY code ORDER BY m DESC, family) = 1)
  SELECT code, n.raw, count(*) AS n, round(count(*) / (SELECT count(*) FROM y), 6) AS share, round(quantile_cont(attenuation, 0.5) FILTER (WHERE attenuation > 40 AND attenuation < 100), 6) AS median, f.family
  FROM k JOIN n USING (code) JOIN f USING (code) GROUP BY 1, 2, 6 ORDER BY n DESC, code LIMIT 15""")
def yeast_board(spark: SparkSession, sf: str) -> DataFrame:
    rows = _yeasts(spark, sf).withColumn("code", domain.yeast_key(F.col("raw"))).withColumn("raw", F.trim("raw"))
    got = U.code_board(rows, "code", "raw", "family", "attenuation", 40.0, 100.0, 15)
    return got.withColumn("share", F.round("share", 6)).withColumn("median", F.round("median", 6))


@query("""SELECT o_orderkey, o_orderpriority, (SELECT string_agg(l_linenumber || ':' || l_quantity::INT, ',' ORDER BY l_quantity DESC, l_linenumber, l_partkey) FROM lineitem WHERE l_orderkey = 77) AS lines,
  (SELECT string_agg(x, ';' ORDER BY k) FROM (SELECT l_returnflag AS k, l_returnflag || '=' || string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS x FROM lineitem WHERE l_orderkey = 77 GROUP BY 1)) AS staged
  FROM orders WHERE o_orderkey = 77""")
def detail_page(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag").withColumn("tie", F.struct("l_linenumber", "l_partkey"))
    one = B.detail(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", 77, {"bill": (lines, "l_orderkey", "l_quantity", "tie")})
    bill = F.array_join(F.transform("bill", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_quantity"].cast("int").cast("string"))), ",")
    staged = F.transform(B.by_stage(F.col("bill"), "l_returnflag", ["A", "N", "R"]), lambda g: F.concat(g["stage"], F.lit("="), F.array_join(F.transform(g["lines"], lambda x: x["l_linenumber"].cast("string")), ",")))
    return one.select("o_orderkey", "o_orderpriority", F.nullif(bill, F.lit("")).alias("lines"), F.nullif(F.array_join(staged, ";"), F.lit("")).alias("staged"))


POINTS = """p AS (SELECT c_custkey, m AS method, b AS blend, c_acctbal * (1 + b) AS x, c_nationkey - b AS y FROM customer, (VALUES ('pca'), ('umap')) t(m), (VALUES (0.0), (0.5), (1.0)) u(b) WHERE c_custkey % 11 > 0)"""


def _points(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").where("c_custkey % 11 > 0")
    rows = rows.withColumn("method", F.explode(F.array(F.lit("pca"), F.lit("umap")))).withColumn("blend", F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))))
    return rows.select("c_custkey", "method", "blend", (F.col("c_acctbal") * (1 + F.col("blend"))).alias("x"), (F.col("c_nationkey") - F.col("blend")).alias("y"))


@query(f"""WITH {POINTS} SELECT c_custkey, round(x, 6) AS x, round(y::DOUBLE, 6) AS y, c_name, c_mktsegment FROM p JOIN customer USING (c_custkey)
  WHERE method = 'pca' AND blend = 0.5 AND c_mktsegment <> 'MACHINERY' ORDER BY md5(c_custkey::VARCHAR), c_custkey LIMIT 400""")
def projection_page(spark: SparkSession, sf: str) -> DataFrame:
    details = table(spark, sf, "customer").where("c_mktsegment <> 'MACHINERY'").select("c_custkey", "c_name", "c_mktsegment")
    got = B.projection_page(_points(spark, sf), details, "c_custkey", "pca", "0.7", "400")
    return got.select("c_custkey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "c_name", "c_mktsegment")


@query(f"""WITH {POINTS} SELECT c_custkey, round(x, 6) AS x, c_name FROM p JOIN customer USING (c_custkey) WHERE method = 'pca' AND blend = 1 AND c_acctbal > 0""")
def aligned_points(spark: SparkSession, sf: str) -> DataFrame:
    details = table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    got = B.aligned(_points(spark, sf).where("method = 'pca'").withColumn("pos", F.col("c_custkey")), details, "c_custkey", "pos", 0.8)
    return got.select("c_custkey", F.round("x", 6).alias("x"), "c_name")


@query(f"WITH {POINTS} SELECT method, blend::DOUBLE AS blend, (SELECT count(DISTINCT c_custkey) FROM p) AS n_points FROM p GROUP BY 1, 2")
def projection_kinds(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf)
    total = points.agg(F.countDistinct("c_custkey").alias("n_points"))  # one row
    return points.select("method", "blend").distinct().join(F.broadcast(total))


@query("SELECT l_orderkey, l_linenumber, l_partkey, coalesce(n.name, 'part ' || l_partkey) AS display_name FROM lineitem LEFT JOIN (SELECT p_partkey, p_name AS name FROM part WHERE p_size > 20) n ON l_partkey = p_partkey")
def display_names(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("raw"))
    got = B.display_names(lines, "p_partkey", table(spark, sf, "part").where("p_size > 20"), "p_name", "raw")
    return got.select("l_orderkey", "l_linenumber", F.col("p_partkey").alias("l_partkey"), "display_name")


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE coalesce(nullif(c_mktsegment, 'FURNITURE'), 'HOUSEHOLD') = 'HOUSEHOLD'""")
def kind_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").withColumn("kind", F.nullif("c_mktsegment", F.lit("FURNITURE")))
    return B.of_kind(rows, "kind", "HOUSEHOLD").select("c_custkey", "c_mktsegment")


@query("""SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%l_E%t%' AND p_brand ILIKE '%#1%' ORDER BY p_partkey LIMIT 200""")
def wildcard_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.like(B.like(B.like(table(spark, sf, "part"), "p_name", "l_E%t"), "p_brand", "#1"), "p_type", "")
    return R.page(rows, "p_partkey", False, "p_partkey", 200).select("p_partkey", "p_name", "p_brand")


IDS = "CASE p_partkey % 4 WHEN 0 THEN p_size || 'A' WHEN 1 THEN p_size || 'b' WHEN 2 THEN p_size || '' ELSE 'T' || p_size END"


@query(f"""WITH i AS (SELECT p_partkey, {IDS} AS id FROM part) SELECT p_partkey, id, row_number() OVER (ORDER BY TRY_CAST(nullif(regexp_extract(id, '^([0-9]+)', 1), '') AS BIGINT) NULLS LAST,
  lower(regexp_replace(id, '^[0-9]+', '')), id, p_partkey) AS place FROM i ORDER BY place LIMIT 300""")
def numeric_ids(spark: SparkSession, sf: str) -> DataFrame:
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    ids = F.when(k == 0, F.concat(size, F.lit("A"))).when(k == 1, F.concat(size, F.lit("b"))).when(k == 2, size).otherwise(F.concat(F.lit("T"), size))
    first = table(spark, sf, "part").select("p_partkey", ids.alias("id")).orderBy(*B.id_order("id"), "p_partkey").limit(300)
    # 300 rows
    return first.withColumn("place", F.row_number().over(Window.orderBy(*B.id_order("id"), "p_partkey")).cast("long"))


@query("""SELECT p_partkey, name FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, 'e', 'é') ELSE p_name END AS name FROM part)
  ORDER BY translate(lower(name), 'é', 'e'), lower(name), name, p_partkey LIMIT 250""")
def alphabetical(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.upper("p_name")).when(k == 1, F.replace("p_name", F.lit("e"), F.lit("é"))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", name.alias("name")).orderBy(*B.name_order("name", capitals_first=True), "p_partkey").limit(250)


@query(f"""WITH {LINES}, t AS (SELECT DISTINCT l_orderkey, p_name AS tag FROM lines) SELECT tag, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, tag LIMIT 24""")
def top_tags(spark: SparkSession, sf: str) -> DataFrame:
    tags = order_parts(spark, sf).groupBy("l_orderkey").agg(F.collect_set("p_name").alias("tags"))
    return B.top_tags(tags, "tags", 24)


@query("""WITH m AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b, min(p_size) AS c, max(p_size) AS d FROM part WHERE p_retailprice BETWEEN 900 AND 1600 AND p_size BETWEEN 6 AND 34),
  e AS (SELECT 'p_retailprice' AS axis, least(900.0, a) AS lo, greatest(1600.0, b) AS hi FROM m UNION ALL SELECT 'p_size', least(6.0, c), greatest(34.0, d) FROM m)
  SELECT axis, round((lo - (hi - lo) * 0.08)::DOUBLE, 6) AS low, round((hi + (hi - lo) * 0.08)::DOUBLE, 6) AS high FROM e""")
def axis_domains(spark: SparkSession, sf: str) -> DataFrame:
    box = {"p_retailprice": (1000.0, 1500.0), "p_size": (10.0, 30.0)}
    got = B.domains(R.box_members(table(spark, sf, "part"), box, 0.2), box, 0.2)
    return got.select("axis", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("""WITH t AS (SELECT p_type AS a, p_brand AS b, p_name AS c, string_agg(DISTINCT p_size::VARCHAR, ',' ORDER BY p_size::VARCHAR) AS leaves, count(*) AS k FROM part GROUP BY 1, 2, 3)
  SELECT 0 AS level, 'all' AS path, count(*) AS n, NULL AS leaves FROM part UNION ALL SELECT 1, 'all/' || p_type, count(*), NULL FROM part GROUP BY p_type
  UNION ALL SELECT 2, 'all/' || p_type || '/' || p_brand, count(*), NULL FROM part GROUP BY p_type, p_brand UNION ALL SELECT 3, 'all/' || a || '/' || b || '/' || c, k, leaves FROM t""")
def taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_type", "p_brand", "p_name", "p_size")
    path = ["p_type", "p_brand", "p_name"]
    sizes = parts.groupBy(*path, "p_size").agg(F.count(F.lit(1)).alias("times"))
    items = sizes.groupBy(*path).agg(F.sum("times").alias("times"), F.array_join(F.array_sort(F.collect_set(F.col("p_size").cast("string"))), ",").alias("leaves"))
    return B.tree(items, path, "leaves", "times")


@query("""SELECT count(*) AS n, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.25), 4) AS low, round(quantile_cont(o_totalprice, 0.75), 4) AS high,
  (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_frequent FROM orders""")
def stat_tiles(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    got = orders.agg(F.count(F.lit(1)).alias("n"), F.percentile("o_totalprice", F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75))).alias("q"))
    top = orders.groupBy(F.col("o_orderpriority").alias("most_frequent")).count().orderBy(F.desc("count"), "most_frequent").limit(1).select("most_frequent")
    return got.join(F.broadcast(top)).select("n", *[F.round(F.col("q")[i], 4).alias(c) for i, c in enumerate(("median", "low", "high"))], "most_frequent")  # one row each


@query(f"""WITH {LINES}, r AS (SELECT o_orderpriority AS f, l_orderkey AS g, p_type AS c, l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) * 100 AS pct FROM lines JOIN orders ON l_orderkey = o_orderkey),
  n AS (SELECT f, count(DISTINCT g) AS n FROM r GROUP BY 1 HAVING count(DISTINCT g) >= 5)
  SELECT f AS family, any_value(n) AS n, round((sum(pct) FILTER (WHERE c IN ('SMALL', 'PROMO'))) / any_value(n), 6) AS dark FROM r JOIN n USING (f) GROUP BY 1""")
def dark_families(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_orders(U.ratio_to_total(order_parts(spark, sf, by_order=True), "l_orderkey", "l_quantity"), spark, sf).withColumnRenamed("o_orderpriority", "family")
    n = rows.groupBy("family").agg(F.countDistinct("l_orderkey").alias("n")).where("n >= 5")
    dark = U.zero_filled_share(rows, "family", "l_orderkey", "p_type", "pct").where("p_type in ('SMALL', 'PROMO')").groupBy("family").agg(F.sum("mean_share").alias("dark"))
    return n.join(dark, "family").select("family", "n", F.round("dark", 6).alias("dark")).orderBy("dark", "family")


@query("""WITH d AS (SELECT c_nationkey AS k, count(*) AS n, avg(c_acctbal) AS v FROM customer GROUP BY 1), f AS (SELECT * FROM d ORDER BY n DESC, k LIMIT 12) SELECT k, n, round(v, 4) AS v FROM f""")
def first_then_sort(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("v"))
    return B.first_then_sort(rows, [F.desc("n"), F.col("k")], 12, [F.desc("v"), F.col("k")]).withColumn("v", F.round("v", 4))


@query("""WITH s AS (SELECT p_partkey, p_size, p_retailprice, max(p_size) OVER () AS m, min(p_retailprice) OVER () AS a, max(p_retailprice) OVER () AS b FROM part)
  SELECT p_partkey, round(log10(1 + p_size) / log10(1 + greatest(m, 1)), 9) AS x, round((p_retailprice - a) / (b - a), 9) AS y, least(p_size, 45) AS capped, least(greatest(p_size * 2, 55), 95) AS clamped FROM s""")
def scatter_scale(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.spread_out(B.spread_out(table(spark, sf, "part"), "p_size", "x", log=True), "p_retailprice", "y")
    return rows.select("p_partkey", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), F.least("p_size", F.lit(45)).alias("capped"), F.least(F.greatest(F.col("p_size") * 2, F.lit(55)), F.lit(95)).alias("clamped"))


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN p_size * 30.0 END AS lo, p_size * 30.0 + p_partkey % 7 AS hi FROM part),
  g AS (SELECT p_partkey, (CASE WHEN lo > 2 THEN lo / 1000 ELSE lo END) AS a, (CASE WHEN hi > 2 THEN hi / 1000 ELSE hi END) AS b FROM p WHERE lo IS NOT NULL)
  SELECT p_partkey, round(a::DOUBLE, 9) AS lo, round(b::DOUBLE, 9) AS hi, CASE WHEN p_partkey IN (SELECT p_partkey FROM g) THEN
    CASE WHEN a = b THEN printf('%.3f', a::DOUBLE) ELSE printf('%.3f', a::DOUBLE) || '–' || printf('%.3f', b::DOUBLE) END || ' SG' ELSE '—' END AS shown FROM p LEFT JOIN g USING (p_partkey)""")
def range_texts(spark: SparkSession, sf: str) -> DataFrame:
    lo = F.when(F.col("p_size") % 5 > 0, F.col("p_size") * 30.0)
    box = units.gravity_range(lo, F.col("p_size") * 30.0 + F.col("p_partkey") % 7)
    rows = table(spark, sf, "part").select("p_partkey", box.alias("r"))
    return rows.select("p_partkey", F.round("r.lo", 9).alias("lo"), F.round("r.hi", 9).alias("hi"), units.range_text(F.col("r"), 3, " SG").alias("shown"))


@query("""SELECT p_partkey, CASE WHEN b IS NULL THEN '—' WHEN abs(b - a) < 0.05 THEN '=' ELSE CASE WHEN b > a THEN '+' ELSE '-' END || printf('%.1f', abs(b - a)::DOUBLE) END AS delta
  FROM (SELECT p_partkey, p_size / 10.0 AS a, CASE WHEN p_partkey % 6 > 0 THEN (p_size + p_partkey % 5 - 2) / 10.0 END AS b FROM part)""")
def deltas(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("p_size") / 10.0, F.when(F.col("p_partkey") % 6 > 0, (F.col("p_size") + F.col("p_partkey") % 5 - 2) / 10.0)
    return table(spark, sf, "part").select("p_partkey", units.difference(a, b).alias("delta"))


def _ramp(share: str, first: tuple, second: tuple, power: str = "1") -> str:
    return "'#' || " + " || ".join(f"printf('%02x', floor({a} + ({b} - {a}) * pow(least(greatest({share}, 0), 1), {power}) + 0.5)::INT)" for a, b in zip(first, second, strict=True))


@query(f"""SELECT p_partkey, {_ramp('(p_size - 5) / 40.0', *units.STRENGTH_RAMP)} AS strength, {_ramp('p_size / 50.0', *units.SIMILARITY_RAMP[:2], power='1.35')} AS similarity FROM part""")
def colour_ramps(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    return table(spark, sf, "part").select("p_partkey", units.strength_colour(size, F.lit(5.0), F.lit(45.0)).alias("strength"), units.similarity_colour(size / 50).alias("similarity"))


@query(r"""SELECT page_id, lower(regexp_replace(trim(regexp_replace(url, '[^a-zA-Z0-9 _-]', '', 'g')), '\s+', '-', 'g')) AS file, substr(html, 1, 260) AS head, TRY_CAST(right(url, 4) AS INT) AS year,
  coalesce(nullif(regexp_extract(html, '(?i)href="([^"]*tion[^"]*)"', 1), ''), NULL) AS raw FROM pages""")
def page_names(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    raw = F.nullif(F.regexp_extract("html", '(?i)href="([^"]*tion[^"]*)"', 1), F.lit(""))
    return pages.select("page_id", text.file_name(F.col("url")).alias("file"), text.shortened(F.col("html")).alias("head"), text.last_year(F.col("url")).alias("year"), raw.alias("raw"))


@query(r"""SELECT page_id, coalesce(CASE WHEN l = '' THEN NULL WHEN l LIKE 'http%' THEN l ELSE 'http://site' || l END, 'http://site/homebrew/recipe/the1.0/' || page_id) AS link
  FROM (SELECT page_id, regexp_extract(html, '(?i)href="([^"]*the[^"]*)"', 1) AS l FROM pages)""")
def export_links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.export_link(F.col("html"), F.col("page_id").cast("string"), "http://site", "the").alias("link"))


@query(r"""WITH n AS (SELECT p_partkey, p_size, 'HBC ' || p_size || '® ' || p_name AS a, CASE p_partkey % 4 WHEN 0 THEN 'East Kent Goldings' WHEN 1 THEN 'Zeus™' WHEN 2 THEN 'Golding' ELSE 'Yqh  ' || p_size END AS b FROM part)
  SELECT p_partkey, 'hbc' || p_size || ' ' || split_part(a, '® ', 2) AS first, CASE b WHEN 'East Kent Goldings' THEN 'east kent golding' WHEN 'Zeus™' THEN 'ctz' WHEN 'Golding' THEN 'goldings' ELSE 'yqh' || substr(b, 6) END AS second FROM n""")
def producer_names(spark: SparkSession, sf: str) -> DataFrame:
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    other = F.when(k == 0, "East Kent Goldings").when(k == 1, "Zeus™").when(k == 2, "Golding").otherwise(F.concat(F.lit("Yqh  "), size))
    first = F.concat(F.lit("HBC "), size, F.lit("® "), "p_name")
    return table(spark, sf, "part").select("p_partkey", domain.producer_name(first).alias("first"), domain.producer_name(other).alias("second"))


def _case(text: str, rules: list[tuple[str, str]]) -> str:
    return " ".join(f"WHEN regexp_matches({text}, '(?i){p}') THEN '{n}'" for n, p in rules)


STYLES = """s AS (SELECT p_partkey, CASE p_size % 10 WHEN 0 THEN 'Black Pale Ale' WHEN 1 THEN 'Wild Bock' WHEN 2 THEN 'Dunkel' WHEN 3 THEN 'Oat Porter' WHEN 4 THEN 'Caramel Weizen' WHEN 5 THEN 'Saison'
  WHEN 6 THEN 'Candi Tripel' WHEN 7 THEN 'Rauch Lager' WHEN 8 THEN 'Irish Red Ale' ELSE 'Fruit' END || ' ' || p_name AS name, CASE WHEN p_size % 4 = 0 THEN ['bottom-fermented'] WHEN p_size % 7 = 0 THEN ['x', 'top-fermented'] ELSE [] END AS tags FROM part)"""


@query(f"""WITH {STYLES} SELECT p_partkey, CASE WHEN list_contains(tags, 'wild-fermented') THEN 'Wild & sour' WHEN list_contains(tags, 'bottom-fermented') THEN 'Lager' WHEN list_contains(tags, 'top-fermented') THEN 'Ale'
    {_case("name || ' spring'", domain.FERMENTATION_WORDS)} ELSE 'Any yeast / specialty' END AS fermentation,
  CASE {_case("name", domain.MALT_CLASSES)} ELSE 'other' END AS malt, CASE {_case("name", domain.FAMILIES)} ELSE 'other' END AS family FROM s""")
def style_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule of fermentation, malt class and family over made-up names."""
    rest = F.col("p_size") % 10
    first = F.when(rest == 0, "Black Pale Ale")
    for i, n in enumerate(["Wild Bock", "Dunkel", "Oat Porter", "Caramel Weizen", "Saison", "Candi Tripel", "Rauch Lager", "Irish Red Ale", "Fruit"], 1):
        first = first.when(rest == i, n)
    tags = F.when(F.col("p_size") % 4 == 0, F.array(F.lit("bottom-fermented"))).when(F.col("p_size") % 7 == 0, F.array(F.lit("x"), F.lit("top-fermented"))).otherwise(F.expr("cast(array() as array<string>)"))
    rows = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", first, "p_name").alias("name"), tags.alias("tags"))
    return rows.select("p_partkey", domain.fermentation(F.col("tags"), F.col("name"), F.lit("spring")).alias("fermentation"), domain.malt_class(F.col("name")).alias("malt"), domain.family(F.col("name")).alias("family"))


WORDS = "list_value(" + ", ".join(f"'{w}'" for w in ("bready", "citrusy lemon", "very smooth", "funky barnyard", "dry finish", "grape and port", "peppery hops", "banana", "rich", "salty")) + ")"


@query(f"""WITH d AS (SELECT p_partkey, p_name || ' ' || ({WORDS})[p_size % 10 + 1] AS aroma, ({WORDS})[p_partkey % 10 + 1] AS flavor FROM part),
  s AS (SELECT p_partkey, n, f, regexp_matches(lower(aroma), p)::INT + regexp_matches(lower(flavor), p)::INT AS strength FROM d, (VALUES {", ".join(f"('{f}', '{n}', '{p}')" for f, n, p in domain.LEXICON)}) t(f, n, p))
  SELECT p_partkey, f AS family, n AS name, strength FROM s WHERE strength > 0""")
def descriptors(spark: SparkSession, sf: str) -> DataFrame:
    """The whole lexicon over two prose fields."""
    words = F.array(*[F.lit(w) for w in ("bready", "citrusy lemon", "very smooth", "funky barnyard", "dry finish", "grape and port", "peppery hops", "banana", "rich", "salty")])
    pick = lambda k: F.element_at(words, (F.col(k) % 10 + 1).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", pick("p_size")).alias("aroma"), pick("p_partkey").alias("flavor"))
    return rows.select("p_partkey", F.explode(domain.descriptors(F.col("aroma"), F.col("flavor"))).alias("d")).select("p_partkey", "d.*")


GUIDES_SQL = """a AS (SELECT p_name || ' ' || p_brand AS id, min(p_retailprice) AS x, min(p_size) AS y FROM part WHERE p_partkey % 5 < 3 GROUP BY 1), b AS (SELECT p_name || ' ' || p_brand AS id, min(p_retailprice) AS x, max(p_size) AS y FROM part WHERE p_partkey % 5 > 1 GROUP BY 1)"""


@query(f"""WITH {GUIDES_SQL} SELECT id, CASE WHEN abs(a.x - b.x) >= 0.05 OR abs(a.y - b.y) >= 0.05 THEN 'changed' ELSE 'same' END AS change FROM a JOIN b USING (id)
  UNION ALL SELECT id, 'removed' FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'added' FROM b WHERE id NOT IN (SELECT id FROM a)""")
def guide_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Two editions of a list: what is the same, changed, removed and added."""
    parts = table(spark, sf, "part").withColumn("id", F.concat_ws(" ", "p_name", "p_brand"))
    a = parts.where("p_partkey % 5 < 3").groupBy("id").agg(F.min("p_retailprice").alias("x"), F.min("p_size").alias("y"))
    b = parts.where("p_partkey % 5 > 1").groupBy("id").agg(F.min("p_retailprice").alias("x"), F.max("p_size").alias("y"))
    return corpus.edition_difference(a, b, "id", ["x", "y"])
