"""Roll-ups, pages and pairs over orders and their lines: an order is a document, its lines are the bill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import rollups as U
from .tables import Registry, order_parts, table, with_orders

REGISTRY = Registry()
query = REGISTRY.add

LINES = """lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag, p_brand, p_type, p_name
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query("SELECT o_orderkey, o_orderstatus, o_totalprice AS og, year(o_orderdate)::INTEGER AS year FROM orders")
def flatten_struct(spark: SparkSession, sf: str) -> DataFrame:
    nested = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.struct(F.col("o_totalprice").alias("og"), F.year("o_orderdate").alias("year")).alias("vitals"))
    return R.flatten_struct(nested, "vitals", ["og", "year"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem")
def explode_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    nested = R.nest(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity")], "lines")
    return R.unnest(nested, "lines", ["l_orderkey"])


@query(f"WITH {LINES} SELECT lower(trim(p_name)) AS item, min(p_type) AS class, count(DISTINCT l_orderkey) AS n_groups FROM lines GROUP BY 1")
def dim_any_value(spark: SparkSession, sf: str) -> DataFrame:
    rows = order_parts(spark, sf, by_order=True).withColumn("item", F.lower(F.trim("p_name")))
    return U.usage(rows, "item", "l_orderkey", **{"class": F.min("p_type")})


@query(f"WITH {LINES} SELECT p_brand, count(DISTINCT l_orderkey) AS n_groups, round(avg(l_quantity), 6) AS avg_quantity FROM lines GROUP BY 1")
def usage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return U.usage(order_parts(spark, sf, by_order=True), "p_brand", "l_orderkey", avg_quantity=F.round(F.avg("l_quantity"), 6))


@query(f"""WITH {LINES} SELECT o_orderpriority, p_type, count(DISTINCT l_orderkey) AS n_groups, round(avg(l_quantity), 6) AS avg_quantity
  FROM lines JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def class_by_family(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_orders(order_parts(spark, sf, by_order=True), spark, sf)
    return rows.groupBy("o_orderpriority", "p_type").agg(F.countDistinct("l_orderkey").alias("n_groups"), F.round(F.avg("l_quantity"), 6).alias("avg_quantity"))


@query(f"""WITH {LINES}, c AS (SELECT p_brand, l_returnflag, count(*) AS n FROM lines GROUP BY 1, 2)
  SELECT p_brand, l_returnflag FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, l_returnflag) = 1""")
def usage_mode(spark: SparkSession, sf: str) -> DataFrame:
    return U.mode_by(order_parts(spark, sf), ["p_brand"], "l_returnflag")


PAIRS = f"""WITH {LINES}, m AS (SELECT DISTINCT l_orderkey, p_brand FROM lines),
  p AS (SELECT x.p_brand AS a, y.p_brand AS b, count(*) AS n FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.p_brand < y.p_brand GROUP BY 1, 2)"""


@query(PAIRS + " SELECT a, b, n FROM p WHERE n >= 2")
def pair_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.pair_counts(R.distinct_members(order_parts(spark, sf), "l_orderkey", "p_brand"), "l_orderkey", "p_brand", 2)


@query(PAIRS + """, s AS (SELECT p_brand, count(*) AS k FROM m GROUP BY 1), t AS (SELECT count(DISTINCT l_orderkey) AS total FROM m)
  SELECT a, b, n, u.k AS n_a, v.k AS n_b, total, round(n * total / (u.k * v.k), 9) AS lift
  FROM p JOIN s u ON a = u.p_brand JOIN s v ON b = v.p_brand, t WHERE n >= 20""")
def pair_lift(spark: SparkSession, sf: str) -> DataFrame:
    members = R.distinct_members(order_parts(spark, sf), "l_orderkey", "p_brand")
    return R.pair_lift(members, "l_orderkey", "p_brand", 20).withColumn("lift", F.round("lift", 9))


@query("""SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS avg_price, min(o_totalprice) AS min_price, max(o_totalprice) AS max_price
  FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1""")
def family_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").where("o_totalprice is not null")
    return rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("avg_price"), F.min("o_totalprice").alias("min_price"), F.max("o_totalprice").alias("max_price"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def origin_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT (SELECT count(*) FROM orders) AS n_orders, (SELECT count(*) FROM lineitem) AS n_lines,
  (SELECT count(DISTINCT p_brand) FROM part) AS n_brands, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS n_families""")
def meta_counts(spark: SparkSession, sf: str) -> DataFrame:
    one = [
        table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n_orders"), F.countDistinct("o_orderpriority").alias("n_families")),
        table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n_lines")),
        table(spark, sf, "part").agg(F.countDistinct("p_brand").alias("n_brands")),
    ]
    # each side is one row by construction
    return one[0].join(F.broadcast(one[1])).join(F.broadcast(one[2])).select("n_orders", "n_lines", "n_brands", "n_families")


@query("""SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders
  WHERE o_totalprice >= 20000 AND o_totalprice <= 300000 AND o_orderstatus = 'F' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100 OFFSET 50""")
def filter_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.range_filters(table(spark, sf, "orders"), {"o_totalprice": (20000, "300000"), "o_custkey": (None, "")}).where("o_orderstatus = 'F'")
    return R.page(rows, "o_totalprice", True, "o_orderkey", 100, 50).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


@query("SELECT count(*) AS total FROM orders WHERE o_totalprice >= 20000 AND o_totalprice <= 300000 AND o_orderstatus = 'F'")
def filter_total(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.range_filters(table(spark, sf, "orders"), {"o_totalprice": (20000, 300000)}).where("o_orderstatus = 'F'")
    return rows.agg(F.count(F.lit(1)).alias("total"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(o_orderkey::VARCHAR), o_orderkey LIMIT 500")
def stable_sample(spark: SparkSession, sf: str) -> DataFrame:
    return R.stable_sample(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500)


@query(f"""WITH {LINES} SELECT o_orderkey, o_orderpriority, count(*) AS n_lines,
  string_agg(l_linenumber || ':' || p_brand, ',' ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS bill
  FROM lines JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def detail_nested(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_orders(order_parts(spark, sf, by_order=True), spark, sf).withColumnRenamed("l_orderkey", "o_orderkey")
    nested = R.nest(rows, ["o_orderkey", "o_orderpriority"], ["l_linenumber", "p_brand"], [-F.col("l_quantity"), F.col("l_linenumber"), F.col("l_partkey")], "lines")
    return nested.select("o_orderkey", "o_orderpriority", F.size("lines").cast("long").alias("n_lines"), F.array_join(F.transform("lines", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["p_brand"])), ",").alias("bill"))


@query(f"""WITH {LINES}, e AS (SELECT o_orderpriority AS f, l_orderkey AS g, lower(trim(p_name)) AS i, l_orderkey % 7 AS batch, sum(l_quantity) AS amount, sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS x,
    sum(l_quantity) FILTER (WHERE l_returnflag = 'N') AS y, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS z FROM lines JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
  b AS (SELECT * FROM e UNION ALL SELECT 'all', g, i, batch, amount, x, y, z FROM e)
  SELECT f AS family, i AS item, count(*) AS n_groups, round(sum(amount), 6) AS total, sum(x) AS in_a, sum(y) AS in_n, sum(z) AS in_r,
    round((list_sort(list(amount / batch) FILTER (WHERE batch > 0)))[(count(*) FILTER (WHERE batch > 0) // 2 + 1)::INT], 6) AS median_dose
  FROM b GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY f ORDER BY n_groups DESC, i) <= 40""")
def leaderboard_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_orders(order_parts(spark, sf, by_order=True), spark, sf).withColumnRenamed("o_orderpriority", "family")
    rows = rows.withColumn("item", F.lower(F.trim("p_name"))).withColumn("batch", F.col("l_orderkey") % 7)
    board = U.leaderboard(rows, "family", "l_orderkey", "item", "l_returnflag", ["A", "N", "R"], "l_quantity", "batch")
    stages = [F.col(s).alias(f"in_{s.lower()}") for s in "ANR"]
    return board.select("family", "item", "n_groups", F.round("total", 6).alias("total"), *stages, F.round("median_dose", 6).alias("median_dose"))


@query(f"""WITH {LINES}, r AS (SELECT o_orderpriority AS f, l_orderkey AS g, p_type AS c, l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) * 100 AS pct
    FROM lines JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT f, count(DISTINCT g) AS n_groups FROM r GROUP BY 1)
  SELECT f AS family, c AS class, count(DISTINCT g) AS n_with, round(sum(pct) / any_value(n_groups), 6) AS mean_share FROM r JOIN n USING (f) GROUP BY 1, 2""")
def grist_zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_orders(U.ratio_to_total(order_parts(spark, sf, by_order=True), "l_orderkey", "l_quantity"), spark, sf).withColumnsRenamed({"o_orderpriority": "family", "p_type": "class"})
    return U.zero_filled_share(rows, "family", "l_orderkey", "class", "pct").withColumn("mean_share", F.round("mean_share", 6))


HISTOGRAM = """h AS (SELECT least(greatest(floor((o_totalprice - 10000) / 20000.0), 0), 9)::INTEGER AS bin, count(*) AS n FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1),
  b AS (SELECT i::INTEGER AS bin, coalesce(n, 0)::BIGINT AS n FROM range(10) t(i) LEFT JOIN h ON bin = i)"""


@query(f"WITH {HISTOGRAM} SELECT bin, 10000.0::DOUBLE + bin * 20000.0::DOUBLE AS bin_low, n FROM b")
def histogram_clamped(spark: SparkSession, sf: str) -> DataFrame:
    return U.histogram(table(spark, sf, "orders"), "o_totalprice", 10_000.0, 210_000.0, 20_000.0)


@query(f"WITH {HISTOGRAM} SELECT round(sum(n * least(greatest((123456.0 - 10000) / 20000 - bin, 0), 1)) / sum(n) * 100, 6)::DOUBLE AS percentile FROM b")
def percentile_of_value(spark: SparkSession, sf: str) -> DataFrame:
    return U.percentile_of(histogram_clamped(spark, sf), 123_456.0, 10_000.0, 20_000.0).select(F.round("percentile", 6).alias("percentile"))


@query("""SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.05), 4) AS p5, round(quantile_cont(o_totalprice, 0.25), 4) AS p25,
  round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.75), 4) AS p75, round(quantile_cont(o_totalprice, 0.95), 4) AS p95 FROM orders GROUP BY 1""")
def quantiles(spark: SparkSession, sf: str) -> DataFrame:
    got = U.quantiles(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", [0.05, 0.25, 0.5, 0.75, 0.95])
    return got.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in got.columns[1:]])


@query(f"""WITH {LINES}, q AS (SELECT p_type AS t, quantile_cont(l_quantity, 0.25) AS qlo, quantile_cont(l_quantity, 0.75) AS qhi,
    quantile_cont(l_extendedprice, 0.25) AS elo, quantile_cont(l_extendedprice, 0.75) AS ehi FROM lines GROUP BY 1)
  SELECT o_orderpriority, count(*) AS n, round(avg((l_quantity - (qlo + qhi) / 2) / ((qhi - qlo) / 2)), 6) AS l_quantity_dev,
    round(avg((l_extendedprice - (elo + ehi) / 2) / ((ehi - elo) / 2)), 6) AS l_extendedprice_dev
  FROM lines JOIN q ON p_type = t JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(*) >= 30""")
def deviation(spark: SparkSession, sf: str) -> DataFrame:
    lines = order_parts(spark, sf)
    boxes = lines.groupBy(F.col("p_type").alias("t")).agg(F.percentile("l_quantity", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.percentile("l_extendedprice", F.array(F.lit(0.25), F.lit(0.75))).alias("e"))
    boxes = boxes.select("t", F.col("q")[0].alias("qlo"), F.col("q")[1].alias("qhi"), F.col("e")[0].alias("elo"), F.col("e")[1].alias("ehi"))
    rows = with_orders(lines.join(boxes, F.col("p_type") == F.col("t")), spark, sf)
    got = U.deviation(rows, "o_orderpriority", [("l_quantity", "qlo", "qhi"), ("l_extendedprice", "elo", "ehi")], 30)
    return got.select("o_orderpriority", "n", *[F.round(c, 6).alias(c) for c in ("l_quantity_dev", "l_extendedprice_dev")])


@query(f"""WITH {LINES}, c AS (SELECT upper(regexp_extract(p_brand, '([0-9]+)', 1)) AS code, p_brand, l_orderkey, l_quantity FROM lines),
  m AS (SELECT code, p_brand, count(*) AS n FROM c GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY code ORDER BY n DESC, p_brand) = 1)
  SELECT code, m.p_brand AS name, count(DISTINCT l_orderkey) AS n_groups, round(quantile_cont(l_quantity, 0.5), 6) AS median_quantity
  FROM c JOIN m USING (code) GROUP BY 1, 2 ORDER BY n_groups DESC, code LIMIT 15""")
def code_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    rows = order_parts(spark, sf).withColumn("code", F.upper(F.regexp_extract("p_brand", "([0-9]+)", 1)))
    names = U.mode_by(rows, ["code"], "p_brand").withColumnRenamed("p_brand", "name")
    got = U.usage(rows, "code", "l_orderkey", median_quantity=F.round(F.percentile("l_quantity", F.lit(0.5)), 6))
    return R.page(got.join(names, "code"), "n_groups", True, "code", 15).select("code", "name", "n_groups", "median_quantity")


@query(f"""WITH {LINES}, t AS (SELECT DISTINCT l_orderkey, p_name AS tag FROM lines) SELECT tag, count(*) AS n FROM t GROUP BY 1 HAVING count(*) >= 2""")
def vocab_min_count(spark: SparkSession, sf: str) -> DataFrame:
    tags = order_parts(spark, sf).groupBy("l_orderkey").agg(F.collect_set("p_name").alias("tags"))
    return U.vocabulary(tags, "tags", 2)


@query(f"""WITH {LINES}, t AS (SELECT DISTINCT o_orderpriority AS c, l_orderkey AS id, p_brand AS tag FROM lines JOIN orders ON l_orderkey = o_orderkey),
  s AS (SELECT c, count(DISTINCT id) AS size FROM t GROUP BY 1), g AS (SELECT count(DISTINCT id) AS total FROM t),
  o AS (SELECT tag, count(*) AS n_all FROM t GROUP BY 1), i AS (SELECT c, tag, count(*) AS n FROM t GROUP BY 1, 2),
  l AS (SELECT c, tag, round((n / size) / (n_all / total), 9) AS lift FROM i JOIN s USING (c) JOIN o USING (tag), g WHERE n >= greatest(2, size / 50.0)),
  r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY lift DESC, tag) AS k FROM l)
  SELECT s.c AS cluster, size, coalesce(string_agg(tag, ' · ' ORDER BY k) FILTER (WHERE k <= 3), 'mixed') AS label FROM s LEFT JOIN r ON s.c = r.c GROUP BY 1, 2""")
def cluster_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_orders(order_parts(spark, sf, by_order=True), spark, sf)
    members = rows.groupBy(F.col("o_orderpriority").alias("cluster"), "l_orderkey").agg(F.collect_set("p_brand").alias("tags"))
    return U.cluster_labels(members, "cluster", "tags", share=50)


BOXES = [("economy", 900.0, 1100.0, 1, 20), ("large", 1000.0, 1600.0, 25, 50), ("middle", 1100.0, 1500.0, 10, 30), ("premium", 1500.0, 2100.0, 5, 45)]
BOXES_SQL = "boxes(name, plo, phi, slo, shi) AS (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}, {d})" for n, a, b, c, d in BOXES) + ")"


@query(f"""WITH {BOXES_SQL}, f AS (SELECT p_partkey, name,
    (p_retailprice BETWEEN plo AND phi)::INT + (p_size BETWEEN slo AND shi)::INT AS inside,
    (abs(p_retailprice - (plo + phi) / 2) / ((phi - plo) / 2) + abs(p_size - (slo + shi) / 2) / ((shi - slo) / 2)) / 2 AS off FROM part, boxes)
  SELECT p_partkey, name, inside, round(off, 9) AS off FROM f QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY inside DESC, off, name) = 1""")
def range_best_fit(spark: SparkSession, sf: str) -> DataFrame:
    boxes = spark.createDataFrame([(n, a, b, float(c), float(d)) for n, a, b, c, d in BOXES], "name string, p_retailprice_lo double, p_retailprice_hi double, p_size_lo double, p_size_hi double")
    got = R.best_fit(table(spark, sf, "part"), "p_partkey", boxes, ["p_retailprice", "p_size"], "name")
    return got.withColumn("off", F.round("off", 9))


@query("""SELECT p_partkey, (p_retailprice BETWEEN 1000 AND 1500)::INT + (p_size BETWEEN 10 AND 30)::INT AS fit FROM part
  WHERE p_retailprice BETWEEN 900 AND 1600 AND p_size BETWEEN 6 AND 34""")
def box_membership(spark: SparkSession, sf: str) -> DataFrame:
    return R.box_members(table(spark, sf, "part"), {"p_retailprice": (1000.0, 1500.0), "p_size": (10.0, 30.0)}, 0.2).select("p_partkey", "fit")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN s > 0 THEN l_quantity / s * 100 ELSE 0 END, 6) AS pct FROM (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS s FROM lineitem)")
def ratio_to_total(spark: SparkSession, sf: str) -> DataFrame:
    return U.ratio_to_total(table(spark, sf, "lineitem"), "l_orderkey", "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", F.round("pct", 6).alias("pct"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def anti_sets(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return R.only_in(table(spark, sf, "customer").select("c_custkey"), orders, ["c_custkey"])


@query("""SELECT c_custkey AS id, c_name AS name, 'first' AS origin FROM customer UNION ALL SELECT s_suppkey + 100000, s_name, 'second' FROM supplier""")
def union_rekey(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return R.union_rekeyed(a, b, "id", 100_000)


@query("""SELECT r_name || '/' || n_name AS path, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1
  UNION ALL SELECT r_name, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1
  UNION ALL SELECT 'all', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def tree_paths(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    tree = rows.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    path = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, F.col("r_name")).otherwise(F.concat_ws("/", "r_name", "n_name"))
    return tree.select(path.alias("path"), "n")


@query("SELECT p_partkey, p_name FROM part WHERE p_brand ILIKE '%#1%' OR p_name ILIKE '%AL%' ORDER BY p_name, p_partkey LIMIT 60")
def text_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.search_text(table(spark, sf, "part"), "#1", ["p_brand"]).unionByName(R.search_text(table(spark, sf, "part"), "AL", ["p_name"])).distinct()
    return R.page(rows, "p_name", False, "p_partkey", 60).select("p_partkey", "p_name")


@query("""SELECT event_type, user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 8""")
def top_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return U.top_by(table(spark, sf, "events"), ["event_type"], [F.desc("value"), F.col("event_id")], 8).select("event_type", "user_id", "event_id", "value")
