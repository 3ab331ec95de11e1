"""Similarity, feature spaces and clusters over embeddings and parts.

Searches take as queries every row whose id is divisible by 50, against all rows; joins and scores take all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.units import SRM_RGB, colour_hex
from ..operators import clusters, features
from ..operators import similarity as S
from .tables import Registry, order_parts, table, with_orders

REGISTRY = Registry()
query = REGISTRY.add

VECTORS = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)"
COSINE = """s AS (SELECT a.id AS query_id, b.id AS id, round(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))), 9) AS score
  FROM v a, v b WHERE a.id % 50 = 0 AND a.id <> b.id)"""


@query(f"WITH {VECTORS}, {COSINE} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM s QUALIFY rank <= 5")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return S.cosine_search(table(spark, sf, "embeddings"), F.col("id") % 50 == 0, "vec_id", "embedding", 5)


@query(f"""WITH {VECTORS}, d AS (SELECT a.id AS query_id, b.id AS id, list_distance(a.e, b.e) AS d, (a.label % 3 = b.label % 3)::INT AS j FROM v a, v b WHERE a.id % 50 = 0),
  p AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS place FROM d),
  c AS (SELECT query_id, max(d) AS scale FROM p WHERE place = floor(n * 0.95) + 1 GROUP BY 1),
  s AS (SELECT query_id, id, round(0.5 * j + 0.5 * greatest(0, 1 - d / scale), 9) AS score FROM p JOIN c USING (query_id) WHERE query_id <> id)
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM s QUALIFY rank <= 15""")
def blend_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").withColumn("tags", F.array((F.col("label") % 3).cast("string")))
    return S.blend_search(rows, F.col("id") % 50 == 0, "vec_id", "embedding", "tags", 0.5, 15)


@query(f"""WITH {VECTORS}, c AS (SELECT e, min(id) AS id, count(*) AS n FROM v GROUP BY e),
  s AS (SELECT a.id AS a, b.id AS b, a.n AS n_a, b.n AS n_b, round(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))), 9) AS score FROM c a JOIN c b ON a.id < b.id)
  SELECT a, b, n_a, n_b, round((score - 0.3) / (1 - 0.3), 9) AS weight FROM s WHERE score >= 0.3""")
def threshold_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between classes of equal vectors, with the sizes of both."""
    classes = S.vector_classes(table(spark, sf, "embeddings"), "vec_id", "embedding")
    near = S.cosine_join(classes, 0.3).withColumn("score", F.round("score", 9))
    edges = S.threshold_edges(near, "a", "b", "score", 0.3)
    n_a, n_b = (classes.select(F.col("rep").alias(x), F.col("size").alias(f"n_{x}")) for x in "ab")
    return edges.join(n_a, "a").join(n_b, "b").select("a", "b", "n_a", "n_b", F.round("weight", 9).alias("weight"))


@query("""WITH s AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(l_partkey))) AS s FROM lineitem GROUP BY 1) SELECT k, min(k) OVER (PARTITION BY s) AS rep FROM s""")
def set_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the same parts, by their least key."""
    return S.set_classes(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")


SILHOUETTE = f"""WITH {VECTORS}, d AS (SELECT a.id AS query_id, a.label AS own, b.label, avg(list_distance(a.e, b.e)) AS d FROM v a JOIN v b ON a.id <> b.id GROUP BY 1, 2, 3),
  s AS (SELECT query_id, min(d) FILTER (WHERE own = label) AS a, min(d) FILTER (WHERE own <> label) AS b FROM d GROUP BY 1)"""


@query(f"{SILHOUETTE} SELECT query_id AS vec_id, round((b - a) / greatest(a, b), 6) AS silhouette FROM s WHERE a IS NOT NULL AND b IS NOT NULL")
def silhouette(spark: SparkSession, sf: str) -> DataFrame:
    got = S.silhouettes(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    return got.withColumn("silhouette", F.round("silhouette", 6))


@query(f"{SILHOUETTE} SELECT count(*) AS n, round(avg((b - a) / greatest(a, b)), 6) AS mean_silhouette FROM s WHERE a IS NOT NULL AND b IS NOT NULL")
def mean_silhouette(spark: SparkSession, sf: str) -> DataFrame:
    got = S.mean_silhouette(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    return got.withColumn("mean_silhouette", F.round("mean_silhouette", 6))


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS m FROM lineitem), b AS (SELECT k, count(*) AS n, list_sort(list(m)) AS s FROM m GROUP BY 1), r AS (SELECT s, min(k) AS k FROM b GROUP BY 1),
  n AS (SELECT r.k, b.n FROM r JOIN b USING (k)), f AS (SELECT m.* FROM m JOIN n USING (k)), p AS (SELECT x.k AS a, y.k AS b, count(*) AS c FROM f x JOIN f y ON x.m = y.m AND x.k < y.k GROUP BY 1, 2)
  SELECT a, b, round(c / (u.n + v.n - c), 9) AS jaccard FROM p JOIN n u ON a = u.k JOIN n v ON b = v.k WHERE c / (u.n + v.n - c) >= 0.5""")
def jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that share half of their parts or more, of all orders."""
    return S.jaccard_pairs(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey", 0.5).withColumn("jaccard", F.round("jaccard", 9))


@query(f"""WITH l AS (SELECT o_orderpriority AS f, p_brand AS i, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
  s AS (SELECT f AS family, i AS item, round(n * sum(n) OVER () / (sum(n) OVER (PARTITION BY f) * sum(n) OVER (PARTITION BY i)), 9) AS score FROM l)
  SELECT 'item of family' AS direction, *, row_number() OVER (PARTITION BY family ORDER BY score DESC, item)::INTEGER AS rank FROM s QUALIFY rank <= 12
  UNION ALL SELECT 'family of item', *, row_number() OVER (PARTITION BY item ORDER BY score DESC, family)::INTEGER AS rank FROM s QUALIFY rank <= 3""")
def pairing_both_ways(spark: SparkSession, sf: str) -> DataFrame:
    """The items that suit each family best, and the families that suit each item best, by lift."""
    rows = with_orders(order_parts(spark, sf), spark, sf).withColumnsRenamed({"o_orderpriority": "family", "p_brand": "item"})
    n = rows.groupBy("family", "item").agg(F.count(F.lit(1)).alias("n"))
    of = lambda k: n.groupBy(k).agg(F.sum("n").alias(f"n_{k}"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    scored = n.join(of("family"), "family").join(of("item"), "item").join(F.broadcast(total))
    scored = scored.select("family", "item", F.round(F.col("n") * F.col("total") / (F.col("n_family") * F.col("n_item")), 9).alias("score"))
    return S.top_both_ways(scored, "family", "item", "score", 12, 3)


@query("""WITH b AS (SELECT p_brand AS brand, [avg(p_retailprice) / 500, avg(p_size) / 10] AS v FROM part GROUP BY 1), d AS (SELECT s_suppkey, brand, round(list_distance([s_acctbal / 5000, s_nationkey / 4.0]::DOUBLE[], v), 9) AS distance FROM supplier, b)
  SELECT s_suppkey, brand, distance, row_number() OVER (PARTITION BY s_suppkey ORDER BY distance, brand)::INTEGER AS rank FROM d QUALIFY rank <= 8""")
def nearest_of_other(spark: SparkSession, sf: str) -> DataFrame:
    """The eight brands nearest to each supplier, in a made-up plane."""
    brands = table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.array(F.avg("p_retailprice") / 500, F.avg("p_size") / 10).alias("v"))
    items = table(spark, sf, "supplier").select("s_suppkey", F.array(F.col("s_acctbal") / 5000, F.col("s_nationkey") / 4.0).alias("x"))
    got = S.nearest_boxes(items, "s_suppkey", "x", brands, "brand", "v", 8)
    return got.select("s_suppkey", "brand", F.round("distance", 9).alias("distance"), "rank")


@query("""WITH s AS (SELECT avg(p_retailprice) AS a, stddev_pop(p_retailprice) AS b, avg(p_size) AS c, stddev_pop(p_size) AS d FROM part)
  SELECT p_partkey, round((p_retailprice - a) / b, 6) AS z_price, round((p_size - c) / d, 6) AS z_size FROM part, s""")
def zscore(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    price, size = features.Scale.fit(parts, ["p_retailprice", "p_size"]).z()
    return parts.select("p_partkey", F.round(price, 6).alias("z_price"), F.round(size, 6).alias("z_size"))


@query("""WITH s AS (SELECT avg(p_retailprice) AS a, stddev_pop(p_retailprice) AS b, avg(p_size) AS c, stddev_pop(p_size) AS d, count(DISTINCT p_brand) AS k FROM part),
  t AS (SELECT p_partkey, round((p_retailprice - a) / b * sqrt(1.3), 6) AS x0, round((p_size - c) / d * sqrt(1.3), 6) AS x1, round(sqrt(0.7) * sqrt(2.0 / k), 6) AS flag,
    (SELECT count(*) FROM (SELECT DISTINCT p_brand FROM part) o WHERE o.p_brand < p.p_brand) + 2 AS place FROM part p, s)
  SELECT p_partkey, x0, x1, place::INTEGER AS place, flag FROM t""")
def onehot_space(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").withColumn("tags", F.array("p_brand"))
    space = features.fit_space(parts, ["p_retailprice", "p_size"], "tags", 0.35, parts.select(F.col("p_brand").alias("tag")).distinct())
    v = parts.select("p_partkey", space.vector("tags").alias("v"))
    place = F.array_position(F.transform(F.slice("v", 3, len(space.tags)), lambda x: x > 0), True)
    return v.select("p_partkey", F.round(F.col("v")[0], 6).alias("x0"), F.round(F.col("v")[1], 6).alias("x1"), (place + 1).cast("int").alias("place"), F.round(F.array_max(F.slice("v", 3, len(space.tags))), 6).alias("flag"))


@query()
def pca_variance(spark: SparkSession, sf: str) -> DataFrame:
    """Share of variance of the three first axes of the embeddings."""
    found = features.principal_components(table(spark, sf, "embeddings"), "embedding", 3)
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(found.shares)], "axis int, share double")


@query()
def pca_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Coordinates of every embedding on the three first axes."""
    rows = table(spark, sf, "embeddings")
    found = features.principal_components(rows, "embedding", 3)
    return rows.select("vec_id", found.project(F.col("embedding").cast("array<double>")).alias("xyz"))


@query()
def kmeans(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster of every embedding, of six: the best of eight starts."""
    return clusters.kmeans(table(spark, sf, "embeddings"), "vec_id", "embedding", 6)[0]


@query()
def hclust(spark: SparkSession, sf: str) -> DataFrame:
    """Average-linkage tree of the mean embeddings of the labels (a label set is small)."""
    rows = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    merges = clusters.linkage_of(means, "label", "v")
    return spark.createDataFrame([(i, *m) for i, m in enumerate(merges)], "step int, left int, right int, height double, size int")


@query("""WITH n AS (SELECT count(*) AS n FROM embeddings), m AS (SELECT i, avg(x) AS m FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1),
  v AS (SELECT sum(var) AS total FROM (SELECT i, var_samp(x) AS var FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1))
  SELECT n AS n_rows, round(total, 6) AS total_variance FROM n, v""")
def pca_total(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and total variance that the components share out: projections on all axes keep it."""
    rows = table(spark, sf, "embeddings")
    found = features.principal_components(rows, "embedding", 64)
    on = rows.select(F.posexplode(found.project(F.col("embedding").cast("array<double>"))).alias("i", "x"))
    kept = on.groupBy("i").agg(F.var_samp("x").alias("v"), F.count(F.lit(1)).alias("n"))
    return kept.agg(F.max("n").alias("n_rows"), F.round(F.sum("v"), 6).alias("total_variance"))


COLOURS = ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(SRM_RGB, 1))


@query(f"""WITH c(i, r, g, b) AS (VALUES {COLOURS}), p AS (SELECT p_partkey, least(greatest(p_size * 0.85, 1), 40)::DOUBLE AS s FROM part)
  SELECT p_partkey, '#' || printf('%02x', floor(x.r + (y.r - x.r) * (s - x.i) + 0.5)::INT) || printf('%02x', floor(x.g + (y.g - x.g) * (s - x.i) + 0.5)::INT) || printf('%02x', floor(x.b + (y.b - x.b) * (s - x.i) + 0.5)::INT) AS colour
  FROM p JOIN c x ON x.i = floor(s) JOIN c y ON y.i = least(floor(s) + 1, 40)""")
def colour_lut(spark: SparkSession, sf: str) -> DataFrame:
    """The colour of every part, whole and between two entries of the table."""
    return table(spark, sf, "part").select("p_partkey", colour_hex(F.col("p_size") * 0.85).alias("colour"))
