"""What lasts between runs: crawls that go on, retries, roll-ups kept up to date, stored projections; and searches at size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import random_number
from ..operators import browse as B
from ..operators import features
from ..operators import relational as R
from ..operators import standing
from ..operators.steps import cut
from ..sources import crawl, projected
from ..streaming import retries
from .bills import LINES
from .browse import POINTS, _points
from .tables import Registry, order_parts, table, with_orders
from .texts import new_folder

REGISTRY = Registry()
query = REGISTRY.add

#: Events on a page of a made-up listing, and events that a shard of retries may hold.
PAGE, SHARD = 2000, 200_000


@query(f"SELECT event_type AS mode, (event_id // {PAGE} + 1)::INTEGER AS page, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def crawled_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Events as pages of a listing for each type, crawled by runs that take half of the pages each and go on where the last stopped."""
    work = new_folder(spark)
    events = table(spark, sf, "events").select(F.col("event_type").alias("mode"), (F.expr(f"event_id div {PAGE}") + 1).cast("int").alias("page"), "event_id", "value")
    events.repartition("mode", "page").write.partitionBy("mode", "page").parquet(f"{work}/site")
    at = events.agg(F.max("page"), F.sort_array(F.collect_set("mode"))).first()  # a few types
    taken = 1
    while taken:
        rows = crawl.crawl(spark, "listing", crawl.Folder(f"{work}/site"), at[1], "event_id bigint, value double", pages=1 + at[0] // 2)
        run = rows.writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/log").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
        taken = sum(p.numInputRows for p in run.recentProgress)
    got = spark.read.schema("mode string, page int, event_id bigint, value double").parquet(f"{work}/out")
    return got.groupBy("mode", "page").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


def _attempt(item: dict, number: int) -> str:
    """A service that fails event_id % 3 times for now, and holds nothing for every eleventh event."""
    if number <= item["event_id"] % 3:
        return retries.LATER
    return retries.GONE if item["event_id"] % 11 == 3 else retries.DONE


@query("SELECT event_id, event_type, (event_id % 3 + 1)::INTEGER AS tries, CASE WHEN event_id % 11 = 3 THEN 'gone' ELSE 'done' END AS outcome FROM events")
def retried_events(spark: SparkSession, sf: str) -> DataFrame:
    """Every event tried until it ends well or for good; only the latter are rejects."""
    work = new_folder(spark)
    own = spark.newSession()  # for its kind of state alone
    own.conf.set("spark.sql.streaming.stateStore.providerClass", retries.PROVIDER)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    read = table(spark, sf, "events")
    kinds = ", ".join(f"{n} {t}" for n, t in read.dtypes)
    shards = max(32, read.count() // SHARD)
    events = own.readStream.schema(kinds).parquet(f"{sf}/event[s].parquet").select("event_id", "event_type")
    retries.run_settled(retries.with_retries(events, _attempt, 50, 1000, shards), f"{work}/done", f"{work}/gone", f"{work}/log", limit=math.inf)
    out = None
    for outcome in ("done", "gone"):
        rows = spark.read.schema("item string, tries int").parquet(f"{work}/{outcome}/*").withColumn("item", F.from_json("item", "event_id bigint, event_type string"))
        rows = rows.select("item.event_id", "item.event_type", "tries", F.lit(outcome).alias("outcome"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_orders(order_parts(spark, sf, by_order=True), spark, sf).withColumnsRenamed({"o_orderpriority": "family", "l_orderkey": "group", "l_returnflag": "stage", "l_quantity": "amount", "p_type": "kind"})
    return rows.withColumn("item", F.lower(F.trim("p_name"))).withColumn("batch", F.col("group") % 7).withColumn("share", F.col("amount") / 50)


def _kept_up(spark: SparkSession, sf: str) -> standing.State:
    """The state of all orders, folded in three batches of whole orders."""
    folder = new_folder(spark)
    lines = cut(_lines(spark, sf).select("family", "group", "item", "kind", "stage", "amount", "share", "batch"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("group"), F.col("o_orderpriority").alias("family"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"))
    for batch in range(3):
        part = F.col("group") % 3 == batch
        state = standing.state_of(lines.where(part), orders.where(part), ["A", "N", "R"], ["price"])
        standing.fold(spark, folder, batch, state)
        if batch == 1:
            standing.fold(spark, folder, batch, state)  # sent twice, added once
    return standing.stored(spark, folder)


@query(f"""WITH {LINES}, e AS (SELECT o_orderpriority AS f, l_orderkey AS g, lower(trim(p_name)) AS i, l_orderkey % 7 AS batch, sum(l_quantity) AS amount, sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS x,
    sum(l_quantity) FILTER (WHERE l_returnflag = 'N') AS y, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS z FROM lines JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
  b AS (SELECT * FROM e UNION ALL SELECT 'all', g, i, batch, amount, x, y, z FROM e)
  SELECT f AS family, i AS item, count(*) AS n_groups, round(sum(amount), 6) AS total, sum(x) AS in_a, sum(y) AS in_n, sum(z) AS in_r,
    round((list_sort(list(amount / batch) FILTER (WHERE batch > 0)))[(count(*) FILTER (WHERE batch > 0) // 2 + 1)::INT], 6) AS median_dose
  FROM b GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY f ORDER BY n_groups DESC, i) <= 40""")
def kept_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """The leaderboard read from states that three batches were folded into."""
    board = standing.leaderboard(_kept_up(spark, sf))
    return board.select("family", "item", "n_groups", F.round("total", 6).alias("total"), *[F.col(f"in_{s}").alias(f"in_{s.lower()}") for s in "ANR"], F.round("median_dose", 6).alias("median_dose"))


@query(f"""WITH {LINES}, l AS (SELECT o_orderpriority AS f, l_orderkey AS g, p_type AS kind, l_quantity / 50 AS share FROM lines JOIN orders ON l_orderkey = o_orderkey),
  b AS (SELECT * FROM l UNION ALL SELECT 'all', g, kind, share FROM l), n AS (SELECT f, count(DISTINCT g) AS n_groups FROM b GROUP BY 1),
  o AS (SELECT o_orderpriority AS f, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders), p AS (SELECT * FROM o UNION ALL SELECT 'all', price FROM o),
  m AS (SELECT f, count(*) AS n_orders, round(avg(price), 4) AS avg_price FROM p GROUP BY 1)
  SELECT f AS family, kind, count(DISTINCT g) AS n_with, round(sum(share) / any_value(n_groups), 6) AS mean_share, any_value(n_orders) AS n_orders, any_value(avg_price) AS avg_price FROM b JOIN n USING (f) JOIN m USING (f) GROUP BY 1, 2""")
def kept_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Zero-filled shares and outcomes read from states that three batches were folded into."""
    state = _kept_up(spark, sf)
    means = standing.outcomes(state, ["price"]).select("family", F.col("n").alias("n_orders"), F.round("avg_price", 4).alias("avg_price"))
    return standing.mean_shares(state).withColumn("mean_share", F.round("mean_share", 6)).join(means, "family")


@query(f"""WITH {POINTS} SELECT c_custkey, round(x, 6) AS x, round(y::DOUBLE, 6) AS y, c_name FROM p JOIN customer USING (c_custkey) WHERE method = 'umap' AND blend = 1 ORDER BY md5(c_custkey::VARCHAR), c_custkey LIMIT 300""")
def stored_projection(spark: SparkSession, sf: str) -> DataFrame:
    """A page read from stored points and details: one folder, bucket by bucket."""
    folder = new_folder(spark)
    name = folder.rpartition("/")[2].replace("-", "_")
    variance = spark.createDataFrame([("pca", 0.5, 0, 0.6), ("umap", 1.0, 0, 0.4)], "method string, blend double, axis int, share double")
    projected.store(_points(spark, sf).withColumn("blend", F.col("blend").cast("double")), variance, table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", folder, name, 8)
    points, details, _ = projected.tables(spark, name)
    return B.projection_page(points, details, "c_custkey", "umap", 1, 300).select("c_custkey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "c_name")


FITS = """b AS (SELECT p_partkey AS name, p_retailprice * 20 AS plo, p_retailprice * 20 + p_size * 60 AS phi, CASE WHEN p_size % 10 > 0 THEN p_size * 0.6 END AS qlo, CASE WHEN p_size % 10 > 0 THEN p_size * 0.6 + 6 END AS qhi FROM part),
  i AS (SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, l_partkey, l_extendedprice AS p, CASE WHEN l_linenumber < 6 THEN l_quantity END AS q FROM lineitem)"""


@query(f"""WITH {FITS}, f AS (SELECT rid, l_orderkey, l_linenumber, l_partkey, name, (p BETWEEN plo AND phi)::INT + coalesce((q BETWEEN qlo AND qhi)::INT, 0) AS inside,
    CASE WHEN q IS NULL OR qlo IS NULL THEN abs(p - (plo + phi) / 2) / greatest((phi - plo) / 2, 1e-9) ELSE (abs(p - (plo + phi) / 2) / greatest((phi - plo) / 2, 1e-9) + abs(q - (qlo + qhi) / 2) / greatest((qhi - qlo) / 2, 1e-9)) / 2 END AS off FROM i, b)
  SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n, k.name AS name, k.inside AS inside, round(k.off, 6) AS off
  FROM (SELECT rid, l_orderkey, l_linenumber, l_partkey, min({{'r': -inside, 'off': off, 'name': name, 'inside': inside}}) AS k FROM f GROUP BY ALL) GROUP BY ALL""")
def range_best_fit_many(spark: SparkSession, sf: str) -> DataFrame:
    """The box of each order line among as many boxes as there are parts, some without one axis."""
    part, lines = table(spark, sf, "part"), table(spark, sf, "lineitem")
    size = F.when(F.col("p_size") % 10 > 0, F.col("p_size") * 0.6)
    boxes = part.select(F.col("p_partkey").alias("name"), (F.col("p_retailprice") * 20).alias("p_lo"), (F.col("p_retailprice") * 20 + F.col("p_size") * 60).alias("p_hi"), size.alias("q_lo"), (size + 6).alias("q_hi"))
    items = lines.select(F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("line"), F.col("l_extendedprice").alias("p"), F.when(F.col("l_linenumber") < 6, F.col("l_quantity")).alias("q"))
    got = R.best_fit(items, "line", boxes, ["p", "q"], "name")
    off = F.round("off", 6).alias("off")
    return got.groupBy("line.l_orderkey", "line.l_linenumber", "line.l_partkey", "name", "inside", off).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey * 1000000000 + l_linenumber * 10000000 + l_partkey LIMIT 200 OFFSET (SELECT count(*) * 4 // 5 FROM lineitem)")
def deep_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page at four fifths of all lines in order of price; only a part of their range is ordered."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    keyed = lines.withColumn("k", F.col("l_orderkey") * 1_000_000_000 + F.col("l_linenumber") * 10_000_000 + F.col("l_partkey"))
    return R.deep_page(keyed, "l_extendedprice", True, "k", 200, lines.count() * 4 // 5).drop("k")


RANDOM = "(xor(t2, t2 >> 14))::DOUBLE / 4294967296"


@query(f"""WITH a AS (SELECT event_id, (42 + (event_id + 1)::UBIGINT * 1831565813) % 4294967296 AS a FROM events),
  b AS (SELECT event_id, ((xor(a, a >> 15))::UHUGEINT * (a | 1) % 4294967296)::UBIGINT AS t FROM a),
  c AS (SELECT event_id, xor((t + ((xor(t, t >> 7))::UHUGEINT * (t | 61) % 4294967296)::UBIGINT) % 4294967296, t) AS t2 FROM b)
  SELECT event_id, {RANDOM} AS r FROM c""")
def random_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """The event's number in the sequence of one seed."""
    return table(spark, sf, "events").select("event_id", random_number(42, F.col("event_id") + 1).alias("r"))


@query("""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings), m AS (SELECT i, avg(x) AS m FROM e GROUP BY 1)
  SELECT vec_id, round(sum((x - m) * (x - m)), 6) AS squared FROM e JOIN m USING (i) GROUP BY 1""")
def pca_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Each embedding's squared distance to the mean, from its coordinates on all axes found without the matrix."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    found = features.wide_components(rows, "embedding", 64, 64)
    on = features.coordinates(rows, "vec_id", "embedding", found)
    return on.select("vec_id", F.round(F.aggregate("coordinates", F.lit(0.0), lambda s, x: s + x * x), 6).alias("squared"))


@query()
def tag_components(spark: SparkSession, sf: str) -> DataFrame:
    """Three first axes of the orders' part names as flags, a space too wide for a matrix of its own."""
    tags = order_parts(spark, sf).groupBy("l_orderkey").agg(F.collect_set(F.concat_ws(" ", "p_name", "p_brand")).alias("tags"))
    vectors, _, many = features.tag_vectors(tags, "l_orderkey", "tags")
    vectors = cut(vectors)
    return features.coordinates(vectors, "l_orderkey", "v", features.wide_components(vectors, "v", many, 3, tolerance=1e-4))
