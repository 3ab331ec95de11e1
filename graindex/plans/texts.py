"""Text functions, pages, name matching and incremental loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import matching
from ..operators.steps import shared_folder
from ..streaming import incremental
from .tables import Registry, table

REGISTRY = Registry()
query = REGISTRY.add


@query(r"SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' (' || p_name || ')'), '[^a-z0-9]+', ' ', 'g')) AS name, regexp_replace(regexp_replace(lower(p_brand || '!' || p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def text_normalise(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    return parts.select("p_partkey", text.normal_name(F.concat("p_brand", F.lit(" ("), "p_name", F.lit(")"))).alias("name"), text.slug(F.concat("p_brand", F.lit("!"), "p_name")).alias("slug"))


RULES = [("first", "al|or"), ("second", "e[a-m]"), ("third", r"[0-9]1$")]


@query(r"""SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)al|or') THEN 'first' WHEN regexp_matches(p_name, '(?i)e[a-m]') THEN 'second' WHEN regexp_matches(p_name, '(?i)[0-9]1$') THEN 'third'
  WHEN regexp_matches(p_brand, '(?i)al|or') THEN 'first' WHEN regexp_matches(p_brand, '(?i)e[a-m]') THEN 'second' WHEN regexp_matches(p_brand, '(?i)[0-9]1$') THEN 'third' ELSE 'other' END AS class FROM part""")
def ordered_rules(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", text.ordered_rules([F.col("p_name"), F.col("p_brand")], RULES, "other").alias("class"))


TERMS = {"license": "licen[cs]e", "mail": "@", "secret": "password|token", "phone": r"[0-9]{3}-[0-9]{4}"}


@query(r"""WITH t AS (SELECT doc_id, text, source FROM documents), s AS (
    SELECT doc_id, 'license' AS name, regexp_matches(text, '(?i)licen[cs]e')::INT + regexp_matches(source, '(?i)licen[cs]e')::INT AS strength FROM t
    UNION ALL SELECT doc_id, 'mail', regexp_matches(text, '@')::INT + regexp_matches(source, '@')::INT FROM t
    UNION ALL SELECT doc_id, 'secret', regexp_matches(text, '(?i)password|token')::INT + regexp_matches(source, '(?i)password|token')::INT FROM t
    UNION ALL SELECT doc_id, 'phone', regexp_matches(text, '[0-9]{3}-[0-9]{4}')::INT + regexp_matches(source, '[0-9]{3}-[0-9]{4}')::INT FROM t)
  SELECT doc_id, name, strength FROM s WHERE strength > 0""")
def lexicon_strength(spark: SparkSession, sf: str) -> DataFrame:
    found = text.lexicon_strength([F.col("text"), F.col("source")], TERMS)
    return table(spark, sf, "documents").select("doc_id", F.explode(found).alias("e")).select("doc_id", "e.name", "e.strength")


@query(r"""WITH t AS (SELECT p_partkey, p_size || CASE p_size % 3 WHEN 0 THEN ' lb' WHEN 1 THEN ' oz' ELSE ' kg' END AS amount, p_size || ' - ' || (50 - p_size) || '%' AS r FROM part)
  SELECT p_partkey, round(regexp_extract(amount, '^([0-9]+)', 1)::DOUBLE * CASE WHEN amount LIKE '%lb' THEN 0.45359237 WHEN amount LIKE '%oz' THEN 0.028349523125 ELSE 1 END, 9) AS kg,
    least(x[1]::DOUBLE, x[2]::DOUBLE) AS lo, greatest(x[1]::DOUBLE, x[2]::DOUBLE) AS hi FROM (SELECT *, regexp_extract_all(r, '[0-9]+') AS x FROM t)""")
def unit_parse(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    unit = F.when(F.col("p_size") % 3 == 0, " lb").when(F.col("p_size") % 3 == 1, " oz").otherwise(" kg")
    span = text.number_range(F.concat(size, F.lit(" - "), (50 - F.col("p_size")).cast("string"), F.lit("%")))
    return table(spark, sf, "part").select("p_partkey", F.round(text.in_unit(F.concat(size, unit), text.KILOGRAMS, "kg"), 9).alias("kg"), span["lo"].alias("lo"), span["hi"].alias("hi"))


@query(r"""SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM pages)""")
def strip_tags(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", text.strip_tags(F.col("html")).alias("t"))
    return pages.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query(r"""SELECT DISTINCT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?href\s*=\s*["'']([^"'']+)["'']', 1)) AS link FROM pages)""")
def link_extract(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.explode(text.links(F.col("html"))).alias("link"))


@query(r"""SELECT event_id, regexp_extract(props, '"k":\s*([0-9]+)', 1)::BIGINT AS k FROM events""")
def json_property(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def _guides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two lists of names made from parts: the first plain and numbered, the second partly in other words."""
    parts = table(spark, sf, "part")
    kind = F.initcap("p_type")
    first = F.concat(F.lit("7A "), F.initcap("p_name"), F.lit(" "), kind)
    second = F.when(F.length("p_type") % 2 == 0, F.concat(kind, F.lit("-Style "), F.initcap("p_name"), F.lit(" Ale"))).otherwise(F.concat(F.initcap("p_name"), F.lit(" or "), kind, F.lit(" Beer")))
    out = []
    for name, part in ((first, 3), (second, 4)):
        rows = parts.where(F.col("p_partkey") % part > 0).groupBy(name.alias("name")).agg(F.min("p_partkey").alias("pos"), F.avg("p_retailprice").alias("price"))
        out.append(rows.select(F.col("name").alias("id"), "name", "pos", "price"))
    return out[0], out[1]


@query()
def name_match(spark: SparkSession, sf: str) -> DataFrame:
    """Two lists of names matched one to one."""
    a, b = _guides(spark, sf)
    return matching.match_names(a.select("id", "name", "pos"), b.select("id", "name", "pos"))


@query()
def matched_guides(spark: SparkSession, sf: str) -> DataFrame:
    """The difference of two lists whose names are matched first."""
    return matching.guide_difference(*_guides(spark, sf), ["price"], 5.0)


@query("SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1")
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """The events appended by a stream that has seen every file twice."""
    events = table(spark, sf, "events")
    schema = ", ".join(f"{n} {t}" for n, t in events.dtypes)
    work = new_folder(spark)
    for part in ("one", "two"):
        events.write.parquet(f"{work}/in/{part}")
    rows = incremental.new_rows(spark, f"{work}/in/*", schema, "event_id")
    incremental.append(rows, f"{work}/out", f"{work}/log").awaitTermination()
    return spark.read.schema(schema).parquet(f"{work}/out").select("event_id", "user_id", "event_type", "value")


_count = iter(range(1 << 30))


def new_folder(spark: SparkSession) -> str:
    """A new folder of a stream."""
    return f"{shared_folder(spark)}/stream-{spark.sparkContext.applicationId}-{next(_count)}"


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """An extension: counts by day, kept by a stream over the events."""
    kinds = ", ".join(f"{n} {t}" for n, t in table(spark, sf, "events").dtypes)
    work = new_folder(spark)
    events = spark.readStream.schema(kinds).parquet(f"{sf}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = incremental.windowed_counts(events, "ts", "1 day", "1 hour", "event_type")
    incremental.keep_whole(counts, f"{work}/out", f"{work}/log").awaitTermination()
    schema = "start timestamp, event_type string, n long"
    return spark.read.schema(schema).parquet(f"{work}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))
