"""What views make of styles and recipes: middles, a colour ladder, a fermentability chart, records of rows, lookups by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import domain
from .relational import last_wins

VITALS = ("og", "fg", "abv", "ibu", "srm")
#: The darkest colour a ladder shows, and the ends of attenuation in a chart.
DARKEST, ATTENUATION = 45.0, (55.0, 95.0)


def has_stats(stats: str) -> Column:
    """Are all five ranges of a struct there, both ends of each?"""
    there = F.lit(True)
    for v in VITALS:
        there = there & F.col(f"{stats}.{v}.lo").isNotNull() & F.col(f"{stats}.{v}.hi").isNotNull()
    return F.coalesce(there, F.lit(False))


def middle_vitals(stats: str) -> Column:
    """The middles of five ranges as a struct; null unless all are there."""
    middles = [((F.col(f"{stats}.{v}.lo") + F.col(f"{stats}.{v}.hi")) / 2).alias(v) for v in VITALS]
    return F.when(has_stats(stats), F.struct(*middles))


def colour_ladder(styles: DataFrame, stats: str, key: str) -> DataFrame:
    """Styles with all five ranges from pale to dark (ties by key): low, middle and high colour, each capped at ``DARKEST``."""
    capped = lambda x: F.least(F.col(x), F.lit(DARKEST))
    rows = styles.where(has_stats(stats)).select(key, F.col(f"{stats}.srm.lo").alias("low"), middle_vitals(stats)["srm"].alias("middle"), F.col(f"{stats}.srm.hi").alias("high"))
    return rows.orderBy("middle", key).select(key, *[capped(x).alias(x) for x in ("low", "middle", "high")])


def fermentability(styles: DataFrame, stats: str, key: str) -> DataFrame:
    """key, og, attenuation (clamped to the chart) and srm of the middles; attenuation is 0, and so the least, at a gravity of 1 or less."""
    m = styles.where(has_stats(stats)).select(key, middle_vitals(stats).alias("m"))
    og, fg = F.col("m.og"), F.col("m.fg")
    off = F.when(og > 1, (og - fg) / (og - 1) * 100).otherwise(0.0)
    return m.select(key, og.alias("og"), F.least(F.greatest(off, F.lit(ATTENUATION[0])), F.lit(ATTENUATION[1])).alias("attenuation"), F.col("m.srm").alias("srm"))


def row_records(rows: DataFrame) -> DataFrame:
    """Rows of the recipe table as records without bills: id, name, tagline, year, family, vitals, attenuation, styleGuess, batchL, malts, hops, yeast, hopDose, roast."""
    return rows.select(
        "id", "name", F.lit("").alias("tagline"), F.lit(None).cast("int").alias("year"), "family", F.struct(*VITALS).alias("vitals"), "attenuation", _guess("style_code", "style_name").alias("styleGuess"),
        F.col("batch_l").alias("batchL"), F.expr("cast(array() as array<struct<name:string,kg:double,class:string,pct:double>>)").alias("malts"), F.expr("cast(array() as array<struct<name:string,key:string,g:double,stage:string>>)").alias("hops"),
        F.lit(None).cast("string").alias("yeast"), F.col("hop_dose").alias("hopDose"), "roast",
    )


def point_records(points: DataFrame) -> DataFrame:
    """Points of a projection as light records: vitals without gravities, and a style without a name."""
    none = F.lit(None).cast("double")
    vitals = F.struct(none.alias("og"), none.alias("fg"), "abv", "ibu", "srm")
    return points.select("id", "name", "family", vitals.alias("vitals"), _guess("style_code").alias("styleGuess"))


def detail_records(details: DataFrame) -> DataFrame:
    """Rows with bills (see ``browse.detail``) as whole records: texts are '' where a name is null, additions without a stage are late, malts weigh 0."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    malts = F.transform("malts", lambda m: F.struct(m["name"].alias("name"), F.lit(0.0).alias("kg"), m["pct"].alias("pct"), m["class"].alias("class")))
    hops = F.transform("hops", lambda h: F.struct(h["name"].alias("name"), h["key"].alias("key"), h["g"].alias("g"), F.coalesce(h["stage"], F.lit("late")).alias("stage")))
    return details.select(
        "id", text("name"), text("tagline"), "year", text("family"), "origin", F.struct(*VITALS).alias("vitals"), "attenuation", _guess("style_code", "style_name").alias("styleGuess"), F.col("batch_l").alias("batchL"), "yeast", malts.alias("malts"), hops.alias("hops"),
        F.col("hop_dose").alias("hopDose"), "roast",
    )


def _guess(code: str, name: str | None = None) -> Column:
    """A guessed style; null without a code, and the name '' where it is unknown."""
    known = F.coalesce(F.col(name), F.lit("")) if name else F.lit("")
    return F.when(F.col(code).isNotNull() & (F.col(code) != ""), F.struct(F.col(code).alias("code"), known.alias("name"), F.lit(0).alias("inRange")))


def name_index(hops: DataFrame, name: str, key: str, position: str) -> DataFrame:
    """wanted, key: every hop under its plain name and under its key with blanks for hyphens; of equal ones the last entry stays.

    A hop's key comes after its own name, as if both were put into a dictionary one after another.
    """
    spelt = hops.select(domain.hop_name(F.col(name)).alias("wanted"), F.col(key).alias("key"), (F.col(position) * 2).alias("at"))
    keyed = hops.select(F.replace(key, F.lit("-"), F.lit(" ")).alias("wanted"), F.col(key).alias("key"), (F.col(position) * 2 + 1).alias("at"))
    return last_wins(spelt.union(keyed).where("wanted is not null"), "wanted", "at").select("wanted", "key")


def hop_keys(additions: DataFrame, name: str, index: DataFrame) -> DataFrame:
    """``additions`` with the key that the index has for the plain name of each, null without."""
    rows = additions.withColumn("_wanted", domain.hop_name(F.col(name)))
    return rows.join(index.withColumnRenamed("key", "hop_key"), F.col("_wanted") == F.col("wanted"), "left").drop("_wanted", "wanted")


def overlay(first: DataFrame, second: DataFrame, names: Sequence[str] = ("A", "B")) -> DataFrame:
    """Two guides as one, with a column ``guide``."""
    return first.withColumn("guide", F.lit(names[0])).unionByName(second.withColumn("guide", F.lit(names[1])))
