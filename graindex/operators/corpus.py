"""Whole-corpus steps of the recipe domain: merging ingredient sources, feature rows, projections and guideline drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import brewing, text, units
from .features import Scale, fit_space, principal_components, style_numerics
from .rollups import vocabulary


def duplicate_ids(df: DataFrame, guide: str, key: str) -> DataFrame:
    """Ids that a guide has more than once; a build stops if there are any."""
    return df.groupBy(guide, key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, guide: str, key: str) -> DataFrame:
    """``df``, or an error that names the least repeated id of a guide."""
    first = duplicate_ids(df, guide, key).orderBy(guide, key).first()
    if first is not None:
        raise ValueError(f"{first[guide]} has {first[key]} {first['n']} times")
    return df


def fullest(df: DataFrame, key: str, profile: Column, position: str) -> DataFrame:
    """One record a key: one with a profile first, then the one with more fields filled, then the first in position."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in df.columns), F.lit(0))
    order = Window.partitionBy(key).orderBy((F.when(profile, 100).otherwise(0) + filled).desc(), F.col(position))
    return df.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def merge_sources(base: DataFrame, others: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """The base records with a struct column for each other source's record of the same key, null without one."""
    for name, df in others:
        rows = df.select(F.col(key), F.struct(*[c for c in df.columns if c != key]).alias(name)).dropDuplicates([key])
        base = base.join(rows, key, "left")
    return base


def substitute_edges(df: DataFrame, key: str, name: str, substitutes: str) -> DataFrame:
    """Undirected edges (a, b) between records that list each other as substitutes, by name without case."""
    named = df.select(F.lower(name).alias("_n"), F.col(key).alias("b")).dropDuplicates(["_n"])
    wanted = df.select(F.col(key).alias("a"), F.explode(substitutes).alias("s")).withColumn("_n", F.lower(F.trim("s")))
    met = wanted.join(named, "_n").where("a <> b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def unmatched(df: DataFrame, name: str, key: str, n: int = 12) -> DataFrame:
    """The most frequent names without a key."""
    return df.where(F.col(key).isNull()).groupBy(F.lower(name).alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(n)


def match_rate(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.avg(F.col(key).isNotNull().cast("double")).alias("rate"))


def recipe_rows(recipes: DataFrame, classes: Sequence[str], top_hops: int = 40) -> tuple[DataFrame, list[str]]:
    """Raw feature columns of recipes with all five vitals (id, v0, v1 ...), and the hop keys that are columns.

    Seven numbers, the share of each malt class, and flags of the most frequent hops (ties by key), a bounded list.
    """
    full = recipes.where(" and ".join(f"vitals.{x} is not null" for x in ("og", "fg", "abv", "ibu", "srm")))
    hop_key = lambda h: F.coalesce(h["key"], F.lower(F.trim(h["name"])))
    keyed = full.withColumn("_hops", F.array_distinct(F.transform("hops", hop_key)))
    keys = [r["k"] for r in keyed.select(F.explode("_hops").alias("k")).groupBy("k").count().orderBy(F.desc("count"), "k").limit(top_hops).collect()]
    share = lambda c: F.aggregate(F.filter("malts", lambda m: m["class"] == c), F.lit(0.0), lambda s, m: s + F.coalesce(m["pct"], F.lit(0.0)) / 100)
    numbers = style_numerics(*[F.col(f"vitals.{x}") for x in ("og", "fg", "abv", "ibu", "srm")])
    columns = [*numbers, *[share(c) for c in classes], *[F.coalesce(F.array_contains("_hops", k), F.lit(False)).cast("double") for k in keys]]
    return keyed.select("id", *[c.alias(f"v{i}") for i, c in enumerate(columns)]), keys


def blended(rows: DataFrame, blend: float, numerics: int = 7) -> DataFrame:
    """id and vector: z-scores, with the numbers weighted by 1 - blend and the ingredients by blend, balanced by their count."""
    names = [c for c in rows.columns if c != "id"]
    w, rest = min(max(blend, 0.0), 1.0), len(names) - numerics
    weight = [2**0.5 * (1 - w)] * numerics + [2**0.5 * w * (numerics / rest) ** 0.5 if rest else 0.0] * rest
    return rows.select("id", F.array(*[z * x for z, x in zip(Scale.fit(rows, names).z(), weight, strict=True)]).alias("vector"))


def projections(rows: DataFrame, blends: Sequence[float] = (0.0, 0.5, 1.0)) -> DataFrame:
    """id, method, blend, x, y, z: the three first components of each blend, rescaled so that the bulk fits in [-1, 1]."""
    return projections_and_variance(rows, blends)[0]


def projections_and_variance(rows: DataFrame, blends: Sequence[float] = (0.0, 0.5, 1.0)) -> tuple[DataFrame, DataFrame]:
    """The points of ``projections``, and method, blend, axis and share: the share of variance of each axis, to four places."""
    out, shares = None, []
    for blend in blends:
        space = blended(rows, blend)
        found = principal_components(space, "vector", 3)
        shares += [("pca", float(blend), i, round(float(s), 4)) for i, s in enumerate(found.shares)]
        points = space.select("id", found.project(F.col("vector")).alias("p"))
        part = rescaled(points, "p").select("id", F.lit("pca").alias("method"), F.lit(float(blend)).alias("blend"), *[F.get("p", F.lit(i)).alias(c) for i, c in enumerate("xyz")])
        out = part if out is None else out.unionByName(part)
    return out, rows.sparkSession.createDataFrame(shares, "method string, blend double, axis int, share double")


def rescaled(points: DataFrame, name: str) -> DataFrame:
    """Points around their mean, divided by the largest-axis deviation at place floor(0.975 n) in order.

    The place is found by an exact percentile of counts of values, without an order of all rows.
    """
    axes = range(3)
    centre = points.agg(*[F.avg(F.get(name, F.lit(i))).alias(f"c{i}") for i in axes], F.count(F.lit(1)).alias("n")).first()
    if not centre["n"]:
        return points
    moved = F.array(*[F.get(name, F.lit(i)) - (centre[f"c{i}"] or 0.0) for i in axes])
    rows = points.withColumn(name, moved)
    far = F.array_max(F.transform(name, lambda x: F.abs(x)))
    place = min(centre["n"] - 1, int(centre["n"] * 0.975))
    q = rows.agg(F.percentile(far, F.lit(place / max(1, centre["n"] - 1))).alias("q")).first()["q"] or 1e-9
    return rows.withColumn(name, F.transform(name, lambda x: x / q))


def drifted(matches: DataFrame, axes: Sequence[str], least: float = 0.05) -> DataFrame:
    """Matched pairs any of whose middles differ by ``least`` or more; columns are {axis}_a and {axis}_b, null is passed over."""
    far = [F.coalesce(F.abs(F.col(f"{x}_a") - F.col(f"{x}_b")) >= least, F.lit(False)) for x in axes]
    any_far = far[0]
    for f in far[1:]:
        any_far = any_far | f
    return matches.where(any_far)


def edition_difference(a: DataFrame, b: DataFrame, key: str, axes: Sequence[str], least: float = 0.05) -> DataFrame:
    """key and change of two editions: same or changed (see drifted) where both have it, removed or added where one has."""
    left, right = (df.select(key, *[F.col(x).alias(f"{x}_{side}") for x in axes], F.lit(True).alias(f"in_{side}")) for df, side in ((a, "a"), (b, "b")))
    both = left.join(right, key, "full")
    moved = drifted(both.where("in_a and in_b"), axes, least).select(key, F.lit("changed").alias("change"))
    kept = both.where("in_a and in_b").join(moved.select(key), key, "left_anti").select(key, F.lit("same").alias("change"))
    return moved.unionByName(kept).unionByName(both.where("not (coalesce(in_a, false) and coalesce(in_b, false))").select(key, F.when(F.col("in_b").isNull(), "removed").otherwise("added").alias("change")))


def shared_projection(first: DataFrame, second: DataFrame, guide: tuple[str, str], columns: Sequence[str], tags: str, weight: float = 0.3) -> DataFrame:
    """Two guides in one space: guide, id and x, y, z on the first axes of their union, tags weighted by ``weight``.

    Rows that lack a number take no part; the vocabulary is of tags that two rows or more carry.
    """
    both = first.select("id", *columns, tags, F.lit(guide[0]).alias("guide")).unionByName(second.select("id", *columns, tags, F.lit(guide[1]).alias("guide")))
    both = both.dropna(subset=list(columns))
    space = fit_space(both, columns, tags, weight, vocabulary(both, tags, 2))
    rows = both.select("guide", "id", space.vector(tags).alias("v"))
    found = principal_components(rows, "v", 3)
    return rows.select("guide", "id", found.project(F.col("v")).alias("p")).select("guide", "id", *[F.get("p", F.lit(i)).alias(c) for i, c in enumerate("xyz")])


def unit_cube(points: DataFrame, name: str, size: float = 1.15) -> DataFrame:
    """Points (arrays) divided by their largest absolute coordinate and times ``size``."""
    most = points.agg(F.max(F.array_max(F.transform(name, lambda x: F.abs(x)))).alias("_most"))  # one row
    scale = F.when(F.col("_most") > 0, F.lit(size) / F.col("_most")).otherwise(1.0)
    return points.join(F.broadcast(most)).withColumn(name, F.transform(name, lambda x: x * scale)).drop("_most")


def slim(recipes: DataFrame) -> DataFrame:
    """Recipes for a list: no prose, malts without weight, hops without times, and the hop dose and roast share made ready."""
    pick = lambda fields: lambda x: F.struct(*[x[f].alias(f) for f in fields])
    ready = recipes.withColumn("hop_dose", F.round(brewing.hop_dose(F.col("hops"), F.col("batchL")), 2)).withColumn("roast", F.round(brewing.grist_share(F.col("malts"), "roasted"), 2))
    return ready.withColumn("malts", F.transform("malts", pick(["name", "pct", "class"]))).withColumn("hops", F.transform("hops", pick(["name", "key", "g", "stage"]))).drop("description")


def scatter_points(recipes: DataFrame, mode: str) -> DataFrame:
    """id, x, y of slim recipes: hop dose against bitterness, or else roast share against colour (80 at most)."""
    if mode == "hops":
        return recipes.where("hop_dose > 0 and vitals.ibu is not null").select("id", F.col("hop_dose").alias("x"), F.col("vitals.ibu").alias("y"))
    return recipes.where("vitals.srm is not null").select("id", F.coalesce("roast", F.lit(0.0)).alias("x"), F.least(F.col("vitals.srm"), F.lit(80.0)).alias("y"))


def manual_recipe(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of a form (name and five numbers as text) as recipes, with strength computed if blank, and the entries that lack a number."""
    n = {c: text.leading_number(F.col(c)) for c in ("og", "fg", "abv", "ibu", "srm")}
    abv = F.coalesce(n["abv"], units.alcohol(n["og"], n["fg"]))
    good = n["og"].isNotNull() & n["fg"].isNotNull() & n["ibu"].isNotNull() & n["srm"].isNotNull()
    vitals = F.struct(n["og"].alias("og"), n["fg"].alias("fg"), abv.alias("abv"), n["ibu"].alias("ibu"), n["srm"].alias("srm"))
    tags = brewing.derived_tags(F.col("name"), n["og"], abv, n["ibu"], n["srm"])
    name = F.coalesce(text.blank_to_null(F.col("name")), F.lit("My recipe"))
    return entries.where(good).select(name.alias("name"), vitals.alias("vitals"), tags.alias("tags"), F.lit("manual").alias("source")), entries.where(~good)


def nearest_blend(asked: float, blends: Sequence[float] = (0.5, 0.0, 1.0)) -> float:
    """The precomputed blend nearest to the one asked for; the first of equally near ones."""
    return min(blends, key=lambda b: abs(b - asked))


def overlaid(bundled: Column, live: Column) -> Column:
    """Two maps of results as one; live entries win."""
    return F.map_concat(F.map_filter(bundled, lambda k, v: ~F.array_contains(F.map_keys(live), k)), live)
