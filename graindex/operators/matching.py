"""Matching of two lists of names one to one, and scores of ingredients for styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domain
from ..functions.units import cosine, jaccard
from .corpus import drifted
from .steps import cut


def candidates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs worth considering of two tables (id, name, pos): a_pos, b_pos, kind, score, a_id, b_id.

    kind 1: a reading of one equals a reading of the other, which names the first entry that has it (score is minus the
    place of the reading); kind 2: token
    Jaccard above 0.65 of any readings; kind 3: the telling words of one lie in the other's. Pairs are found by
    joining readings and tokens, so names that share nothing never meet.
    """
    def readings(df: DataFrame, x: str) -> DataFrame:
        rows = df.select(F.col("id").alias(f"{x}_id"), F.col("pos").alias(f"{x}_pos"), domain.style_name(F.col("name")).alias(f"{x}_norm"), F.posexplode(domain.alternative_names(F.col("name"))).alias(f"{x}_place", "reading"))
        return rows.withColumn(f"{x}_tokens", domain.name_tokens(F.col("reading")))

    a, b = readings(first, "a"), readings(second, "b")
    index = b.groupBy("reading").agg(F.min(F.struct("b_pos", "b_id")).alias("first")).select("reading", "first.b_pos", "first.b_id")
    exact = a.join(index, "reading").select("a_id", "b_id", "a_pos", "b_pos", F.lit(1).alias("kind"), (-F.col("a_place")).cast("double").alias("score"))
    token = lambda df, x: df.select("*", F.explode(f"{x}_tokens").alias("token")).drop("reading")
    met = token(a, "a").join(token(b, "b"), "token").drop("token").distinct()
    has = lambda x, w: F.col(f"{x}_norm").rlike(rf"\b{w}\b")
    only = lambda x, w, other: has(x, w) & ~has(x, other)
    clash = (only("a", "ale", "lager") & only("b", "lager", "ale")) | (only("a", "lager", "ale") & only("b", "ale", "lager"))
    met = met.where(~clash)
    fuzzy = met.withColumn("score", jaccard(F.col("a_tokens"), F.col("b_tokens"))).where("score > 0.65").select("a_id", "b_id", "a_pos", "b_pos", F.lit(2).alias("kind"), "score")
    small = F.when(F.size("a_tokens") <= F.size("b_tokens"), F.col("a_tokens")).otherwise(F.col("b_tokens"))
    big = F.when(F.size("a_tokens") <= F.size("b_tokens"), F.col("b_tokens")).otherwise(F.col("a_tokens"))
    generic = (F.size(small) == 1) & F.element_at(small, 1).isin(*domain.GENERIC_TOKENS)
    inside = met.where("a_place = 0").where((F.size(F.array_except(small, big)) == 0) & ~generic).select("a_id", "b_id", "a_pos", "b_pos", F.lit(3).alias("kind"), F.lit(0.0).alias("score"))
    return exact.unionByName(fuzzy).unionByName(inside).groupBy("a_id", "b_id", "a_pos", "b_pos", "kind").agg(F.max("score").alias("score"))


def one_to_one(found: DataFrame) -> DataFrame:
    """a_id and b_id of the matches that a greedy pass makes: in order of a_pos each a takes the best of its b that is free.

    ``found`` has a_id, a_pos, b_id, b_pos and score; better is a higher score, then a smaller b_pos. Instead of one
    after another, all ask at once for their best, and of those that ask for the same b the first in order keeps it; the
    others can't have it, and ask for their next in another round. What each gets is the same, as a b is only ever
    taken over by one that comes earlier.
    """
    best = Window.partitionBy("a_id").orderBy(F.desc("score"), "b_pos")
    first = Window.partitionBy("b_id").orderBy("a_pos")
    left = cut(found)
    while True:
        asked = left.withColumn("_r", F.row_number().over(best)).where("_r = 1").withColumn("_k", F.row_number().over(first))
        lost = asked.where("_k > 1").select("a_id", "b_id")
        if lost.isEmpty():
            return asked.select("a_id", "b_id")
        left = cut(left.join(lost, ["a_id", "b_id"], "left_anti"))


def match_names(first: DataFrame, second: DataFrame) -> DataFrame:
    """One-to-one matches (a_id, b_id, fuzzy) of two lists of names (id, name, pos), by three greedy passes (see candidates).

    Later passes see only what the earlier ones left. The last takes an a only if one to three b of the whole list hold
    its words or lie in them.
    """
    every = cut(candidates(first, second))
    out = None
    for kind in (1, 2, 3):
        found = every.where(F.col("kind") == kind)
        if kind == 3:
            few = found.groupBy("a_id").agg(F.countDistinct("b_id").alias("n")).where("n <= 3").select("a_id")
            found = found.join(few, "a_id")
        if out is not None:
            found = found.join(out.select("a_id"), "a_id", "left_anti").join(out.select("b_id"), "b_id", "left_anti")
        found = found.groupBy("a_id", "a_pos", "b_id", "b_pos").agg(F.max("score").alias("score"))
        made = cut(one_to_one(found).withColumn("fuzzy", F.lit(kind > 1)))
        out = made if out is None else cut(out.unionByName(made))
    return out


def guide_difference(first: DataFrame, second: DataFrame, axes: list[str], least: float = 0.05) -> DataFrame:
    """a_id, b_id and change of two guides (id, name, pos and middles of ``axes``): same, changed, removed or added.

    Names are matched one to one; changed are matches any of whose middles differ by ``least`` or more.
    """
    matches = match_names(first.select("id", "name", "pos"), second.select("id", "name", "pos")).select("a_id", "b_id")
    left = first.select(F.col("id").alias("a_id"), *[F.col(x).alias(f"{x}_a") for x in axes])
    right = second.select(F.col("id").alias("b_id"), *[F.col(x).alias(f"{x}_b") for x in axes])
    both = matches.join(left, "a_id").join(right, "b_id")
    changed = drifted(both, axes, least).select("a_id", "b_id", F.lit("changed").alias("change"))
    same = both.join(changed, ["a_id", "b_id"], "left_anti").select("a_id", "b_id", F.lit("same").alias("change"))
    gone = left.join(matches, "a_id", "left_anti").select("a_id", F.lit(None).cast(dict(right.dtypes)["b_id"]).alias("b_id"), F.lit("removed").alias("change"))
    new = right.join(matches, "b_id", "left_anti").select(F.lit(None).cast(dict(left.dtypes)["a_id"]).alias("a_id"), "b_id", F.lit("added").alias("change"))
    return changed.unionByName(same).unionByName(gone).unionByName(new)


def pairing_score(target: Column, profile: Column, tradition: Column, alpha: Column, cohumulone: Column, ibu: Column) -> Column:
    """How well a hop suits a style, 0 to 1.

    0.55 aroma + 0.25 tradition + 0.2 role, where aroma is the cosine of the style's target and the hop's profile;
    without both, 0.82 (0.55 tradition + 0.45 role). The role is that of the alpha acid for the style's bitterness:
    1 at clamp(ibu / 5, 4, 14) and falling by distance over 14, with 0.15 more or less for low or high cohumulone
    where the style is mild (under 30); 0.7 where either is unknown.
    """
    ideal = F.least(F.greatest(ibu / 5, F.lit(4.0)), F.lit(14.0))
    smooth = F.when((ibu < 30) & (cohumulone <= 25), 0.15).when((ibu < 30) & (cohumulone >= 35), -0.15).otherwise(0.0)
    role = F.greatest(F.lit(0.0), 1 - F.abs(alpha - ideal) / 14) + smooth
    role = F.when(alpha.isNotNull() & ibu.isNotNull(), F.least(F.greatest(role, F.lit(0.0)), F.lit(1.0))).otherwise(0.7)
    both = lambda x: F.when(x["t"].isNotNull() & x["p"].isNotNull(), cosine(x["t"], x["p"]))
    aroma = F.element_at(F.transform(F.array(F.struct(target.alias("t"), profile.alias("p"))), both), 1)
    return F.coalesce(0.55 * aroma + 0.25 * tradition + 0.2 * role, 0.82 * (0.55 * tradition + 0.45 * role))
