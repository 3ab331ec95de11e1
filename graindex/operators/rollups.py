"""Roll-ups: usage, leaderboards by group and overall, histograms, quantiles, deviations, labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import cut


def usage(df: DataFrame, item: str, group: str, **more: Column) -> DataFrame:
    """Per item: distinct groups that use it, and further aggregates."""
    return df.groupBy(item).agg(F.countDistinct(group).alias("n_groups"), *[c.alias(n) for n, c in more.items()])


def mode_by(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the least."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("_m")).select(*keys, F.col("_m.v").alias(value))


def at_place(df: DataFrame, keys: Sequence[str], value: str, place: Callable[[Column], Column], times: str | None = None) -> DataFrame:
    """keys and ``value``: the value at a place (from 0, a function of their number) among the ordered values of each key.

    Nulls don't count; with ``times`` a value counts as often as that column says. Values are counted in ranges first, some 4000 to each power of two, then only those of the range
    that holds the place by value, so no group of values is ever ordered as a whole or held in one buffer.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    size = F.floor(F.log2(F.abs(v)) * 4096) + 1100 * 4096
    ranges = F.when(v > 0, size).when(v < 0, -size).otherwise(0)
    rows = df.where(F.col(value).isNotNull()).withColumn("_range", ranges.cast("long"))
    by = Window.partitionBy(*keys)
    upto = lambda order: by.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    many = F.sum(times) if times else F.count(F.lit(1))
    counts = rows.groupBy(*keys, "_range").agg(many.alias("_n"))
    counts = counts.withColumn("_upto", F.sum("_n").over(upto("_range"))).withColumn("_place", place(F.sum("_n").over(by)))
    target = counts.where("_place < _upto and _place >= _upto - _n").select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_range").alias("_of"), (F.col("_place") - F.col("_upto") + F.col("_n")).alias("_place"))
    same = F.col("_range") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    inside = rows.join(target, same).groupBy(*keys, value).agg(many.alias("_n"), F.min("_place").alias("_place"))
    inside = inside.withColumn("_upto", F.sum("_n").over(upto(value)))
    return inside.where("_place < _upto and _place >= _upto - _n").select(*keys, value)


def by_family_and_all(df: DataFrame, family: str, keys: Sequence[str], *aggregates: Column, all_name: str = "all") -> DataFrame:
    """Aggregates by (family, keys) and by keys over all families, in one pass of grouping sets; the whole is named ``all_name``."""
    sets = [[F.col(family), *map(F.col, keys)], [F.col(k) for k in keys]]
    got = df.groupingSets(sets, family, *keys).agg(*aggregates, F.grouping(family).alias("_whole"))
    return got.withColumn(family, F.when(F.col("_whole") == 1, F.lit(all_name)).otherwise(F.col(family))).drop("_whole")


def leaderboard(df: DataFrame, family: str, group: str, item: str, stage: str, stages: Sequence[str], amount: str, batch: str, n: int = 40, all_name: str = "all") -> DataFrame:
    """By family and over all, the n items that most groups use (ties by item): rank, n_groups, total amount, the amount
    in each stage (null without), and the upper median of the groups' doses.

    The dose of a group is its amount over its batch, where that isn't null or 0. Rows without an item are left out. A
    row for each group and item is made first; then grouping sets over families, and the value at floor(n / 2).
    """
    in_stage = [F.sum(F.when(F.col(stage) == s, F.col(amount))).alias(f"_s{i}") for i, s in enumerate(stages)]
    each = df.where(F.col(item).isNotNull()).groupBy(family, group, item).agg(F.sum(amount).alias("amount"), F.min(batch).alias("_batch"), *in_stage)
    # written out: it is read by the sums, and twice by the medians
    each = cut(each.withColumn("dose", F.when(F.col("_batch") != 0, F.col("amount") / F.col("_batch"))))
    sums = [F.count(F.lit(1)).alias("n_groups"), F.sum("amount").alias("total"), *[F.sum(f"_s{i}").alias(s) for i, s in enumerate(stages)]]
    board = top_by(by_family_and_all(each, family, [item], *sums, all_name=all_name), [family], [F.desc("n_groups"), F.col(item)], n)
    doses = by_family_and_all(each.where("dose is not null"), family, [item, "dose"], F.count(F.lit(1)).alias("times"), all_name=all_name)
    medians = at_place(cut(doses), [family, item], "dose", lambda k: F.floor(k / 2), "times")
    return board.join(medians.withColumnRenamed("dose", "median_dose"), [family, item], "left")


def top_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def zero_filled_share(df: DataFrame, family: str, group: str, kind: str, share: str) -> DataFrame:
    """Mean share of each kind over all groups of a family: a group without the kind counts as 0."""
    totals = df.groupBy(family).agg(F.countDistinct(group).alias("n_groups"))
    sums = df.groupBy(family, kind).agg(F.sum(share).alias("s"), F.countDistinct(group).alias("n_with"))
    return sums.join(totals, family).select(family, kind, "n_with", (F.col("s") / F.col("n_groups")).alias("mean_share"))


def share_breakdown(df: DataFrame, family: str, group: str, kind: str, key: str, name: str, share: str, all_name: str = "all") -> DataFrame:
    """By family and over all, inside each kind: per key its most frequent raw name, its mean share over all groups, and
    the groups that have it: family, kind, key, name, mean_share, n_with."""
    totals = by_family_and_all(df.select(family, group).distinct(), family, [], F.count(F.lit(1)).alias("n_groups"), all_name=all_name)
    each = df.groupBy(family, group, kind, key).agg(F.sum(share).alias("s"))
    got = by_family_and_all(each, family, [kind, key], F.sum("s").alias("s"), F.count(F.lit(1)).alias("n_with"), all_name=all_name)
    spelt = by_family_and_all(df, family, [kind, key, name], F.count(F.lit(1)).alias("n"), all_name=all_name)
    names = spelt.groupBy(family, kind, key).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(name).alias("v"))).alias("m")).select(family, kind, key, F.col("m.v").alias(name))
    return got.join(totals, family).join(names, [family, kind, key]).select(family, kind, key, name, (F.col("s") / F.col("n_groups")).alias("mean_share"), "n_with")


def outcomes(df: DataFrame, family: str, values: Sequence[str], all_name: str = "all") -> DataFrame:
    """By family and over all: n and the mean of each value over the rows that have it."""
    return by_family_and_all(df, family, [], F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"avg_{v}") for v in values], all_name=all_name)


def code_board(df: DataFrame, code: str, name: str, family: str, value: str, low: float, high: float, n: int) -> DataFrame:
    """The n most frequent codes (ties by code): most frequent name and family, share of all rows, and the median of the
    values strictly between ``low`` and ``high``."""
    rows = df.where(F.col(code).isNotNull())
    total = df.agg(F.count(F.lit(1)).alias("total"))
    inside = F.when((F.col(value) > low) & (F.col(value) < high), F.col(value))
    got = rows.groupBy(code).agg(F.count(F.lit(1)).alias("n"), F.percentile(inside, F.lit(0.5)).alias("median"))
    got = got.orderBy(F.desc("n"), code).limit(n)
    for column in (name, family):
        got = got.join(mode_by(rows, [code], column), code)
    # one row by construction
    return got.join(F.broadcast(total)).select(code, name, "n", (F.col("n") / F.col("total")).alias("share"), "median", family)


def ratio_to_total(df: DataFrame, group: str, amount: str, name: str = "pct") -> DataFrame:
    """Each row's share of its group's total in percent, 0 where the total is 0."""
    total = F.sum(amount).over(Window.partitionBy(group))
    return df.withColumn(name, F.when(total > 0, F.col(amount) / total * 100).otherwise(F.lit(0.0)))


def histogram(df: DataFrame, value: str, low: float, high: float, step: float) -> DataFrame:
    """Counts in fixed bins, with values beyond the ends in the end bins and empty bins kept: bin, bin_low, n."""
    bins = round((high - low) / step)
    at = F.least(F.greatest(F.floor((F.col(value) - low) / step), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.lit(low) + F.col("bin") * step).alias("bin_low"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def percentile_of(bins: DataFrame, value: float, low: float, step: float) -> DataFrame:
    """The percentage of a histogram below a value, with linear interpolation inside its bin; 50 if it is empty."""
    place = (value - low) / step
    inside = F.least(F.greatest(F.lit(place) - F.col("bin"), F.lit(0.0)), F.lit(1.0))
    total = F.sum("n")
    share = F.sum(F.col("n") * inside) / total * 100
    return bins.agg(F.when(total > 0, F.least(F.greatest(share, F.lit(0.0)), F.lit(100.0))).otherwise(50.0).alias("percentile"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """Interpolated quantiles as columns p5, p25 and so on."""
    got = df.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(s) for s in shares])).alias("q"))
    return got.select(*keys, *[F.col("q")[i].alias(f"p{round(s * 100)}") for i, s in enumerate(shares)])


def deviation(df: DataFrame, family: str, axes: Sequence[tuple[str, str, str]], least: int) -> DataFrame:
    """Mean of (value - middle) / half-width by family, for families of ``least`` rows or more; axes are (value, low, high)."""
    def off(v: str, lo: str, hi: str) -> Column:
        half = (F.col(hi) - F.col(lo)) / 2
        return F.avg(F.when(half > 0, (F.col(v) - (F.col(lo) + F.col(hi)) / 2) / half))

    return df.groupBy(family).agg(F.count(F.lit(1)).alias("n"), *[off(*a).alias(f"{a[0]}_dev") for a in axes]).where(F.col("n") >= least)


def vocabulary(df: DataFrame, tags: str, least: int) -> DataFrame:
    """Tags that ``least`` rows or more carry."""
    return df.select(F.explode(F.array_distinct(tags)).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def cluster_labels(members: DataFrame, cluster: str, tags: str, top: int = 3, share: int = 3) -> DataFrame:
    """A label for each cluster: its tags of highest lift p(tag in cluster) / p(tag) with enough support, joined.

    Support is max(2, the cluster's size over ``share``). A cluster without such a tag is 'mixed'. Ties go to the tag's name.
    """
    rows = members.select(cluster, F.explode_outer(F.array_distinct(tags)).alias("tag"))
    sizes = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    total = members.agg(F.count(F.lit(1)).alias("total"))
    overall = rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n_all"))
    inside = rows.where("tag is not null").groupBy(cluster, "tag").agg(F.count(F.lit(1)).alias("n"))
    lift = (F.col("n") / F.col("size")) / (F.col("n_all") / F.col("total"))
    scored = inside.join(sizes, cluster).join(overall, "tag").join(F.broadcast(total)).where(F.col("n") >= F.greatest(F.lit(2.0), F.col("size") / share)).withColumn("lift", lift)
    ranked = top_by(scored, [cluster], [F.desc(F.round("lift", 9)), F.col("tag")], top)
    labels = ranked.groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]), " · ").alias("label"))
    return sizes.join(labels, cluster, "left").select(cluster, "size", F.coalesce("label", F.lit("mixed")).alias("label"))
