"""Selections, orders and shapes that an explorer of documents asks for, over DataFrames and column names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import nearest_blend
from .relational import clamp_int, number, stable_sample


def of_kind(df: DataFrame, kind: str, wanted: str = "beer") -> DataFrame:
    """Rows of a kind; rows without one count as ``wanted``."""
    return df.where(F.coalesce(F.col(kind), F.lit(wanted)) == wanted)


def like(df: DataFrame, column: str, query: str | None) -> DataFrame:
    """Rows whose column holds the query whatever its case; % and _ in it are wildcards. A blank query keeps all."""
    return df.where(F.col(column).ilike(f"%{query}%")) if query else df


def id_order(key: str) -> list[Column]:
    """Order of ids like 9A, 10B, 10C, T1: by the number they begin with (none last), then as names, then as they are."""
    lead = F.nullif(F.regexp_extract(key, r"^([0-9]+)", 1), F.lit("")).try_cast("long")
    return [lead.asc_nulls_last(), F.collate(F.regexp_replace(key, r"^[0-9]+", ""), "UNICODE"), F.col(key)]


def name_order(name: str, capitals_first: bool = False) -> list[Column]:
    """Alphabetical order by the root collation of Unicode: letters first, then accents, then case (small before large, or large before small)."""
    return [F.collate(F.col(name), "UNICODE_CI" if capitals_first else "UNICODE"), F.col(name)]


def top_tags(df: DataFrame, tags: str, n: int = 24) -> DataFrame:
    """The n tags that most rows carry, ties by tag: tag, n."""
    return df.select(F.explode(F.array_distinct(tags)).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(n)


def domains(matches: DataFrame, box: Mapping[str, tuple[float, float]], tolerance: float, pad: float = 0.08) -> DataFrame:
    """axis, low, high: each axis from the least to the largest of the widened box and the rows, and ``pad`` of it more on both sides."""
    ends = matches.agg(*[f(a).alias(f"{n}_{a}") for a in box for n, f in (("lo", F.min), ("hi", F.max))])
    rows = []
    for axis, (lo, hi) in box.items():
        slack = tolerance * ((hi - lo) or 1e-9)
        low, high = F.least(F.lit(float(lo - slack)), F.col(f"lo_{axis}")), F.greatest(F.lit(float(hi + slack)), F.col(f"hi_{axis}"))
        more = F.when(high > low, (high - low) * pad).otherwise(1e-6)
        rows.append(F.struct(F.lit(axis).alias("axis"), (low - more).alias("low"), (high + more).alias("high")))
    return ends.select(F.explode(F.array(*rows)).alias("d")).select("d.*")


def projection_page(points: DataFrame, details: DataFrame, key: str, method: str | None = None, blend: object = None, limit: object = None) -> DataFrame:
    """The points of one projection with the details of their rows: a stable sample in order of a hash of the key.

    ``method`` is umap or else pca; a blend that isn't precomputed gives 0.5; 8000 points unless asked, 60000 at most.
    Points of a method that was never computed are none.
    """
    wanted = number(blend)
    wanted = wanted if wanted in (0.0, 0.5, 1.0) else 0.5
    one = points.where((F.col("method") == ("umap" if method == "umap" else "pca")) & (F.col("blend") == wanted))
    return stable_sample(one.drop("method", "blend").join(details, key), key, clamp_int(limit, 8000, 60_000))


def aligned(points: DataFrame, details: DataFrame, key: str, position: str, blend: float) -> DataFrame:
    """Points of the nearest precomputed blend that have details, in the points' own order."""
    return points.where(F.col("blend") == nearest_blend(blend)).join(details, key).orderBy(position, key)


def display_names(df: DataFrame, key: str, names: DataFrame, name: str, raw: str) -> DataFrame:
    """``df`` with display_name: the name its key is known by, else its raw name. Keys of ``names`` are distinct."""
    known = names.select(F.col(key).alias("_key"), F.col(name).alias("_name"))
    return df.join(known, F.col(key) == F.col("_key"), "left").withColumn("display_name", F.coalesce("_name", raw)).drop("_key", "_name")


def detail(df: DataFrame, key: str, wanted: object, bills: Mapping[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """One row by key with each bill (rows, its key, its amount, its tie key) as an array of structs in descending order of amount.

    Keys are looked up before anything is grouped; an unknown key gives no row, a row without lines empty bills.
    """
    one = df.where(F.col(key) == F.lit(wanted))
    for name, (rows, of, amount, tie) in bills.items():
        fields = [c for c in rows.columns if c != of]
        order = F.struct((-F.col(amount)).alias("o"), F.col(tie).alias("t"), F.struct(*fields).alias("v"))
        lines = rows.where(F.col(of) == F.lit(wanted)).groupBy(F.col(of).alias(key)).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["v"]).alias(name))
        one = one.join(lines, key, "left").withColumn(name, F.coalesce(name, F.expr("array()")))
    return one


def by_stage(lines: Column, stage: str, stages: Sequence[str]) -> Column:
    """An array of structs as array<struct<stage, lines>> in a fixed order of stages; stages without lines are left out."""
    def of(name: str) -> Column:
        return F.struct(F.lit(name).alias("stage"), F.filter(lines, lambda x: x[stage] == name).alias("lines"))

    groups = F.array(*[of(s) for s in stages])
    return F.filter(groups, lambda g: F.size(g["lines"]) > 0)


def tree(df: DataFrame, path: Sequence[str], leaves: str | None = None, times: str | None = None) -> DataFrame:
    """Rows of a tree over ``path`` columns, the last of them the items: level, path, n (items below) and, for items, their leaves.

    The root has level 0 and path 'all'. With ``times`` a row of ``df`` counts as often as that column says, so that
    alike rows, with their leaves, need enter the one roll-up only once.
    """
    more = [F.max(leaves).alias("leaves")] if leaves else []
    many = F.coalesce(F.sum(times), F.lit(0)) if times else F.count(F.lit(1))
    rolled = df.rollup(*path).agg(many.alias("n"), F.grouping_id().alias("g"), *more)
    level = F.lit(len(path)) - F.bit_count("g")
    out = [level.cast("int").alias("level"), F.concat_ws("/", F.lit("all"), *[F.when(level > i, F.col(c)) for i, c in enumerate(path)]).alias("path"), "n"]
    return rolled.select(*out, *([F.when(level == len(path), F.col("leaves")).alias("leaves")] if leaves else []))


def first_then_sort(df: DataFrame, order: Sequence[Column], n: int, by: Sequence[Column]) -> DataFrame:
    """The first n rows of one order, in another order."""
    return df.orderBy(*order).limit(n).orderBy(*by)


def spread_out(df: DataFrame, column: str, name: str, log: bool = False) -> DataFrame:
    """The column scaled to 0 to 1 between its least and largest value, or by log10(1 + x) over log10(1 + largest)."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))  # one row
    x = F.col(column)
    if log:
        scaled = F.log10(1 + x) / F.log10(1 + F.greatest("_hi", F.lit(1.0)))
    else:
        scaled = (x - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    return df.join(F.broadcast(ends)).withColumn(name, scaled).drop("_lo", "_hi")
