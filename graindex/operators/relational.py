"""Selections, paging, samples, pairs and range matches as functions over DataFrames and column names."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .boxes import best_fit_many

#: Range boxes that are held as one array in each task.
FEW_BOXES = 256


def number(value: object) -> float | None:
    """A query parameter as a number; None where it is unset or not a number."""
    try:
        out = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
    return None if math.isnan(out) else out


def clamp_int(value: object, default: int, most: int) -> int:
    """A whole number from 1 to ``most``; unset, unreadable and 0 give ``default``."""
    got = number(value)
    return min(max(int(got) if got and int(got) else default, 1), most)


def range_filters(df: DataFrame, bounds: Mapping[str, tuple[object, object]]) -> DataFrame:
    """Keep rows inside every given (low, high), both inclusive; a bound that is unset or not a number is skipped."""
    for name, (low, high) in bounds.items():
        if (lo := number(low)) is not None:
            df = df.where(F.col(name) >= lo)
        if (hi := number(high)) is not None:
            df = df.where(F.col(name) <= hi)
    return df


def page(df: DataFrame, sort: str, descending: bool, key: str, limit: object = None, offset: int = 0, most: int = 60_000) -> DataFrame:
    """A page in order of a column (nulls last both ways), ties by ``key``."""
    column = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return df.orderBy(column, F.col(key).asc_nulls_last()).offset(offset).limit(clamp_int(limit, 100, most))


#: Rows before an offset that an order may hold, and parts into which a range of values is counted.
HELD, CELLS = 100_000, 4096


def deep_page(df: DataFrame, sort: str, descending: bool, key: str, limit: object = None, offset: int = 0, most: int = 60_000) -> DataFrame:
    """The same as ``page`` for numbers or times far down: only rows around the offset are ordered.

    While the offset is beyond ``HELD`` rows, values are counted in ``CELLS`` equal parts of their range (nulls are the last), and only
    rows of the parts that hold the page stay. Where so many rows share one value, the keys among them are counted the
    same way. ``key`` is a number too, and tells rows apart.
    """
    n = clamp_int(limit, 100, most)
    for column, down in ((sort, descending), (key, False)):
        df, offset = _around(df, column, down, offset, n)
    return page(df, sort, descending, key, n, offset, most)


def _around(df: DataFrame, column: str, descending: bool, offset: int, n: int) -> tuple[DataFrame, int]:
    """Rows by whose values places offset to offset + n are found, and where among them the page begins."""
    kind = dict(df.dtypes)[column]
    v = F.unix_micros(F.col(column).cast("timestamp")).cast("double") if kind.startswith(("timestamp", "date")) else F.col(column).cast("double")
    while offset > HELD:
        low, high, rows = df.agg(F.min(v), F.max(v), F.count(F.lit(1))).first()
        width = (high - low) / CELLS if low is not None else 0.0
        at = F.least(F.floor((v - low) / width), F.lit(CELLS - 1)) if width > 0 else F.lit(0)
        cell = F.when(v.isNull(), CELLS).otherwise(CELLS - 1 - at if descending else at).cast("int")
        before, kept = 0, []
        for r in sorted(df.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()):  # at most CELLS + 1 rows
            if not kept and before + r["n"] <= offset:
                before += r["n"]
            elif not kept or sum(k["n"] for k in kept) + before < offset + n:
                kept.append(r)
        if not kept or sum(k["n"] for k in kept) == rows:
            break
        first, last = kept[0]["cell"], kept[-1]["cell"]
        df = df.where(cell.between(first, last))
        if last < CELLS and width > 0:
            # the same in plain values, a little wider, for the scan to leave out row groups
            ends = (CELLS - 1 - last, CELLS - first) if descending else (first, last + 1)
            df = df.where(v.between(low + (ends[0] - 1) * width, low + (ends[1] + 1) * width))
        offset -= before
    return df, offset


def stable_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows first in order of a hash of ``key``: the same ones in any run and any engine."""
    digest = F.md5(F.col(key).cast("string").cast("binary"))
    return df.orderBy(digest, key).limit(n)


def flatten_struct(df: DataFrame, struct: str, fields: Sequence[str]) -> DataFrame:
    """Struct fields as columns beside the others."""
    return df.select(*[c for c in df.columns if c != struct], *[F.col(f"{struct}.{f}").alias(f) for f in fields])


def nest(df: DataFrame, keys: Sequence[str], fields: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """One row a key with its lines as an ordered array of structs."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*fields).alias("_v")))), lambda x: x["_v"])
    return df.groupBy(*keys).agg(lines.alias(name))


def unnest(df: DataFrame, array: str, keys: Sequence[str]) -> DataFrame:
    """A row for each element of an array of structs; keys without elements vanish."""
    return df.select(*keys, F.explode(array).alias("_e")).select(*keys, "_e.*")


def distinct_members(df: DataFrame, group: str, member: str) -> DataFrame:
    return df.select(group, member).where(F.col(member).isNotNull()).distinct()


def pair_counts(members: DataFrame, group: str, member: str, least: int) -> DataFrame:
    """Unordered pairs of members that share groups, with the number of groups, if ``least`` or more.

    ``members`` is distinct, so a group is a bill of a few entries; the pairs of a group are read from its sorted
    array, without a join.
    """
    bills = members.groupBy(group).agg(F.array_sort(F.collect_list(member)).alias("m"))
    rest = lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("a"), y.alias("b")))
    pairs = bills.where(F.size("m") > 1).select(F.explode(F.flatten(F.transform("m", rest))).alias("p")).select("p.a", "p.b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def pair_lift(members: DataFrame, group: str, member: str, least: int) -> DataFrame:
    """Pairs with lift n * N / (n_a * n_b), where N counts the groups that have a member."""
    single = members.groupBy(member).agg(F.count(F.lit(1)).alias("k"))
    total = members.agg(F.countDistinct(group).alias("total"))
    left, right = (single.select(F.col(member).alias(x), F.col("k").alias(f"n_{x}")) for x in "ab")
    pairs = pair_counts(members, group, member, least).join(left, "a").join(right, "b")
    return pairs.join(F.broadcast(total)).withColumn("lift", F.col("n") * F.col("total") / (F.col("n_a") * F.col("n_b")))


def best_fit(items: DataFrame, key: str, ranges: DataFrame, axes: Sequence[str], name: str) -> DataFrame:
    """The range box that fits each item best: most axes inside; then least mean deviation in half-widths; then name.

    ``ranges`` has name, {axis}_lo and {axis}_hi. Up to ``FEW_BOXES`` of them go to every task as one array, so that items
    are neither joined nor shuffled; more are met in chunks (``boxes.best_fit_many``), with the same result. An axis
    missing on either side is passed over; a box without any common axis doesn't fit; an item that fits none has a null name.
    """
    if ranges.limit(FEW_BOXES + 1).count() > FEW_BOXES:
        return best_fit_many(items, key, ranges, axes, name)
    boxes = ranges.agg(F.array_sort(F.collect_list(F.struct(name, *[c for a in axes for c in (f"{a}_lo", f"{a}_hi")]))).alias("_boxes"))

    def scored(box: Column) -> Column:
        there = [F.col(a).isNotNull() & box[f"{a}_lo"].isNotNull() & box[f"{a}_hi"].isNotNull() for a in axes]
        inside = sum((F.when(t & F.col(a).between(box[f"{a}_lo"], box[f"{a}_hi"]), 1).otherwise(0) for a, t in zip(axes, there, strict=True)), F.lit(0))
        half = [F.greatest((box[f"{a}_hi"] - box[f"{a}_lo"]) / 2, F.lit(1e-9)) for a in axes]
        off = sum((F.when(t, F.abs(F.col(a) - (box[f"{a}_lo"] + box[f"{a}_hi"]) / 2) / h).otherwise(0.0) for a, t, h in zip(axes, there, half, strict=True)), F.lit(0.0))
        n = sum((F.when(t, 1).otherwise(0) for t in there), F.lit(0))
        return F.struct((-inside).alias("rank"), F.when(n > 0, off / n).alias("off"), box[name].alias("name"))

    best = F.array_min(F.filter(F.transform("_boxes", scored), lambda s: s["off"].isNotNull()))
    return items.join(F.broadcast(boxes)).withColumn("_b", best).select(key, F.col("_b.name").alias(name), (-F.col("_b.rank")).alias("inside"), F.col("_b.off").alias("off"))


def box_members(items: DataFrame, box: Mapping[str, tuple[float, float]], tolerance: float) -> DataFrame:
    """Items inside the box widened by ``tolerance`` times its width on every axis; fit counts the axes inside the exact box."""
    for axis, (lo, hi) in box.items():
        slack = tolerance * ((hi - lo) or 1e-9)
        items = items.where(F.col(axis).between(lo - slack, hi + slack))
    fit = sum((F.when(F.col(a).between(lo, hi), 1).otherwise(0) for a, (lo, hi) in box.items()), F.lit(0))
    return items.withColumn("fit", fit)


def union_rekeyed(first: DataFrame, second: DataFrame, key: str, base: int) -> DataFrame:
    """Both tables with an origin; the second one's keys are moved to ``base`` and up, so that none collide."""
    return first.withColumn("origin", F.lit("first")).unionByName(second.withColumn(key, F.col(key) + base).withColumn("origin", F.lit("second")))


def only_in(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the first table whose keys the second doesn't have."""
    return first.join(second.select(*keys), list(keys), "left_anti")


def best_of(df: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each group in an order that leaves no ties."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_r = 1").drop("_r")


def last_wins(df: DataFrame, key: str, position: str) -> DataFrame:
    """Dictionary semantics: of rows with the same key the last in position stays."""
    return best_of(df, key, [F.col(position).desc()])


def search_text(df: DataFrame, query: str, columns: Sequence[str], tags: str | None = None) -> DataFrame:
    """Rows that hold the query in any column, or in a tag, whatever its case."""
    q = F.lit(query.lower())
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), q), F.lit(False))
    if tags:
        hit = hit | F.coalesce(F.exists(tags, lambda t: F.contains(F.lower(t), q)), F.lit(False))
    return df.where(hit)
