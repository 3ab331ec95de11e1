"""Similarity of vectors and sets.

A search holds a stated set of queries against all rows, block by block. A similarity join finds every pair above a
threshold: equal rows are one class first, and blocks that can't hold a pair are left out exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from ..functions.units import euclidean
from .rollups import top_by
from .steps import cut, worked_out

#: Queries and rows that meet in one block of a search; rows of a block of a join, and its pivots.
BLOCK_QUERIES, BLOCK_ROWS, BLOCK, PIVOTS = 500, 20_000, 4096, 32
#: Blocks of each side of a silhouette at most.
SIDES = 16
#: Queries and rows of a block of a vector search, and of what a task holds of it at a time; ranges of distances to a power of two.
SEARCH_QUERIES, SEARCH_ROWS, TILE, RANGES = 1024, 20_000, (64, 2048), 512


def held_against(queries: DataFrame, rows: DataFrame, q_key: str, key: str) -> DataFrame:
    """Every query with every row, by an equi-join on (query block, row block), so that no side is broadcast.

    The number of blocks follows the counts of both sides; each block of queries meets each block of rows once.
    """
    nq = 1 + queries.count() // BLOCK_QUERIES
    nr = 1 + rows.count() // BLOCK_ROWS
    part = lambda k, n: F.pmod(F.xxhash64(k), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = queries.withColumn("_q", part(q_key, nq)).withColumn("_r", every(nr))
    right = rows.withColumn("_r", part(key, nr)).withColumn("_q", every(nq))
    return left.join(right, ["_q", "_r"]).drop("_q", "_r")


def top_k(scored: DataFrame, query: str, score: str, key: str, k: int) -> DataFrame:
    """The k highest scores of each query with their rank; ties to the smaller key."""
    return top_by(scored, [query], [F.desc(score), F.col(key)], k)


def top_both_ways(scored: DataFrame, a: str, b: str, score: str, k_a: int, k_b: int) -> DataFrame:
    """The k_a best b of each a, and the k_b best a of each b: direction, a, b, score, rank."""
    one = top_k(scored, a, score, b, k_a).select(F.lit(f"{b} of {a}").alias("direction"), a, b, score, "rank")
    two = top_k(scored, b, score, a, k_b).select(F.lit(f"{a} of {b}").alias("direction"), a, b, score, "rank")
    return one.unionByName(two)


def _in_blocks(rows: DataFrame, is_query: Column, columns: Sequence[str], known: DataFrame | None = None) -> tuple[GroupedData, GroupedData]:
    """Queries and rows dealt to blocks: each block of queries meets each block of rows once, in one task.

    ``known`` (query_id and what a task must know of a query) is joined to the queries.
    """
    queries = rows.where(is_query)
    ni, nj = 1 + queries.count() // SEARCH_QUERIES, 1 + rows.count() // SEARCH_ROWS
    if known is not None:
        queries = queries.join(known.withColumnRenamed("query_id", "id"), "id")
        columns_of_queries = [*columns, *[c for c in known.columns if c != "query_id"]]
    else:
        columns_of_queries = columns
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(part(ni).alias("i"), every(nj).alias("j"), *columns_of_queries)
    right = rows.select(every(ni).alias("i"), part(nj).alias("j"), *columns)
    left = left.toDF(*left.columns)  # both sides may come from the same table
    return tuple(x.repartition(ni * nj, "i", "j").groupBy("i", "j") for x in (left, right))


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision, filled up with zeros to one width, and their lengths: -1, all zeros, where one is null or holds a null."""
    listed = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = listed.flatten()
    of = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    x = np.zeros((len(size), int(size.max(initial=0))))
    x[of, at] = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
    size[of[values.is_null().to_numpy(zero_copy_only=False)]] = -1
    size[listed.is_null().to_numpy(zero_copy_only=False)] = -1
    x[size < 0] = 0
    return x, size


def _matrices(ours: pa.Table, theirs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of queries and rows, and which pairs can be compared."""
    (x, n), (y, m) = _matrix(ours["v"]), _matrix(theirs["v"])
    wide = max(x.shape[1], y.shape[1])
    x, y = (np.pad(z, ((0, 0), (0, wide - z.shape[1]))) for z in (x, y))
    return x, y, (n[:, None] == m[None, :]) & (n[:, None] >= 0)


def _tiles(n: int, m: int, tile: tuple[int, int] | None = None) -> Iterator[tuple[slice, slice]]:
    """Parts of n queries by m rows, of which a task holds one at a time."""
    tile = tile or TILE
    for lo in range(0, n, tile[0]):
        for at in range(0, m, tile[1]):
            yield slice(lo, min(n, lo + tile[0])), slice(at, min(m, at + tile[1]))


class _Best:
    """The k best rows of each query of a block: highest score, a NaN above all, of equal ones the first row."""

    def __init__(self, queries: int, k: int) -> None:
        self.score = np.full((queries, k), -np.inf)
        self.row = np.full((queries, k), -1)

    def add(self, of: slice, rows: slice, score: np.ndarray, allowed: np.ndarray) -> None:
        score = np.where(np.isnan(score), np.inf, score)
        score[~allowed] = -np.inf
        for q in np.flatnonzero((score > self.score[of, -1:]).any(1)):
            new = np.flatnonzero(score[q] > self.score[of.start + q, -1])
            scores, places = np.append(self.score[of.start + q], score[q, new]), np.append(self.row[of.start + q], new + rows.start)
            best = np.lexsort((places, -scores))[: self.score.shape[1]]
            self.score[of.start + q], self.row[of.start + q] = scores[best], places[best]

    def found(self, queries: pa.Table, rows: pa.Table) -> pa.Table:
        q, c = np.nonzero(self.row >= 0)
        score = self.score[q, c]
        columns = [t["id"].take(pa.array(at)) for t, at in ((queries, q), (rows, self.row[q, c]))]
        return pa.table([*columns, pa.array(np.where(np.isinf(score), np.nan, score))], names=["query_id", "id", "score"])


def _others(ours: pa.Table, theirs: pa.Table) -> np.ndarray:
    return ours["id"].to_numpy()[:, None] != theirs["id"].to_numpy()[None, :]


def cosine_search(rows: DataFrame, is_query: Column, key: str, vector: str, k: int, digits: int = 9) -> DataFrame:
    """The k rows of highest cosine to each query row, but itself; 0 where a norm is 0 or two vectors can't be compared.

    A block of queries meets a block of rows as matrices in one task, from which only the k best of each query go on.
    """
    v = rows.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    kind = dict(v.dtypes)["id"]

    def best(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        theirs = theirs.sort_by("id")
        x, y, both = _matrices(ours, theirs)
        norm_x, norm_y = (np.sqrt((z * z).sum(1)) for z in (x, y))
        others, held = _others(ours, theirs), _Best(len(x), k)
        for q, r in _tiles(len(x), len(y)):
            norm = norm_x[q, None] * norm_y[None, r]
            with np.errstate(invalid="ignore", divide="ignore"):
                score = np.where(both[q, r] & ~(norm <= 0), x[q] @ y[r].T / norm, 0.0)
            held.add(q, r, np.round(score, digits), others[q, r])
        return held.found(ours, theirs)

    left, right = _in_blocks(v, is_query, ["id", "v"])
    near = left.cogroup(right).applyInArrow(best, f"query_id {kind}, id {kind}, score double")
    return top_k(near.withColumn("score", F.round("score", digits)), "query_id", "score", "id", k)


def nearest_boxes(items: DataFrame, key: str, vector: str, others: DataFrame, other_key: str, other_vector: str, k: int) -> DataFrame:
    """The k nearest of a second table for each item (Euclidean), items against all of it in blocks: key, other_key, distance, rank."""
    queries = items.select(key, F.col(vector).alias("qv"))
    pairs = held_against(queries, others.select(other_key, F.col(other_vector).alias("v")), key, other_key)
    scored = pairs.select(key, other_key, euclidean(F.col("qv"), F.col("v")).alias("distance"))
    return top_by(scored, [key], [F.col("distance"), F.col(other_key)], k)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed in order of the axes, so that a pair has the same one in every pass."""
    total, axes = np.zeros((len(x), len(y))), np.ascontiguousarray(y.T)
    for i in range(x.shape[1]):
        apart = x[:, i, None] - axes[i]
        apart *= apart
        total += apart
    return np.sqrt(total)


def _ranges(d: np.ndarray) -> np.ndarray:
    """Numbers of ranges of distances in order, ``RANGES`` to each power of two; 0 first, NaN last."""
    with np.errstate(divide="ignore", invalid="ignore"):
        size = np.floor(np.log2(d) * RANGES)
    return np.nan_to_num(np.where(np.isnan(d), np.inf, size), posinf=1 << 30, neginf=-(1 << 30)).astype(np.int32)


def _jaccards(ours: pa.Table, theirs: pa.Table) -> tuple[np.ndarray, np.ndarray, Callable[[slice], np.ndarray]]:
    """Numbers of the tag sets of queries and rows, and the similarities of all sets of queries with a part of those of rows."""
    kinds, numbers = [], []
    for t in (ours, theirs):
        place: dict[frozenset, int] = {}
        numbers.append(np.array([place.setdefault(frozenset(tags or ()), len(place)) for tags in t["t"].to_pylist()], np.int64))
        kinds.append(list(place))
    names = {tag: i for i, tag in enumerate(set().union(*kinds[0]) & set().union(*kinds[1]))}

    def flags(sets: list[frozenset]) -> np.ndarray:
        out = np.zeros((len(sets), len(names)), np.float32)
        for i, tags in enumerate(sets):
            out[i, [names[tag] for tag in tags if tag in names]] = 1
        return out

    mine, size = flags(kinds[0]), np.array([len(s) for s in kinds[0]], np.float64)

    def with_rows(part: np.ndarray) -> np.ndarray:
        sets = [kinds[1][i] for i in part]
        both = (mine @ flags(sets).T).astype(np.float64)
        either = size[:, None] + np.array([len(s) for s in sets], np.float64)[None, :] - both
        return np.divide(both, either, out=np.zeros_like(both), where=either > 0)

    return numbers[0], numbers[1], with_rows


def blend_search(rows: DataFrame, is_query: Column, key: str, vector: str, tags: str, alpha: float, k: int) -> DataFrame:
    """The k rows of highest alpha * Jaccard(tags) + (1 - alpha) * max(0, 1 - distance / scale) to each query.

    The scale of a query is its distances' value at place floor(0.95 n) in order, its own distance 0 among them; 1
    where that is 0. Blocks of queries meet blocks of rows three times: to count the distances of each query in ranges, to
    find the value at its place in the one range that holds it, and for the scores. Distances never leave their task but
    those of that range.
    """
    v = rows.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.col(tags).alias("t"))
    kind = dict(v.dtypes)["id"]

    def listed(ours: pa.Table, found: list[tuple[int, np.ndarray, np.ndarray]], value: pa.DataType) -> pa.Table:
        sizes = np.array([len(x) for _, x, _ in found], np.int64)
        ids = ours["id"].take(pa.array(np.repeat(np.array([q for q, _, _ in found], np.int64), sizes)))
        at, n = (np.concatenate([np.zeros(0, t), *[f[i] for f in found]]) for i, t in ((1, np.float64), (2, np.int64)))
        return pa.table([ids, pa.array(at).cast(value), pa.array(n.astype(np.int64))], names=["query_id", "at", "n"])

    def counted(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        x, y, both = _matrices(ours, theirs)
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for lo in range(0, len(x), TILE[0]):
            q = slice(lo, min(len(x), lo + TILE[0]))
            of = _ranges(np.concatenate([_distances(x[q], y[r]) for _, r in _tiles(1, len(y))], 1))
            found += [(lo + i, *np.unique(of[i][both[lo + i]], return_counts=True)) for i in range(len(of))]
        return listed(ours, found, pa.int32())

    def inside(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        x, y, both = _matrices(ours, theirs)
        wanted = ours["at"].to_numpy()
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for q, r in _tiles(len(x), len(y)):
            d = _distances(x[q], y[r])
            here = (_ranges(d) == wanted[q, None]) & both[q, r]
            found += [(q.start + i, *np.unique(d[i][here[i]], return_counts=True)) for i in np.flatnonzero(here.any(1))]
        return listed(ours, found, pa.float64())

    def best(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        theirs = theirs.sort_by("id")
        x, y, both = _matrices(ours, theirs)
        scale, held, others = ours["s"].to_numpy(), _Best(len(x), k), _others(ours, theirs)
        our_sets, their_sets, jaccards = _jaccards(ours, theirs)
        for q, r in _tiles(len(x), len(y)):
            sets, of = np.unique(their_sets[r], return_inverse=True)
            near = np.where(both[q, r], 1 - _distances(x[q], y[r]) / scale[q, None], 0)
            score = alpha * jaccards(sets)[our_sets[q]][:, of] + (1 - alpha) * np.maximum(near, 0)
            held.add(q, r, np.round(score, 9), others[q, r])
        return held.found(ours, theirs)

    upto = Window.partitionBy("query_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = lambda df: df.groupBy("query_id", "at").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(upto))
    left, right = _in_blocks(v, is_query, ["id", "v"])
    counts = total(left.cogroup(right).applyInArrow(counted, f"query_id {kind}, at int, n long"))
    counts = counts.withColumn("place", F.floor(F.sum("n").over(Window.partitionBy("query_id")) * 0.95))
    target = cut(counts.where("place < upto and place >= upto - n").select("query_id", "at", (F.col("place") - F.col("upto") + F.col("n")).alias("place")))
    left, right = _in_blocks(v, is_query, ["id", "v"], target.drop("place"))
    values = total(left.cogroup(right).applyInArrow(inside, f"query_id {kind}, at double, n long")).join(target.select("query_id", "place"), "query_id")
    scales = cut(values.where("place < upto and place >= upto - n").select("query_id", F.when(F.col("at") > 0, F.col("at")).otherwise(1.0).alias("s")))
    left, right = _in_blocks(v, is_query, ["id", "v", "t"], scales)
    scored = left.cogroup(right).applyInArrow(best, f"query_id {kind}, id {kind}, score double")
    return top_k(scored.withColumn("score", F.round("score", 9)), "query_id", "score", "id", k)


def vector_classes(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Equal vectors as one class: rep (the least key), v and size; null vectors have no class."""
    v = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    return v.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"))


def cosine_join(classes: DataFrame, threshold: float) -> DataFrame:
    """a, b (a < b) and score of all pairs of ``classes`` (rep, v) whose cosine is ``threshold`` or more.

    Rows go to the cell of their nearest pivot (a bounded sample), cells are cut into blocks by a hash. By the triangle
    inequality of angles, two cells meet only if their pivots are no further apart than both cells are wide and the
    threshold's angle together; each block then meets each block of such a cell in one task, which gives only pairs
    that reach the threshold. Nothing that could reach it is left out. Vectors of norm 0 have cosine 0 to all.
    """
    spark = classes.sparkSession
    rows = classes.select("rep", "v").where(F.exists("v", lambda x: x != 0))
    drawn = rows.orderBy(F.xxhash64("v"), "rep").limit(PIVOTS).collect()
    if not drawn:
        return spark.createDataFrame([], f"a {dict(rows.dtypes)['rep']}, b {dict(rows.dtypes)['rep']}, score double")
    unit = lambda x: x / np.sqrt((x * x).sum(1, keepdims=True))
    pivots = unit(np.array([r["v"] for r in drawn], np.float64))
    kind = dict(rows.dtypes)["rep"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(np.array(batch.column("v").to_pylist(), np.float64))
                near = x @ pivots.T
                cell = near.argmax(1)
                angle = np.arccos(np.clip(near[np.arange(len(x)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(angle)], ["rep", "x", "cell", "angle"])

    cells = rows.mapInArrow(placed, f"rep {kind}, x binary, cell int, angle double")
    known = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("wide")).collect()  # one row a pivot
    apart = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6
    parts = {r["cell"]: 1 + r["n"] // BLOCK for r in known}
    meets = [(a["cell"], parts[a["cell"]], b["cell"], parts[b["cell"]]) for a in known for b in known if apart[a["cell"], b["cell"]] <= a["wide"] + b["wide"] + reach]
    table = spark.createDataFrame(meets, "cell int, parts int, other int, other_parts int")
    mine = F.struct(F.col("cell").alias("c"), F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("p"))
    met = cells.join(F.broadcast(table), "cell").withColumn("mine", mine)  # at most PIVOTS ** 2 rows
    met = met.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1))).withColumn("its", F.struct(F.col("other").alias("c"), "p"))
    met = met.select(F.least("mine", "its").alias("i"), F.greatest("mine", "its").alias("j"), (F.col("mine") <= F.col("its")).alias("first"), "rep", "x")

    def compared(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x, ids = np.frombuffer(b"".join(part["x"]), np.float64).reshape(len(part), -1), part["rep"].to_numpy()
        same = tuple(keys[0].values()) == tuple(keys[1].values())
        left = np.arange(len(part)) if same else np.flatnonzero(part["first"])
        right = np.arange(len(part)) if same else np.flatnonzero(~part["first"])
        out = []
        for lo in range(0, len(left), 512):
            rows = left[lo : lo + 512]
            score = x[rows] @ x[right].T
            i, j = np.nonzero(score >= threshold - 1e-9)
            a, b = ids[rows[i]], ids[right[j]]
            keep = (a < b) if same else (a != b)
            exact = (x[rows[i]][keep] * x[right[j]][keep]).sum(1)
            out.append(pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "score": exact}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "score": []})

    pairs = met.groupBy("i", "j").applyInPandas(compared, f"a {kind}, b {kind}, score double")
    return pairs.where(F.round("score", 9) >= threshold)


def threshold_edges(pairs: DataFrame, a: str, b: str, score: str, threshold: float, listed: DataFrame | None = None) -> DataFrame:
    """Edges of ``threshold`` or more, weighted (score - t) / (1 - t), without those in ``listed`` (a, b in either order)."""
    low, high = F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
    edges = pairs.where(F.col(score) >= threshold).select(low, high, ((F.col(score) - threshold) / (1 - threshold)).alias("weight"))
    edges = edges.dropDuplicates(["a", "b"])
    return edges if listed is None else edges.join(listed.select(low, high).distinct(), ["a", "b"], "left_anti")


def set_classes(sets: DataFrame, key: str, member: str) -> DataFrame:
    """Keys with equal member sets as one class: k, and rep, the least key of the class. Null members count for nothing."""
    rows = sets.select(F.col(key).alias("k"), F.col(member).alias("m")).where("m is not null")
    bags = rows.groupBy("k").agg(F.array_sort(F.collect_set("m")).alias("s"))
    reps = bags.groupBy("s").agg(F.min("k").alias("rep"))
    return bags.join(reps, "s").select("k", "rep")


def jaccard_pairs(sets: DataFrame, key: str, member: str, least: float) -> DataFrame:
    """Pairs (a < b) of classes of equal sets, by their least keys, with a Jaccard similarity of ``least`` (above 0) or more.

    A prefix filter by the rarest members: two sets that alike share one of the first n - ceil(least * n) + 1 members, in
    order of frequency, of the larger and one of the first n - ceil(2 * least / (1 + least) * n) + 1 of the smaller, so
    only those are joined. What a pair has in common is worked out once, where the places and sizes still allow the
    similarity, and counts only at its first common member; sets travel with their prefixes, so nothing is fetched
    again. set_classes tells which key is in which class.
    """
    rows = sets.select(F.col(key).alias("k"), F.col(member).alias("m")).where("m is not null").distinct()
    often = rows.groupBy("m").agg(F.count(F.lit(1)).alias("f"))
    bags = rows.join(often, "m").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("f", "m"))).alias("s"))
    bags = bags.select("k", F.col("s.m").alias("s")).groupBy("s").agg(F.min("k").alias("k"))
    size = F.size("s")

    def heads(i: str, share: float) -> DataFrame:
        first = (size - F.ceil(size * F.lit(share) - 1e-9) + 1).cast("int")
        return bags.select(F.col("k").alias(i), F.col("s").alias(f"s{i}"), F.posexplode(F.slice("s", F.lit(1), first)).alias(f"at{i}", "m"))

    nx, ny = F.size("sx"), F.size("sy")
    # what both still can share from here on, this member included; x is the smaller set, or has the lesser key
    most = F.least(nx - F.col("atx"), ny - F.col("aty"))
    ordered = (nx < ny) | ((nx == ny) & (F.col("x") < F.col("y")))
    met = heads("x", 2 * least / (1 + least)).join(heads("y", least), "m").where(ordered & (most >= F.lit(least) / (1 + least) * (nx + ny) - 1e-9))
    # in the order of x, so the first is the first that both have
    met = worked_out(met, (F.get("both", F.lit(0)) == F.col("m")) & (F.size("both") / (nx + ny - F.size("both")) >= least), both=F.array_intersect("sx", "sy"))
    both = F.size("both")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (both / (nx + ny - both)).alias("jaccard"))


def silhouettes(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Silhouette (Euclidean distances) of every row: key, silhouette; none in a cluster of one or a lone cluster.

    Each block of rows meets each block of all rows in one task, which sums distances by label there; only those sums,
    a row for each key and label, are shuffled on. There are at most ``SIDES`` blocks, so that a row crosses the shuffle
    a bounded number of times, whatever their number; blocks of many rows are compared a part at a time.
    """
    v = rows.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    v = v.where("v is not null and label is not null")
    parts = min(SIDES, 1 + v.count() // BLOCK)
    mine = F.pmod(F.xxhash64("id"), F.lit(parts)).alias("i")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    kind = {n: t for n, t in v.dtypes}
    left, right = v.select(mine, every.alias("j"), "id", "v", "label"), v.select(mine.alias("j"), every.alias("i"), F.col("v").alias("w"), F.col("label").alias("of"))

    def sums(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        (x, _), (y, _) = _matrix(ours["v"]), _matrix(theirs["w"])
        labels = pc.unique(theirs["of"])
        of = pc.index_in(theirs["of"], labels).to_numpy()
        n = np.bincount(of, minlength=len(labels))
        total = np.zeros((len(x), len(labels)))
        if len(x) and len(y):
            for q, r in _tiles(len(x), len(y), (256, BLOCK)):
                d = np.sqrt(np.maximum(((x[q, None] - y[None, r]) ** 2).sum(2) if len(y[r]) * x.shape[1] < 200_000 else _squared(x[q], y[r]), 0))
                flags = np.zeros((len(d[0]), len(labels)))
                flags[np.arange(len(flags)), of[r]] = 1
                total[q] += d @ flags
        at, place = np.repeat(np.arange(len(x)), len(labels)), np.tile(np.arange(len(labels)), len(x))
        columns = [ours["id"].take(pa.array(at)), ours["label"].take(pa.array(at)), labels.take(pa.array(place))]
        return pa.table([*columns, pa.array(total.ravel()), pa.array(n[place])], names=["id", "own", "label", "s", "n"])

    schema = f"id {kind['id']}, own {kind['label']}, label {kind['label']}, s double, n long"
    left, right = (x.repartition(parts * parts, "i", "j").groupBy("i", "j") for x in (left, right))
    got = left.cogroup(right).applyInArrow(sums, schema).groupBy("id", "own", "label").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = F.col("own") == F.col("label")
    split = got.groupBy("id").agg(F.min(F.when(own & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("s") / F.col("n"))).alias("b"))
    split = split.where("a is not null and b is not null")
    return split.select(F.col("id").alias(key), F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0).alias("silhouette"))


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)


def mean_silhouette(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """n (rows that count) and the mean silhouette; 0 where none counts."""
    return silhouettes(rows, key, vector, label).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("silhouette"), F.lit(0.0)).alias("mean_silhouette"))
