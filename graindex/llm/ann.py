"""Nearest neighbours by largest inner product, over balanced posting lists.

Vectors get one more component, sqrt(M**2 - |x|**2) with M the largest norm, so that the largest inner product is the
least Euclidean distance. Centroids are fitted in numpy on a bounded sample by k-means with a price on full clusters:
a list for each ``PER_LIST`` vectors, up to ``MAX_LISTS``, and ``PER_CENTROID`` sampled vectors for each. Every vector
goes to its nearest centroid's list and, as a boundary vector, to those of up to ``REPLICAS`` centroids whose distance
is within ``BOUNDARY`` times the least. A query walks a graph of the centroids (each linked to its nearest ones) and
takes all lists within a ratio of its least distance; the ratio is the least that finds ``TARGET_RECALL`` of the
neighbours of sampled queries in the sample. The driver holds the sample packed, in its own type, and distances of a
block of it at a time (``CELLS``), so its memory doesn't grow with the table.

Lists are packed into bins of about ``BIN`` entries, so a query is sent once for each bin that holds some of its lists,
and reads only those there. A list larger than a bin is split by a hash of vec_id and its queries go to each part; the
queries of a bin are split likewise. So neither a list nor its queries have to fit into a task, and no pair is listed
that the sample already shows to be out of reach: the k-th best score among some sampled vectors (``BOUNDING``) of a
query's lists is a lower bound of its final one. Beyond ``MAX_LISTS`` lists, which bound what the driver holds, lists
grow with the table.

Scores are inner products in double precision of the original vectors. Rows without a vec_id, and vectors that are
null, empty or zero, or hold null or non-finite components, take no part; nor do vectors of another length than most
have. Rows that share a vec_id count as one vector, the least of them. Ties go to the smaller vec_id. A query with
fewer than k candidates gets them all: it takes further lists until they hold k others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut

PER_LIST, MAX_LISTS, PER_CENTROID, BOUNDING = 100, 4096, 16, 5000
REPLICAS, BOUNDARY, TARGET_RECALL = 2, 1.01, 0.97
#: Links of a centroid to its nearest, places a walk starts from, and centroids it opens at least.
LINKS, STARTS, OPENED = 16, 64, 64
#: Rows whose distances to all centroids are held at once, and distances held at once.
ROWS, CELLS = 2048, 1 << 20
#: Entries of a bin, and queries that meet it in one task.
BIN = QUERIES = 8192


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part, one row a vec_id."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select("vec_id", "embedding").where("vec_id is not null and embedding is not null")
    rows = rows.where(~F.exists("embedding", bad)).where(F.exists("embedding", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def matrix(column: pa.Array, real: type = np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(real, copy=False).reshape(len(column), -1)


def pieces(rows: int, width: int) -> list[slice]:
    """Parts of some rows, of up to ``ROWS`` rows and ``CELLS`` values if each row has ``width`` of them; one at least."""
    step = max(1, min(ROWS, CELLS // max(1, width)))
    return [slice(lo, lo + step) for lo in range(0, max(1, rows), step)]


def summed(parts: Iterable[np.ndarray]) -> np.ndarray:
    """The sum of all rows of the parts, one after another, so that it doesn't depend on how rows are cut into parts."""
    total = None
    for part in parts:
        total = (part if total is None else np.vstack([total, part])).sum(0)
    return total


@dataclass
class Lists:
    """Centroids in the space with one more component, their graph, and what the sample tells about queries."""

    centroids: np.ndarray
    links: list[list[int]]
    radius: float
    sample: np.ndarray
    sample_ids: np.ndarray
    sample_lists: np.ndarray | None = None
    ratio: float = 1.0
    counts: np.ndarray | None = None

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64, copy=False)
        return np.hstack([x, np.sqrt(np.maximum(self.radius**2 - (x * x).sum(1), 0))[:, None]])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        c = self.centroids
        return np.sqrt(np.maximum((lifted**2).sum(1)[:, None] - 2 * lifted @ c.T + (c * c).sum(1), 0))

    def assign(self, x: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """(row, place) of every entry in the table (second) of near lists: the nearest, and the next at nearly its distance."""
        r, lists, taken = min(REPLICAS, len(self.centroids)), [], []
        for part in pieces(len(x), len(self.centroids)):
            d = self.distances(self.lifted(x[part]))
            near = np.argpartition(d, r - 1, axis=1)[:, :r].copy()  # a view would keep the places of all centroids
            dn = np.take_along_axis(d, near, 1)
            lists.append(near)
            taken.append(dn <= BOUNDARY * dn.min(1, keepdims=True))
        return np.nonzero(np.concatenate(taken)), np.concatenate(lists)

    def search(self, query: np.ndarray, k: int) -> list[int]:
        """Lists of a query (lifted): best-first over the graph, until the next is beyond the ratio and k rows are held."""
        c, ratio = self.centroids, self.ratio
        starts = range(0, len(c), max(1, len(c) // STARTS))
        d2 = {i: float(((c[i] - query) ** 2).sum()) for i in starts}
        heap = [(d, i) for i, d in d2.items()]
        heap.sort()
        best, out, held = heap[0][0], [], 0
        while heap:
            d, i = heappop(heap)
            best = min(best, d)
            if d > best * ratio**2 and held >= REPLICAS * (k + 1) and len(out) >= OPENED:
                break
            out.append((d, i))
            held += int(self.counts[i]) if self.counts is not None else k
            new = [j for j in self.links[i] if j not in d2]
            if new:
                for j, dj in zip(new, ((c[new] - query) ** 2).sum(1).tolist(), strict=True):
                    d2[j] = dj
                    heappush(heap, (dj, j))
        # what the walk passed on its way in, before it knew the least distance, is pruned as well
        out.sort()
        kept, held = [], 0
        for d, i in out:
            if d > best * ratio**2 and held >= REPLICAS * (k + 1):
                break
            kept.append(i)
            held += int(self.counts[i]) if self.counts is not None else k
        return kept


def balanced_centroids(x: np.ndarray, lifted: Callable[[np.ndarray], np.ndarray], k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k-means of lifted rows whose clusters get dearer as they fill: a cluster's price follows its size in the rounds before."""
    rng, parts = np.random.default_rng(seed), pieces(len(x), k)
    c = lifted(x[rng.choice(len(x), k, replace=False)])
    mean = summed(lifted(x[p]) for p in parts) / len(x)
    price, scale = np.zeros(k), (summed((lifted(x[p]) - mean) ** 2 for p in parts) / len(x)).sum()
    for _ in range(rounds):
        cost = (c * c).sum(1) + price
        n, sums = np.zeros(k, np.int64), np.zeros_like(c)
        for p in parts:
            some = lifted(x[p])
            at = (cost - 2 * some @ c.T).argmin(1)
            n += np.bincount(at, minlength=k)
            np.add.at(sums, at, some)
        price += 0.05 * scale * (n / (len(x) / k) - 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], lifted(x[rng.choice(len(x), k)]))
    return c


def centroid_graph(c: np.ndarray) -> list[list[int]]:
    """For each centroid its nearest others, those it is nearest to, and the next by number, so that all connect."""
    near, some = [], min(LINKS, len(c) - 1)
    for part in pieces(len(c), len(c)):
        d = (c * c).sum(1) - 2 * c[part] @ c.T
        d[np.arange(len(d)), np.arange(part.start, part.start + len(d))] = np.inf
        near.append(np.argsort(d, 1, kind="stable")[:, :some].copy())
    near = np.concatenate(near)
    links = [{(i + 1) % len(c), *near[i].tolist()} for i in range(len(c))]
    for i, row in enumerate(near.tolist()):
        for j in row:
            links[j].add(i)
    return [sorted(x) for x in links]


def top_of_sample(x: np.ndarray, probe: np.ndarray, k: int) -> np.ndarray:
    """For each probe (a place in ``x``) the places of its k nearest others, by a block of rows at a time; ties to the first."""
    asked, best, top = x[probe].astype(np.float64), np.zeros((len(probe), 0)), np.zeros((len(probe), 0), np.int64)
    for part in pieces(len(x), len(probe)):
        score = asked @ x[part].astype(np.float64).T
        at = np.broadcast_to(np.arange(part.start, part.start + score.shape[1]), score.shape)
        score[at == probe[:, None]] = -np.inf
        score, at = np.hstack([best, score]), np.hstack([top, at])
        first = np.argsort(-score, 1, kind="stable")[:, :k]
        best, top = np.take_along_axis(score, first, 1), np.take_along_axis(at, first, 1)
    return top


def fit(rows: DataFrame, k: int) -> Lists:
    """Fit centroids, graph and ratio on a bounded sample of ``rows`` (vec_id, embedding)."""
    norm = F.sqrt(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    n, radius = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(norm), F.lit(1.0))).first()
    lists = max(1, min(MAX_LISTS, n // PER_LIST))
    share = min(1.0, PER_CENTROID * lists / max(n, 1))
    x, ids = sampled(rows.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1))
    lists = max(1, min(lists, len(x) // 4))
    made = Lists(np.zeros((1, 1)), [[0]], radius * (1 + 1e-9), x, ids)
    if not len(x):
        return made
    made.centroids = balanced_centroids(x, made.lifted, lists)
    made.links = centroid_graph(made.centroids)
    probe = np.arange(0, len(x), max(1, len(x) // 200))
    asked = made.lifted(x[probe])
    asked[:, -1] = 0
    # the k nearest of all rows are about as near as this many of the sample
    top = top_of_sample(x, probe, max(1, min(-(-k * len(x) // n), len(x) - 1)))
    (row, place), near = made.assign(x)
    d = made.distances(asked)
    relative = d / np.maximum(d.min(1, keepdims=True), 1e-12)
    made.sample_lists = np.full((len(x), REPLICAS), -1)
    made.sample_lists[row, place] = near[row, place]
    lists_of = made.sample_lists[top]
    cost = np.where(lists_of >= 0, np.take_along_axis(relative, np.maximum(lists_of, 0).reshape(len(probe), -1), 1).reshape(lists_of.shape), np.inf).min(2)
    made.ratio = float(np.quantile(cost, TARGET_RECALL, method="higher")) * (1 + 1e-9)
    made.sample, made.sample_ids, made.sample_lists = x[:BOUNDING].astype(np.float64), ids[:BOUNDING].copy(), made.sample_lists[:BOUNDING].copy()
    return made


def sampled(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and vec_ids of ``rows``, ordered by vec_id; they come as Arrow columns, never as Python values."""
    told = rows.select("vec_id", "embedding").toArrow()
    if not len(told):
        return np.zeros((0, 1)), np.array([])
    ids = np.array(told["vec_id"].to_pylist())
    order, x, lo = np.argsort(ids, kind="stable"), None, 0
    place = np.argsort(order)
    for c in told["embedding"].chunks:  # straight to their places, so that the sample is held twice at most
        if len(c):
            part = matrix(c, real_of(rows))
            x = np.empty((len(ids), part.shape[1]), part.dtype) if x is None else x
            x[place[lo : lo + len(c)]] = part
            lo += len(c)
    return x, ids[order]


def real_of(rows: DataFrame) -> type:
    return np.float32 if dict(rows.dtypes)["embedding"] == "array<float>" else np.float64


def bins_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each list its first bin, and the number of bins it is split into; small neighbouring lists share a bin."""
    first, parts, at, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for i, n in enumerate(counts.tolist()):
        if n > BIN:
            at, held = at + (held > 0), 0
            first[i], parts[i] = at, -(-n // BIN)
            at += int(parts[i])
        else:
            if held + n > BIN:
                at, held = at + 1, 0
            first[i], held = at, held + n
    return first, parts


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each row of ``vectors`` for which ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    size = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = cut(rows.where(F.size("embedding") == (size["n"] if size else 0)))
    lists = fit(rows, k)
    sent = spark.sparkContext.broadcast(lists)
    id_type, real = dict(rows.dtypes)["vec_id"], real_of(rows)

    def packed(x: np.ndarray) -> pa.Array:
        return pa.array([v.tobytes() for v in x.astype(real)], pa.binary())

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                x = matrix(part.column("embedding"))
                (row, place), near = sent.value.assign(x)
                yield pa.RecordBatch.from_arrays([pa.array(near[row, place].astype(np.int32)), part.column("vec_id").take(pa.array(row)), packed(x[row])], ["list", "vec_id", "vector"])

    postings = cut(rows.mapInArrow(entries, f"list int, vec_id {id_type}, vector binary"))
    counts = np.zeros(len(lists.centroids), np.int64)
    for r in postings.groupBy("list").count().collect():  # one number for each of at most MAX_LISTS lists
        counts[r["list"]] = r["count"]
    lists.counts = counts
    ready, (first, parts) = spark.sparkContext.broadcast(lists), bins_of(counts)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ready.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x = matrix(part.column("embedding"))
                ids = np.array(part.column("vec_id").to_pylist())
                score = x @ found.sample.T
                score[ids[:, None] == found.sample_ids[None, :]] = -np.inf
                at = [np.array(found.search(q, k)) for q in np.hstack([x, np.zeros((len(x), 1))])]
                row, bins, taken = [], [], []
                for i, a in enumerate(at):
                    flag = np.zeros(len(found.centroids) + 1, bool)  # the last stands for no list
                    flag[a] = True
                    score[i, ~flag[found.sample_lists].any(1)] = -np.inf
                    a = a[np.lexsort((a, first[a]))]
                    for some in np.split(a, np.flatnonzero(np.diff(first[a])) + 1):
                        for b in range(int(first[some[0]]), int(first[some[0]] + parts[some[0]])):
                            row.append(i)
                            bins.append(b)
                            taken.append(some)
                bound = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(x), -np.inf)
                ends = np.append(0, np.cumsum([len(t) for t in taken])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bins, pa.int32()), part.column("vec_id").take(pa.array(row)), packed(x[row]), pa.array(bound[row]),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(taken).astype(np.int32))),
                    ],
                    ["bin", "query_id", "vector", "bound", "lists"],
                )

    queries = cut(rows.where(is_query).mapInArrow(asked, f"bin int, query_id {id_type}, vector binary, bound double, lists array<int>"))
    of_list = spark.createDataFrame([(i, int(first[i]), int(parts[i])) for i in range(len(counts))], "list int, first int, parts int")
    blocks = queries.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("q_parts"))
    part_of = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    # the tables of lists and of bins have at most MAX_LISTS rows, and a bin for each BIN entries
    left = postings.join(F.broadcast(of_list), "list").withColumn("bin", F.col("first") + part_of("vec_id", "parts")).join(blocks, "bin")
    left = left.select("bin", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)).alias("q"), "list", "vec_id", "vector")
    right = queries.join(blocks, "bin").select("bin", part_of("query_id", "q_parts").alias("q"), "query_id", "vector", "bound", "lists")
    schema = f"query_id {id_type}, vec_id {id_type}, score double"
    met = left.groupBy("bin", "q").cogroup(right.groupBy("bin", "q")).applyInPandas(lambda a, b: best_of_bin(a, b, k, real), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_of_bin(vectors: pd.DataFrame, queries: pd.DataFrame, k: int, real: type) -> pd.DataFrame:
    """For each query the k best vectors of its lists in a bin, a list at a time, leaving out what is under its bound."""
    none = {"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")}
    if not len(vectors) or not len(queries):
        return pd.DataFrame(none)
    lists = dict(list(vectors.groupby("list")))
    asks = queries["lists"].to_numpy()
    place, of = np.repeat(np.arange(len(queries)), [len(a) for a in asks]), np.concatenate(asks)
    out = [best_pairs(lists[i], queries.iloc[place[of == i]], k, real) for i in np.unique(of).tolist() if i in lists]
    if not out:
        return pd.DataFrame(none)
    found = pd.concat(out).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).drop_duplicates(["query_id", "vec_id"])
    return found.groupby("query_id", sort=False).head(k)


def best_pairs(vectors: pd.DataFrame, queries: pd.DataFrame, k: int, real: type) -> pd.DataFrame:
    """The k best of some vectors for each of some queries, leaving out what is under the query's bound."""
    x = np.frombuffer(b"".join(vectors["vector"]), real).astype(np.float64).reshape(len(vectors), -1)
    ids, out = vectors["vec_id"].to_numpy(), []
    for lo in range(0, len(queries), 256):
        part = queries.iloc[lo : lo + 256]
        q = np.frombuffer(b"".join(part["vector"]), real).astype(np.float64).reshape(len(part), -1)
        own = part["query_id"].to_numpy()
        rough = q @ x.T
        rough[own[:, None] == ids[None, :]] = -np.inf
        slack = 1e-9 * (1 + np.abs(rough[np.isfinite(rough)]).max(initial=0))
        least = part["bound"].to_numpy()
        if rough.shape[1] > k:
            least = np.maximum(least, np.partition(rough, -k, axis=1)[:, -k])
        row, col = np.nonzero((rough >= least[:, None] - slack) & (rough > -np.inf))
        score = (q[row] * x[col]).sum(1)  # row by row, so that equal vectors get equal scores
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        n = np.bincount(row, minlength=len(part))
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        row, col, score = row[place < k], col[place < k], score[place < k]
        out.append(pd.DataFrame({"query_id": own[row], "vec_id": ids[col], "score": score}))
    return pd.concat(out)
