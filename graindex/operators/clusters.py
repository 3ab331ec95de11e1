"""Clusters: seeded k-means with distributed steps, and an average-linkage tree of a small distance matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import Mulberry
from .steps import cut


def sampled(df: DataFrame, vector: str, n: int = 2000) -> np.ndarray:
    """A bounded sample of the vectors, drawn by a hash of the vector."""
    rows = df.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    return np.array([r["v"] for r in rows.orderBy(F.xxhash64("v")).limit(n).collect()], np.float64)


def seeds(x: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """k-means++ seeds from a sample, each drawn by its squared distance to those before, with numbers of mulberry32."""
    draw, k = Mulberry(seed), min(k, len(x))
    centres = x[int(draw() * len(x))][None] if k else np.zeros((0, 0))
    least = np.full(len(x), np.inf)
    while 0 < len(centres) < k:
        least = np.minimum(least, ((x - centres[-1]) ** 2).sum(1))
        upto = np.cumsum(least)
        pick = min(int(np.searchsorted(upto, draw() * upto[-1], side="right")), len(x) - 1) if upto[-1] > 0 else int(draw() * len(x))
        centres = np.vstack([centres, x[pick]])
    return centres


def kmeans(df: DataFrame, key: str, vector: str, k: int, starts: int = 8, rounds: int = 120, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance) and the centres of the best of several starts, by the sum of squared distances.

    All starts take their Lloyd steps in the same pass over the rows, until none moves; sums are made in the tasks and
    merged by start and cluster. An empty cluster moves to the row farthest from its centre. The steps of ``rounds``
    passes at most are taken; what still moves then is kept as it is. Vectors are written out once; each round reads those.
    """
    v = cut(df.select(F.col(key), F.col(vector).cast("array<double>").alias("v")).where("v is not null"))
    x = sampled(v, "v")
    every = [seeds(x, k, seed + 7919 * r) for r in range(starts)]
    best, cost, live = every[0], float("inf"), list(range(starts)) if len(every[0]) else []
    for step in range(rounds + 1):
        if not live:
            break

        at = {r: every[r] for r in live}
        total = _lloyd_sums(v, at)
        for r in list(live):
            n, inertia = total[r][:, -2:-1], float(total[r][:, -1].sum())
            moved = np.where(n > 0, total[r][:, :-2] / np.maximum(n, 1), every[r])
            if (n == 0).any():
                moved = np.where(n > 0, moved, _farthest(v, every[r]))
            if step == rounds or np.allclose(moved, every[r], rtol=0, atol=1e-12):
                live.remove(r)
                if inertia < cost:
                    best, cost = every[r], inertia
            else:
                every[r] = moved
    return v.select(key, *assigned(best)), best


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the centres for each row, and its squared distance."""
    near = (-2 * x @ c.T + (c * c).sum(1)).argmin(1)
    return near, ((x - c[near]) ** 2).sum(1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            part = batch.column(0).slice(lo, 2048)
            yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def _lloyd_sums(v: DataFrame, at: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each start and centre the sum of its rows, their number, and the sum of their squared distances."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {r: np.zeros((len(c), c.shape[1] + 2)) for r, c in at.items()}
        for x in _rows(batches):
            for r, c in at.items():
                near, least = _nearest(x, c)
                np.add.at(total[r], near, np.hstack([x, np.ones((len(x), 1)), least[:, None]]))
        for r, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([r] * len(t)), pa.array(range(len(t)), pa.int64()), pa.array(t.tolist(), pa.list_(pa.float64()))], ["r", "c", "sums"])

    width = next(iter(at.values())).shape[1] + 2
    parts = v.select("v").mapInArrow(sums, "r long, c long, sums array<double>")
    out = {r: np.zeros((len(c), width)) for r, c in at.items()}
    for row in parts.groupBy("r", "c").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("s")).collect():  # starts * k rows
        out[row["r"]][row["c"]] = row["s"]
    return out


def _farthest(v: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The row that is farthest from its centre."""

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _rows(batches):
            least = _nearest(x, centres)[1]
            i = int(least.argmax())
            yield pa.RecordBatch.from_arrays([pa.array([float(least[i])]), pa.array([x[i].tolist()])], ["d", "x"])

    return np.array(v.select("v").mapInArrow(far, "d double, x array<double>").agg(F.max(F.struct("d", "x")).alias("m")).first()["m"]["x"])


def assigned(centres: np.ndarray, vector: str = "v") -> list:
    """cluster and distance of a vector to its nearest centre, as columns; ties to the first centre."""
    if not len(centres):
        return [F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("distance")]
    to = [F.struct(F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]
    best = F.array_min(F.array(*to))
    return [best["i"].alias("cluster"), F.sqrt(best["d"]).alias("distance")]


def average_linkage(distances: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (left, right, height, size) of a small symmetric matrix; leaves are 0 to n - 1, merges n and up.

    The least average distance merges first, of equal ones the first pair in order of slots; the merged cluster takes
    the slot of the left one.
    """
    d = np.array(distances, np.float64)
    n = len(d)
    np.fill_diagonal(d, np.inf)
    ids, sizes, out = list(range(n)), [1] * n, []
    live = np.ones(n, bool)
    for step in range(n - 1):
        grid = np.where(live[:, None] & live[None, :], d, np.inf)
        i, j = sorted(divmod(int(grid.argmin()), n))
        a, b = sizes[i], sizes[j]
        out.append((ids[i], ids[j], float(d[i, j]), a + b))
        row = (a * d[i] + b * d[j]) / (a + b)
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        live[j], ids[i], sizes[i] = False, n + step, a + b
    return out


def linkage_of(points: DataFrame, key: str, vector: str, most: int = 200) -> list[tuple[int, int, float, int]]:
    """The tree of at most ``most`` points, in order of key; more are an error, as the method takes cubic time on one machine."""
    rows = points.select(key, F.col(vector).cast("array<double>").alias("v")).orderBy(key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"average linkage is for {most} points at most")
    x = np.array([r["v"] for r in rows], np.float64).reshape(len(rows), -1)
    return average_linkage(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))) if len(rows) else []


def layout(merges: list[tuple[int, int, float, int]], n: int) -> list[tuple[int, float, float]]:
    """(node, x, height) of a dendrogram: leaves at their place from left to right, a merge between its two parts."""
    x = {leaf: float(i) for i, leaf in enumerate(leaf_order(merges, n))}
    out = [(leaf, at, 0.0) for leaf, at in x.items()]
    for i, (left, right, height, _) in enumerate(merges):
        x[n + i] = (x[left] + x[right]) / 2
        out.append((n + i, x[n + i], height))
    return out


def leaf_order(merges: list[tuple[int, int, float, int]], n: int) -> list[int]:
    """Leaves from left to right."""
    if not merges:
        return list(range(n))
    out, stack = [], [n + len(merges) - 1]
    while stack:
        at = stack.pop()
        if at < n:
            out.append(at)
        else:
            left, right = merges[at - n][:2]
            stack += [right, left]
    return out
