"""Feature spaces: z-scores, tags as weighted flags, and principal components from one distributed Gram matrix, or without it for wide rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import cut

#: Rows of a batch that are taken at a time, and numbers of a block that is worked out at a time.
ROWS, CELLS = 4096, 1 << 18


@dataclass
class Scale:
    """Means and population deviations of columns; a deviation of 0 counts as 1."""

    columns: list[str]
    means: list[float]
    stds: list[float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> Scale:
        got = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
        n = range(len(columns))
        return cls(list(columns), [got[f"m{i}"] or 0.0 for i in n], [got[f"s{i}"] or 1.0 for i in n])

    def z(self) -> list[Column]:
        return [(F.col(c) - m) / s for c, m, s in zip(self.columns, self.means, self.stds, strict=True)]


@dataclass
class Space:
    """A fitted feature space: z-scores times sqrt(2 (1 - w)), tag flags times sqrt(2 w) * sqrt(numerics / tags)."""

    scale: Scale
    tags: list[str]
    weight: float

    def vector(self, tags: str) -> Column:
        """The vector of any row, also of one the space wasn't fitted on."""
        numeric = (2 * (1 - self.weight)) ** 0.5
        flag = (2 * self.weight) ** 0.5 * (len(self.scale.columns) / max(1, len(self.tags))) ** 0.5
        flags = [F.when(F.array_contains(tags, t), flag).otherwise(0.0) for t in self.tags]
        return F.array(*[z * numeric for z in self.scale.z()], *flags)


def fit_space(df: DataFrame, columns: Sequence[str], tags: str, weight: float, vocabulary: DataFrame) -> Space:
    """``vocabulary`` (tag) is a curated list of tags; it becomes columns, so it must be short."""
    return Space(Scale.fit(df, columns), [r["tag"] for r in vocabulary.select("tag").orderBy("tag").collect()], weight)


def style_numerics(og: Column, fg: Column, abv: Column, ibu: Column, srm: Column) -> list[Column]:
    """The seven numbers of a style or recipe: five vitals (colour as a logarithm), attenuation, and bitterness per gravity."""
    points = (og - 1) * 1000
    return [
        og,
        fg,
        abv,
        ibu,
        F.ln(F.greatest(srm, F.lit(0.5))),
        F.when(og > 1, (og - fg) / (og - 1)).otherwise(0.0),
        F.when(points > 0, ibu / points).otherwise(0.0),
    ]


@dataclass
class Components:
    """Principal axes (rows), the mean, and the share of variance of each axis."""

    mean: np.ndarray
    axes: np.ndarray
    shares: np.ndarray

    def project(self, vector: Column) -> Column:
        """Coordinates of a vector column as an array."""
        def along(axis: np.ndarray) -> Column:
            pairs = F.zip_with(vector, F.array(*[F.lit(float(x)) for x in axis]), lambda v, a: v * a)
            return F.aggregate(pairs, F.lit(-float(axis @ self.mean)), lambda s, x: s + x)

        return F.array(*[along(a) for a in self.axes])


def gram(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sum and sum of outer products of a vector column: each task sends one small matrix, and sums are merged in Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                n, s, g = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if g is None else g)
        if n:
            flat = np.concatenate([[n], s, g.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["place", "value"])

    v = df.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    sums = v.mapInArrow(partial, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()
    flat = np.array([r["value"] for r in sums])
    if not len(flat):
        return 0, np.zeros(0), np.zeros((0, 0))
    d = int((-1 + (1 + 4 * (len(flat) - 1)) ** 0.5) / 2)
    return int(flat[0]), flat[1 : d + 1], flat[d + 1 :].reshape(d, d)


@dataclass
class _Rows:
    """Rows as sums over them: of x (x . q) for a block q of columns, and so of the covariance."""

    df: DataFrame
    dims: int

    def times(self, q: np.ndarray) -> np.ndarray:
        """The sum of x (x . q) over all rows. Tasks send the places they have seen, and sums are merged in Spark."""
        sent, width, dims = self.df.sparkSession.sparkContext.broadcast(q), q.shape[1], self.dims
        names = [f"s{i}" for i in range(width)]

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros((dims, width)), np.zeros(dims, bool)
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS):
                    row, place, value = _entries(batch.column(0).slice(lo, ROWS))
                    if (x := _matrix(row, place, value, dims)) is not None:
                        total += x.T @ (x @ sent.value)
                    else:
                        dot = np.zeros((int(row.max(initial=-1)) + 1, width))
                        _add(dot, row, value, sent.value, place)
                        _add(total, place, value, dot, row)
                    seen[place] = True
            some = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, i]) for i in range(width))], names=["place", *names])

        parts = self.df.mapInArrow(partial, ", ".join(["place long", *(f"{n} double" for n in names)]))
        got = parts.groupBy("place").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
        out = np.zeros((self.dims, width))
        out[got["place"].to_numpy()] = np.stack([got[n].to_numpy() for n in names], 1) if got.num_rows else 0
        sent.unpersist()
        return out


def _entries(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of the entries of dense vectors (lists) or sparse ones (structs of places and values)."""
    if pa.types.is_struct(vectors.type):
        places, values = vectors.field("places"), vectors.field("values")
        place = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    else:
        places, values, place = vectors, vectors, None
    sizes = np.diff(np.asarray(places.offsets))
    row = np.repeat(np.arange(len(vectors)), sizes)
    if place is None:
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return row, place, values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def _matrix(row: np.ndarray, place: np.ndarray, value: np.ndarray, dims: int) -> np.ndarray | None:
    """Entries as rows of ``dims`` numbers, if every row has all of them in order."""
    n = len(row) // dims if dims else 0
    whole = n * dims == len(row) > 0 and (row.reshape(n, dims) == np.arange(n)[:, None]).all() and (place.reshape(n, dims) == np.arange(dims)).all()
    return value.reshape(n, dims) if whole else None


def _add(total: np.ndarray, at: np.ndarray, value: np.ndarray, rows: np.ndarray, of: np.ndarray) -> None:
    """Add value * rows[of] to total[at], entry by entry; no more than ``CELLS`` products are held at once."""
    step = max(1, CELLS // max(1, total.shape[1]))
    for lo in range(0, len(at), step):
        e = slice(lo, lo + step)
        np.add.at(total, at[e], value[e, None] * rows[of[e]])


def wide_components(df: DataFrame, vector: str, dims: int, k: int, extra: int = 8, most: int = 120, rounds: int = 60, tolerance: float = 1e-10, seed: int = 42) -> Components:
    """The k first axes of the covariance (n - 1) of very wide rows, without the matrix: one pass a round.

    ``vector`` is an array of ``dims`` numbers, or struct<places: array<int>, values: array<double>> with the others 0. A block
    of k + ``extra`` columns is multiplied by the covariance in each round, and a basis of all products so far (at most
    ``most`` columns, then it starts anew from the best axes) gives axes by an eigenproblem of its own size, until each
    changes by no more than ``tolerance`` of the first when multiplied, or after ``rounds``. The driver holds the basis and its
    product, 2 ``most`` numbers a dimension; tasks hold k + ``extra``. Null vectors are left out.
    """
    kind = df.schema[vector].dataType.simpleString()
    v = F.col(vector) if kind.startswith("struct") else F.col(vector).cast("array<double>")
    rows = _Rows(df.select(v.alias("v")).where("v is not null"), dims)
    norm = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    n, squares = rows.df.agg(F.count(F.lit(1)), F.sum(norm(F.col("v.values") if kind.startswith("struct") else F.col("v")))).first()
    if not n:
        return Components(np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    mean = _sums(rows) / n
    total = max(((squares or 0.0) - n * float(mean @ mean)) / max(1, n - 1), 1e-300)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(dims, min(dims, k + extra))))[0]
    basis, image = np.zeros((dims, 0)), np.zeros((dims, 0))
    for _ in range(rounds):
        product = (rows.times(q) - n * np.outer(mean, mean @ q)) / max(1, n - 1)
        basis, image = np.hstack([basis, q]), np.hstack([image, product])
        values, turn = np.linalg.eigh(basis.T @ image / 2 + image.T @ basis / 2)
        order = np.argsort(-values)
        values, turn = values[order], turn[:, order]
        axes, moved = basis @ turn, image @ turn
        off = np.linalg.norm(moved[:, :k] - axes[:, :k] * values[:k], axis=0)
        if basis.shape[1] >= dims or (off <= tolerance * max(values[0], 1e-300)).all():
            break
        for _ in range(2):  # twice is enough for rounding
            product = product - basis @ (basis.T @ product)
        u, size, _ = np.linalg.svd(product, full_matrices=False)
        q = u[:, size > 1e-12 * max(values[0], 1e-300)][:, : dims - basis.shape[1]]
        if not q.shape[1]:
            break
        q = np.linalg.qr(q - basis @ (basis.T @ q))[0]
        if basis.shape[1] + q.shape[1] > most:
            # what is new is at right angles to all that was there, so it goes on from the best axes as from all
            kept = min(k + extra, axes.shape[1])
            basis, image = axes[:, :kept], moved[:, :kept]
    axes = axes[:, :k].T
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return Components(mean, axes, np.maximum(values[:k], 0) / total)


def _sums(rows: _Rows) -> np.ndarray:
    """The sum of all rows, place by place."""
    v = rows.df.schema["v"].dataType.simpleString()
    entry = F.arrays_zip(F.col("v.places").alias("i"), F.col("v.values").alias("x")) if v.startswith("struct") else F.transform("v", lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    got = rows.df.select(F.inline(entry).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s")).toArrow()
    out = np.zeros(rows.dims)
    out[got["i"].to_numpy().astype(np.int64)] = got["s"].to_numpy()
    return out


def coordinates(df: DataFrame, key: str, vector: str, found: Components) -> DataFrame:
    """key and an array of coordinates of each row on the axes, for dense or sparse vectors of any width."""
    sent = df.sparkSession.sparkContext.broadcast((found.axes.T, found.axes @ found.mean))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, base = sent.value
        width = axes.shape[1]
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                row, place, value = _entries(part.column(1))
                x = _matrix(row, place, value, len(axes))
                if x is not None and len(x) == part.num_rows:
                    out = x @ axes
                else:
                    out = np.zeros((part.num_rows, width))
                    _add(out, row, value, axes, place)
                ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * width, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array((out - base).ravel()))], names=[key, "coordinates"])

    kind = df.schema[vector].dataType.simpleString()
    v = F.col(vector) if kind.startswith("struct") else F.col(vector).cast("array<double>")
    rows = df.select(F.col(key), v.alias("v")).where("v is not null")
    return rows.mapInArrow(project, f"{key} {dict(df.dtypes)[key]}, coordinates array<double>")


def tag_vectors(df: DataFrame, key: str, tags: str, least: int = 2) -> tuple[DataFrame, DataFrame, int]:
    """Flags of tags as sparse vectors, for vocabularies too long for columns: (key, v), (tag, place) and the number of tags.

    Tags that ``least`` rows or more carry take part, numbered in order by a count of ranges, not by one task.
    """
    counted = df.select(F.explode(F.array_distinct(tags)).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    placed = numbered(cut(counted.select("tag")), "tag", "place")
    many = placed.count()
    flags = df.select(key, F.explode(F.array_distinct(tags)).alias("tag")).join(placed, "tag")
    sparse = flags.groupBy(key).agg(F.sort_array(F.collect_list("place")).alias("places"))
    vectors = sparse.select(key, F.struct(F.transform("places", lambda p: p.cast("int")).alias("places"), F.transform("places", lambda p: F.lit(1.0)).alias("values")).alias("v"))
    return vectors, placed, many


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with the place of each row in an order without ties, from 0: places within ranges, and the sizes of those before."""
    ranged = cut(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = sizes.select(F.col("_part"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return ranged.withColumn("_r", inside).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_r") - 1).drop("_part", "_r", "_before")


def principal_components(df: DataFrame, vector: str, k: int) -> Components:
    """The k first axes of the covariance (n - 1); the sign of an axis makes its largest entry positive."""
    n, s, g = gram(df, vector)
    if n == 0:
        return Components(np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    mean = s / n
    covariance = (g - n * np.outer(mean, mean)) / max(1, n - 1)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:k]
    axes = vectors[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    total = max(float(np.trace(covariance)), 1e-300)
    return Components(mean, axes, np.maximum(values[order], 0) / total)
