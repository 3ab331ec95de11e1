"""Projections as stored tables: points in a folder for each method and blend, in buckets by id like the details they are shown with.

A page of one projection then reads one folder, and joins details bucket by bucket, without an exchange of either side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns that name a projection.
KIND = ("method", "blend")


def store(points: DataFrame, variance: DataFrame, details: DataFrame, key: str, folder: str, name: str, buckets: int = 64) -> None:
    """Write tables {name}_points (method, blend, ``key``, coordinates), {name}_details and {name}_variance under ``folder``.

    Tables of that name are replaced. ``variance`` has method, blend, axis and share.
    """
    for df, what, parts in ((points, "points", KIND), (details, "details", ())):
        # each bucket of a partition is one file, written by one task
        writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", f"{folder}/{what}").bucketBy(buckets, key).sortBy(key)
        (writer.partitionBy(*parts) if parts else writer).saveAsTable(f"{name}_{what}")
    variance.write.mode("overwrite").format("parquet").option("path", f"{folder}/variance").saveAsTable(f"{name}_variance")


def attach(spark: SparkSession, folder: str, name: str, points: str, details: str, key: str, buckets: int = 64) -> None:
    """Name the tables that ``store`` wrote under ``folder`` in another session; ``points`` and ``details`` are their columns as DDL."""
    by = f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS"
    kinds = f"PARTITIONED BY ({', '.join(KIND)})"
    for what, columns, how in (("points", points, f"{kinds} {by}"), ("details", details, by), ("variance", "method string, blend double, axis int, share double", "")):
        spark.sql(f"DROP TABLE IF EXISTS {name}_{what}")
        spark.sql(f"CREATE TABLE {name}_{what} ({columns}) USING parquet {how} LOCATION '{folder}/{what}'")
    spark.catalog.recoverPartitions(f"{name}_points")


def tables(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The points, details and shares of variance of stored projections."""
    return spark.table(f"{name}_points"), spark.table(f"{name}_details"), spark.table(f"{name}_variance")
