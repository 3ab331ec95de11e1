"""Tables of a folder, and the registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of a task that groups them by order.
ORDER_LINES = 500_000

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, each with the SQL that gives the same rows, if SQL can."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def named(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql.strip()
            return f

        return named


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_parts(spark: SparkSession, sf_dir: str, by_order: bool = False) -> DataFrame:
    """The bills: one row a line with its part's brand, type and name.

    ``by_order`` deals them by order to so many tasks that none holds more than some ``ORDER_LINES`` lines: what is then
    grouped by order, or by it and more, takes no further shuffle, and memory that doesn't grow with the tables.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    bills = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
    return bills.repartition(1 + lines.count() // ORDER_LINES, "l_orderkey") if by_order else bills


def with_orders(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    return rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
