"""Steps of iterative plans: lineage cut in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a task whose work a row is heavy.
DEALT = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only inside one machine (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint, so that the plans of an iteration don't grow."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over tasks of some ``DEALT`` rows: a small file is one task, however much is done with each row."""
    return df.repartition(1 + df.count() // DEALT)


def worked_out(df: DataFrame, good: Column | None = None, **columns: Column) -> DataFrame:
    """``df`` with columns that are worked out once a row, and the rows for which ``good``, a condition on them, holds.

    Spark copies what stands below a filter into it, once for each use, unless a column beside it isn't deterministic.
    """
    once = df.select("*", *[c.alias(n) for n, c in columns.items()], F.monotonically_increasing_id().alias("_at"))
    seen = F.col("_at") >= 0  # always; names the column, so that it stays
    return once.where(seen if good is None else seen & good).drop("_at")
