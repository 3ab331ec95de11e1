"""Session helpers: lineage cuts in the shared checkpoint folder, Arrow batch sizes, document keys and free names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    One of our own is made only where none is set and Spark runs inside one machine (tests); on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to a table in the shared checkpoint folder and read again: a lost executor costs no recomputation."""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more."""
    for df in tables:
        if files := df.inputFiles():
            jvm = df.sparkSession.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def bounded_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Small Arrow batches for the plans run inside: documents may be long, and a batch is held whole in a Python worker."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and text: the key of a document is its id and a hash of its text.

    Rows that share both are the same document and are treated alike, so repeated rows and repeated ids do no harm.
    """
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def document_key() -> Column:
    """(doc_id, text_key) of a row of documents as one value; a null id equals a null id."""
    return F.struct("doc_id", F.xxhash64("text").alias("text_key"))


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like these that ``df`` has no column of, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
