"""Incremental loads as Structured Streaming: append with dedupe by id, rejects beside, capped batches, upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Parser = Callable[[DataFrame, str], DataFrame]


def new_rows(spark: SparkSession, path: str, schema: str, key: str, kind: str = "parquet", files: int = 100) -> DataFrame:
    """A stream of the rows of a folder's files whose key hasn't been seen, also across restarts.

    The state holds every key by design, as the log it replaces did; ``files`` caps a batch.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path).dropDuplicates([key])


def append(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Run over all that is there and stop; the checkpoint commits a batch only when it is written."""
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def split_rejects(rows: DataFrame, good: Column, out: str, rejects: str, checkpoint: str) -> StreamingQuery:
    """Good rows to one table and the others, which no retry would mend, to another, batch by batch."""
    def write(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("_good", F.coalesce(good, F.lit(False)))
        # a batch written again after a failure replaces its own folder
        batch.where("_good").drop("_good").write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.where("not _good").drop("_good").write.mode("overwrite").parquet(f"{rejects}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and the existing ones they don't replace."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def replay(spark: SparkSession, existing: DataFrame, cache: str, parse_xml: Parser, parse_page: Parser, key: str = "id") -> DataFrame:
    """Records of cached files over the existing ones: the id is the file's name, an XML file is read before a page of the same id.

    ``parse_xml`` and ``parse_page`` take (DataFrame, content column) with a column ``key`` and give records with it.
    """
    files = spark.read.text(cache, wholetext=True).select(F.col("value").alias("content"), F.col("_metadata.file_name").alias("file"))
    named = files.select(F.regexp_extract("file", r"^(.*?)[.][^.]*$", 1).alias(key), F.lower(F.regexp_extract("file", r"[.]([^.]*)$", 1)).alias("kind"), "content")
    xml = parse_xml(named.where("kind = 'xml'").drop("kind"), "content")
    pages = parse_page(named.where("kind in ('html', 'htm')").drop("kind"), "content")
    found = xml.unionByName(pages.join(xml.select(key), key, "left_anti"), allowMissingColumns=True)
    return upsert(existing, found.select(*existing.columns), key)


def keep_whole(counts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """The whole result of an aggregating stream, written anew after each batch."""
    write = lambda batch, number: batch.write.mode("overwrite").parquet(out)
    return counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish(spark: SparkSession, build: Callable[[str], None], folder: str, kept: int = 2) -> str:
    """Build a new version beside the old ones, then name it current by one rename; readers see one or the other.

    Works on any file system that Spark reads. The last ``kept`` versions stay for readers that have them open.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda *x: jvm.org.apache.hadoop.fs.Path("/".join([folder, *x]))
    files = path().getFileSystem(conf)
    files.mkdirs(path())
    found = sorted(int(s.getPath().getName()[1:]) for s in files.listStatus(path()) if s.getPath().getName()[1:].isdigit() and s.getPath().getName()[0] == "v")
    version = f"v{1 + (found[-1] if found else 0)}"
    build(f"{folder}/{version}")
    out = files.create(path("current.new"), True)
    out.write(bytearray(version.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(path("current.new"), path("current"), over)
    for old in found[: max(0, len(found) + 1 - kept)]:
        files.delete(path(f"v{old}"), True)
    return version


def current(spark: SparkSession, folder: str) -> str:
    """The path of the version that is current."""
    return f"{folder}/" + spark.read.text(f"{folder}/current", wholetext=True).first()[0].strip()


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by event-time windows with a watermark (an extension: the pipelines this serves have no event time)."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
