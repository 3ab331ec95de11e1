"""A paged crawl as a stream: the offset is the last whole page of each mode, so a crawl goes on where it stopped.

The source itself gives page numbers only, from the driver: which pages exist now and haven't been read. What is on the pages
is read by the executors, a task for each group of pages, in the batch that holds their numbers. Spark's checkpoint commits the offset
with the batch's rows: a crawl that fails or is killed between pages reads the pages of that batch again and appends their rows
once. Modes (a listing, each search) have offsets of their own, and a mode that is new to a checkpoint starts at page 1.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.pandas.types import to_arrow_schema


class Site(ABC):
    """What is crawled. It is sent to the executors; a page is the same whenever it is asked for."""

    @abstractmethod
    def last(self, mode: str, after: int, most: int) -> int:
        """The last whole page of ``mode`` that exists now, from ``after`` to ``after + most``."""

    @abstractmethod
    def page(self, mode: str, number: int) -> Iterable[tuple]:
        """The rows of a page, in the order of the schema."""


class Folder(Site):
    """Pages kept as Parquet under ``mode=<mode>/page=<number>`` in a folder that all executors share (also in a store that Arrow reads)."""

    def __init__(self, uri: str):
        self.uri = uri

    def _at(self, mode: str, number: int) -> tuple[fs.FileSystem, fs.FileSelector]:
        files, path = fs.FileSystem.from_uri(self.uri) if "://" in self.uri or self.uri.startswith("file:") else (fs.LocalFileSystem(), self.uri)
        return files, fs.FileSelector(f"{path}/mode={mode}/page={number}", allow_not_found=True)

    def _parts(self, mode: str, number: int) -> list[str]:
        files, at = self._at(mode, number)
        return sorted(f.path for f in files.get_file_info(at) if f.is_file and f.path.endswith(".parquet"))

    def last(self, mode: str, after: int, most: int) -> int:
        number = after
        while number < after + most and self._parts(mode, number + 1):
            number += 1
        return number

    def page(self, mode: str, number: int) -> Iterator[tuple]:
        files, _ = self._at(mode, number)
        for path in self._parts(mode, number):
            for batch in pq.ParquetFile(files.open_input_file(path)).iter_batches():
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


class _Numbers(SimpleDataSourceStreamReader):
    def __init__(self, site: Site, modes: Sequence[str], pages: int):
        self.site, self.modes, self.pages = site, modes, pages

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.modes, 0)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = start | {m: self.site.last(m, start.get(m, 0), self.pages) for m in self.modes}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(m, n) for m, last in end.items() for n in range(start.get(m, 0) + 1, last + 1)])


def crawl(spark: SparkSession, name: str, site: Site, modes: Sequence[str], schema: str, pages: int = 1000, tasks: int | None = None) -> DataFrame:
    """A stream of mode, page and the rows of all pages that no run of the same checkpoint has taken.

    ``pages`` caps the pages of a mode that one batch takes, and so one run over what is there. Pages are dealt to ``tasks``
    tasks by number (shuffle partitions unless given). An error of a page fails the batch, which takes none of its pages.
    """
    numbers = "mode string, page int"

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return numbers

        def simpleStreamReader(self, schema: object) -> SimpleDataSourceStreamReader:
            return _Numbers(site, modes, pages)

    spark.dataSource.register(Source)
    fields = T.StructType([*T.StructType.fromDDL(numbers).fields, *T.StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(fields)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mode, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [(mode, number, *row) for row in site.page(mode, number)]
                columns = zip(*found, strict=True) if found else [[]] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    dealt = spark.readStream.format(name).load()
    dealt = dealt.repartition(tasks, "mode", "page") if tasks else dealt.repartition(F.col("mode"), F.col("page"))
    return dealt.mapInArrow(rows, fields)
