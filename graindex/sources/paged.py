"""A paged service as a data source: pages come one after another by a cursor, so a service is read by one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A cursor (None at first) and a page size to the rows of the page, in the schema's order, with the cursor of each row.
Fetch = Callable[[object, int], Sequence[tuple[tuple, object]]]


class _Pages(DataSourceReader):
    def __init__(self, fetches: Sequence[Fetch], size: int):
        self.fetches, self.size = fetches, size

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(len(self.fetches))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        cursor = None
        while True:
            page = self.fetches[partition.value](cursor, self.size)
            yield from (row for row, _ in page)
            if len(page) < self.size:
                return
            cursor = page[-1][1]


def read_pages(spark: SparkSession, name: str, fetches: Sequence[Fetch], schema: str, size: int = 50) -> DataFrame:
    """Rows of paged services (or of one service by independent parts), each by a task of its own; a page under ``size`` is the last.

    A task that is lost begins again at its first page, so what a fetch returns must not depend on earlier calls.
    """

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: object) -> DataSourceReader:
            return _Pages(fetches, size)

    spark.dataSource.register(Source)
    return spark.read.format(name).load()
