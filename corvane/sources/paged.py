"""A paged remote table as a Spark data source: a partition for each run of pages, a reader that is a parameter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: fetch(offset, length) -> rows; a page shorter than asked for is the last.
Fetch = Callable[[int, int], list[tuple]]


class _Pages(InputPartition):
    def __init__(self, offset: int, length: int):
        self.offset, self.length = offset, length


def register(spark: SparkSession, name: str, schema: str, fetch: Fetch, *, total: int, page: int = 100, pages_per_task: int = 10) -> None:
    """Make spark.read.format(name) read `total` rows in pages; each task retries alone."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            step = page * pages_per_task
            return [_Pages(at, min(step, total - at)) for at in range(0, total, step)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            at, end = partition.offset, partition.offset + partition.length
            while at < end:
                rows = fetch(at, min(page, end - at))
                yield from rows
                if len(rows) < min(page, end - at):
                    return
                at += len(rows)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
            return Reader()

    spark.dataSource.register(Source)


def read(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.format(name).load()
