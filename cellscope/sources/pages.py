"""A paged record service as a Spark data source: one partition for each id range, keyset pages within.

The fetcher is a callable (below, least, size) -> list of tuples in descending id order; tests and
offline use give one that reads from memory, a deployment one that calls the service.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cellscope.functions.shipping import ship


class IdRange(InputPartition):
    def __init__(self, least: int, below: int) -> None:
        super().__init__((least, below))
        self.least, self.below = least, below


class PageReader(DataSourceReader):
    def __init__(self, fetch: Callable, ranges: list[tuple[int, int]], size: int) -> None:
        self.fetch, self.ranges, self.size = fetch, ranges, size

    def partitions(self) -> list[IdRange]:
        return [IdRange(a, b) for a, b in self.ranges]

    def read(self, partition: IdRange) -> Iterator[tuple]:
        below = partition.below
        while page := self.fetch(below, partition.least, self.size):
            yield from page
            below = page[-1][0]


def register(spark: SparkSession, name: str, schema: str, fetch: Callable, ranges: list[tuple[int, int]], size: int = 200) -> None:
    """Make ``spark.read.format(name)`` scan the service."""
    ship(spark)
    label, columns = name, schema

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return columns

        def reader(self, schema: object) -> PageReader:
            return PageReader(fetch, ranges, size)

    spark.dataSource.register(Paged)
