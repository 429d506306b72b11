"""A listing behind an offset and a limit, as a data source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader


def all_pages(fetch: Callable[[int, int], list[tuple]], size: int) -> Iterator[tuple]:
    """Rows of fetch(offset, limit) up to and with the first page that is short."""
    offset, full = 0, True
    while full:
        page = fetch(offset, size)
        yield from page
        offset, full = offset + len(page), len(page) >= size


def read_paged(spark: SparkSession, name: str, schema: str, fetch: Callable[[int, int], list[tuple]], size: int = 1000) -> DataFrame:
    """The listing as a frame. One task reads it, page by page and never more than one in memory, as the next offset
    is known only when a page has come; `fetch` is sent to that task."""

    class Reader(DataSourceReader):
        def read(self, partition):
            return all_pages(fetch, size)

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Paged)
    return spark.read.format(name).load()
