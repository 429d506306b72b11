"""A change feed behind a cursor, as a streaming data source.

Events are ordered by (at, key), and the cursor is the last event read; the source's offset is that cursor, so a stream that is stopped anywhere,
in the middle of a page too, goes on behind the last event of its last committed batch, and a batch that is run again reads
the same stretch. The feed's order allows one reader at a time: a batch is one task, which holds a page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

Cursor = tuple | None


class Stretch(InputPartition):
    """Events behind `start` up to and with `end`."""

    def __init__(self, start: Cursor, end: Cursor):
        self.start, self.end = start, end


def stretch(fetch: Callable[[Cursor, int], list[tuple]], start: Cursor, end: Cursor, size: int) -> Iterator[tuple]:
    """Pages of fetch(cursor, limit) behind `start`, whose rows begin with at and key, up to and with the event at `end`."""
    cursor = start
    while page := fetch(cursor, size):
        for event in page:
            if end is None or tuple(event[:2]) > tuple(end):
                return
            yield event
        cursor = tuple(page[-1][:2])
        if cursor == tuple(end):
            return


def stream_feed(spark: SparkSession, name: str, schema: str, fetch: Callable[[Cursor, int], list[tuple]], newest: Callable[[], Cursor], size: int = 1000) -> DataFrame:
    """The feed as a stream of rows of `schema`, whose first columns are at and key (numbers or strings).

    fetch(cursor, limit) gives the events behind a cursor, in order; newest() the cursor of the feed's last event, or None where it has none.
    """

    class Reader(DataSourceStreamReader):
        def initialOffset(self):
            return {"cursor": None}

        def latestOffset(self):
            at = newest()
            return {"cursor": list(at) if at else None}

        def partitions(self, start, end):
            return [Stretch(start["cursor"] and tuple(start["cursor"]), end["cursor"] and tuple(end["cursor"]))]

        def read(self, partition):
            return stretch(fetch, partition.start, partition.end, size)

        def commit(self, end):
            pass

    class Feed(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def streamReader(self, schema):
            return Reader()

    spark.dataSource.register(Feed)
    return spark.readStream.format(name).load()
