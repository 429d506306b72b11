"""Places in a global order, and order statistics, without a task that sees all rows.

Rows are dealt into ranges of equal depth, whose bounds Spark samples from the rows themselves, sorted there and
written; a range's first place is the number of rows in the ranges before it. What one task windows is a row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: monotonically_increasing_id holds the partition above 33 bits of the row's place in it.
_PLACE_BITS = 33


def in_ranges(df: DataFrame, *order: str | Column, parts: int = 0) -> DataFrame:
    """(row: all columns, part, place): the rows dealt into ranges of equal depth, written, with their range's number and their place from 0 in it.

    A random number stands behind the order, so rows of one key are split over ranges like others.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    d = df.withColumn("tie_", F.rand(17))
    d = d.repartitionByRange(parts, *keys, F.col("tie_")).sortWithinPartitions(*keys, F.col("tie_"))
    d = written(d.select(F.struct(*[d[f"`{c}`"] for c in df.columns]).alias("row"), F.monotonically_increasing_id().alias("at")))
    return d.select("row", F.shiftright("at", _PLACE_BITS).alias("part"), F.col("at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("place"))


def number_rows(df: DataFrame, *order: str | Column, name: str = "number", parts: int = 0) -> DataFrame:
    """The rows with their place from 0 in `order`; rows that tie are in no fixed order among themselves.

    One shuffle, and the frame of first places, a row for each of `parts` ranges (by default the session's shuffle partitions),
    is broadcast. Nulls are placed as the order says; an empty frame stays empty; a column of the given name is replaced.
    """
    d = in_ranges(df, *order, parts=parts)
    sizes = d.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = [F.col("row")[c].alias(c) for c in df.columns if c != name]
    return d.join(F.broadcast(base), "part").select(*own, (F.col("base") + F.col("place")).alias(name))
