"""Retrieval quality: hit@k, MRR, neighbour density, percentiles, weight sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import in_ranges, number_rows

KS = (1, 3, 5, 10)


def first_gold(results: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, rank): the best rank of a gold record among results(query_id, id, rank), null if none."""
    hit = results.join(gold, ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return queries.select("query_id").join(hit, "query_id", "left")


def quality(first: DataFrame) -> DataFrame:
    """One row: hit@k for each k, and MRR, of (query_id, rank)."""
    share = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_{k}")
    return first.agg(F.count("*").alias("queries"), *map(share, KS), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def density_halves(first: DataFrame, dense: DataFrame) -> DataFrame:
    """(half, queries, hit_5): the crowded half (the floor of n/2 densest queries) and the rest."""
    d = number_rows(first.join(dense, "query_id"), F.desc("density"), "query_id", name="place")
    n = d.agg(F.count("*").alias("n"))
    half = F.when(F.col("place") < F.floor(F.col("n") / 2), "crowded").otherwise("sparse")
    return d.crossJoin(F.broadcast(n)).groupBy(half.alias("half")).agg(F.count("*").alias("queries"), F.round(F.avg(F.when(F.col("rank") <= 5, 1.0).otherwise(0.0)), 6).alias("hit_5"))  # one row


def by_shape(first: DataFrame, shapes: DataFrame) -> DataFrame:
    return first.join(shapes, "query_id").groupBy("shape").agg(F.count("*").alias("queries"), F.round(F.avg(F.when(F.col("rank") <= 5, 1.0).otherwise(0.0)), 6).alias("hit_5"))


def percentile_lower(values: DataFrame, column: str, key: str, p: float) -> DataFrame:
    """The lower nearest-rank percentile of each key: the value at place int(p * (n - 1)) of the sorted ones, exactly.

    Values are dealt into ranges of equal depth by key and value, so a key of a third of all rows has many; counts of keys in
    ranges say which range holds a key's place, and one row of it is fetched. Only those counts are windowed. Nulls are left out.
    """
    d = in_ranges(values.where(F.col(column).isNotNull()).select(F.col(key).alias("k"), F.col(column).alias("v")), "k", "v")
    c = d.groupBy(F.col("row.k").alias("k"), "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    w = Window.partitionBy("k")
    c = c.withColumns({"base": F.sum("n").over(w.orderBy("part")) - F.col("n"), "place": F.floor(F.lit(p) * (F.sum("n").over(w) - 1))})
    at = c.where((F.col("place") >= F.col("base")) & (F.col("place") < F.col("base") + F.col("n"))).select("part", (F.col("first") + F.col("place") - F.col("base")).alias("place"))
    return d.join(at, ["part", "place"]).select(F.col("row.k").alias(key), F.col("row.v").alias("value"))
