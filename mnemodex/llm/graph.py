"""Connected components of link tables: alternating large-star and small-star rounds.

Each round writes its edges to the shared folder, so lineage stays short and lost executors cost one
round at most. Before a round every task reduces its edges to a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest id of its component) of the given edges."""
    root: dict[int, int] = {}
    get = root.get
    for x, y in zip(a.tolist(), b.tolist()):
        while (p := get(x, x)) != x:
            root[x] = x = get(p, p)
        while (p := get(y, y)) != y:
            root[y] = y = get(p, p)
        if x < y:
            root[y] = x
        elif y < x:
            root[x] = y
    out = []
    for n in list(root):
        r = n
        while (p := get(r, r)) != r:
            r = p
        root[n] = r
        out.append(r)
    keys = np.fromiter(root, np.int64, len(root))
    return keys, np.array(out, np.int64)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, size = [], 0
    for batch in batches:
        parts.append(tuple(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)))
        size += batch.num_rows
        if size > 1 << 20:  # bounded memory: reduce what is held
            parts, size = [forest(*map(np.concatenate, zip(*parts)))], 0
    if parts:
        a, b = forest(*map(np.concatenate, zip(*parts)))
        for i in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], names=["a", "b"])


def _stars(e: DataFrame) -> bool:
    """Whether every node has one edge to a root, and no root has one: then the roots are the components."""
    ends = e.select(F.col("a").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("root")).union(e.select("b", F.lit(0), F.lit(1)))
    n = ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("root").alias("root"))
    return n.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("root") > 0))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node that occurs in (a, b), the component being its smallest id."""
    reduce = lambda e: e.where("a <> b").mapInArrow(_forest, "a long, b long").distinct()
    e = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    while not _stars(e):
        # large star: greater neighbours of a node move to the smallest of its neighbourhood
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours move to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        e = materialize(small.where("a <> b").mapInArrow(_forest, "a long, b long").distinct())
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
