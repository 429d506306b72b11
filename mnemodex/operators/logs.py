"""Latest-state folds over append-only logs, compaction, tombstones, compare-and-set.

A fold is one shuffle on the key with partial aggregation: max_by over the order column, never a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key and, as first_seen, the order of its first one."""
    rest = [c for c in log.columns if c != key]
    folded = log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("s"), F.min(order).alias("first_seen"))
    return folded.select(key, "s.*", "first_seen")


def live(folded: DataFrame, deleted: str = "deleted") -> DataFrame:
    return folded.where(~F.col(deleted))


def tombstones(folded: DataFrame, deleted: str = "deleted") -> DataFrame:
    return folded.where(F.col(deleted))


def vector_state(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Vectors (id, model, dim, vector, seq) of a base and its delta: the last write wins, dim 0 removes."""
    return latest(base.unionByName(delta), "id", "seq").where("dim > 0")


def removed_vectors(base: DataFrame, delta: DataFrame) -> DataFrame:
    return latest(base.unionByName(delta), "id", "seq").where("dim = 0").select("id")


def foreign_vectors(vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """(model, n) of vectors that this index cannot use."""
    return vectors.where((F.col("model") != model) | (F.col("dim") != dim)).groupBy("model").agg(F.count("*").alias("n"))


def index_health(vectors: DataFrame, model: str, dim: int) -> DataFrame:
    ok = (F.col("model") == model) & (F.col("dim") == dim)
    return vectors.agg(F.count_if(ok).alias("indexed"), F.count_if(~ok).alias("stale"))


def due_for_compaction(delta_bytes: int, base_bytes: int) -> bool:
    return delta_bytes >= C.MIN_COMPACT_BYTES and delta_bytes > C.COMPACT_RATIO * base_bytes


def compact_catalog(log: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, tombstones kept, in first-seen order by value."""
    return latest(log, key, order)


def catalog_counts(folded: DataFrame, deleted: str = "deleted") -> DataFrame:
    """One row: live, named (tombstones too), dropped."""
    d = F.col(deleted)
    return folded.agg(F.count_if(~d).alias("live"), F.count("*").alias("named"), F.count_if(d).alias("dropped"))


def feed_counters(events: DataFrame, key: str, order: str, deleted, readable, page: int = 0) -> DataFrame:
    """A change feed's walk as one row: events, deleted and unreadable ones, those that a later or earlier one of their key supersedes,
    and live keys: those whose last event neither deletes them nor is unreadable. With the rows of a page, also `pages`."""
    e = events.withColumn("gone_", F.coalesce(deleted, F.lit(False))).withColumn("bad_", ~F.col("gone_") & ~F.coalesce(readable, F.lit(False)))
    f = e.groupBy(key).agg(F.max_by(F.col("gone_") | F.col("bad_"), order).alias("off"), F.count("*").alias("n"), F.count_if("gone_").alias("gone"), F.count_if("bad_").alias("bad"))
    none = lambda c: F.coalesce(F.sum(c), F.lit(0))
    pages = [F.ceil(none(F.col("n")) / page).alias("pages")] if page else []
    return f.agg(none(F.col("n")).alias("events"), none(F.col("bad")).alias("unreadable"), *pages, none(F.col("gone")).alias("deleted"), none(F.col("n") - 1).alias("superseded"), F.count_if(~F.col("off")).alias("live"))


def first_created(writes: DataFrame, key: str, order: str, created: str) -> DataFrame:
    """Ranking metadata: the first creation time stays, everything else is of the last write."""
    rest = [c for c in writes.columns if c not in (key, created)]
    return writes.groupBy(key).agg(F.min_by(created, order).alias(created), F.max_by(F.struct(*rest), order).alias("s")).select(key, created, "s.*")


def enqueue(writes: DataFrame, key: str, order: str) -> DataFrame:
    """A queue with upserts: the first sequence number stays, payload and time are of the last write."""
    rest = [c for c in writes.columns if c not in (key, order)]
    return writes.groupBy(key).agg(F.min(order).alias("seq"), F.max_by(F.struct(*rest), order).alias("s")).select(key, "seq", "s.*")


def head_cas(writes: DataFrame, key: str, order: str, expect: str, delete: str | None = None) -> DataFrame:
    """Compare-and-set per key: writes(key, order, expect) in order; one is accepted iff it expects the current version
    (0 where there is none), which then rises by one. `outcome` tells a refusal's reason: not_found where a version is
    expected and there is none, else stale. Rows with the boolean column `delete` take the key away at the version they
    expect; one that is gone already is `absent`, which is no error.

    Sorted partitions are streamed, a key's state is one number, so a key with a third of all writes needs no memory.
    """
    import pyarrow as pa

    kinds = dict(writes.dtypes)

    def run(batches):
        last, version = object(), 0
        for batch in batches:
            k, e, gone = (batch.column(i).to_pylist() for i in (0, 2, 3))
            said, now = [], []
            for a, x, d in zip(k, e, gone):
                if a != last:
                    last, version = a, 0
                if d and not version:
                    said.append("absent")
                elif x == version:
                    said.append("accepted")
                    version = 0 if d else version + 1
                else:
                    said.append("stale" if version or not x else "not_found")
                now.append(version)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([x == "accepted" for x in said]), pa.array(said), pa.array(now, pa.int64())], names=[key, order, expect, "accepted", "outcome", "version"])

    rows = writes.select(key, order, expect, (F.coalesce(delete, F.lit(False)) if delete else F.lit(False)).alias("gone_"))
    rows = rows.repartition(key).sortWithinPartitions(key, order)
    return rows.mapInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {expect} {kinds[expect]}, accepted boolean, outcome string, version long")


def remove(folded: DataFrame, asked: DataFrame, key: str, order: str) -> DataFrame:
    """Log rows that mark the asked keys(key, order) as no longer held: their last entries, deleted, at the new order. Unknown keys give none, as their removal is an error of the caller."""
    rest = [c for c in folded.columns if c not in (key, order, "deleted", "first_seen")]
    return folded.drop(order, "deleted", "first_seen").join(asked.select(key, order).groupBy(key).agg(F.max(order).alias(order)), key).select(key, order, F.lit(True).alias("deleted"), *rest)


def unknown_keys(folded: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    return asked.select(key).distinct().join(folded, key, "left_anti")


def object_deleted(folded: DataFrame, gone: DataFrame, key: str, order: str) -> DataFrame:
    """Log rows for removed entries whose object left the network, asked as (key, object_ref, order): the same entry without
    object and slab. A live entry, one that names another object, and an empty reference change nothing."""
    rest = [c for c in folded.columns if c not in (key, order, "object_ref", "slab_id", "first_seen")]
    a = gone.where("object_ref <> ''").groupBy(key, "object_ref").agg(F.max(order).alias(order))
    f = folded.where("deleted").drop(order, "first_seen", "slab_id")
    return f.join(a, [key, "object_ref"]).select(key, order, F.lit("").alias("object_ref"), F.lit("").alias("slab_id"), *rest)


def number_rows(df: DataFrame, order: str, name: str = "number") -> DataFrame:
    """Places from 0 by a column, ties apart by nothing else, in ranges of equal depth (`ordering.number_rows`)."""
    from .ordering import number_rows as places

    return places(df, order, name=name)


def stale_objects(folded: DataFrame) -> DataFrame:
    """Forgotten entries whose object remains on the network: (id, object_ref), but for objects that a live entry shares."""
    kept = folded.where(~F.col("deleted") & (F.col("object_ref") != "")).select("object_ref").distinct()
    return folded.where(F.col("deleted") & (F.col("object_ref") != "")).join(kept, "object_ref", "left_anti").select("id", "object_ref")
