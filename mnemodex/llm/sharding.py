"""Operator 12, sharding: a two-pass external shuffle into shards whose row counts are at most one apart.

Pass 1 scatters records uniformly: a seeded hash of a record's number names its bucket, and Spark's shuffle brings each bucket
to a partition of its own. The number of buckets follows the bytes, so that a bucket fits a task's memory. Pass 2 shuffles each
bucket by Fisher-Yates, with a generator seeded by the seed and the bucket, and writes it. A record's place in the whole
permutation is its bucket's first place, which is the number of records in the buckets before it, and its place there;
shards are equal stretches of the places, so a bucket writes to one shard or two, and a shard's files are whole buckets.

A bucket's first place travels in the same shuffle as one more row, so nothing is joined or broadcast; the running count has a
row for each bucket. Buckets hold rows by number, not by content: copies, hot sources and repeated ids are dealt like others,
and rows of equal texts are not kept together (a group may be larger than a shard).

The law is `rows`. Rows are numbered and written before the scatter, so a rerun after lost executors deals the same records to
the same buckets; reruns over the same files and partitions give the same shards.

Defined cases: a null text stays null, and counts as size 1 (no bytes, plus one) with the CRC of no bytes; ids need be neither
distinct nor present; repeated rows are rows; with fewer rows than shards some shards are empty; extra columns stay, but for
`shard` and `slot`, which are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, shared_dir, trim

#: Bytes of a bucket in memory, what a row counts besides its text, the least number of buckets, bytes of an output batch.
BUCKET_BYTES, ROW_BYTES, LEAST_BUCKETS, BATCH_BYTES = 24 << 20, 64, 128, 8 << 20


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of 0..n-1: from the last place down, each changes with a uniform one up to itself."""
    order = list(range(n))
    draw = np.random.Generator(np.random.PCG64([seed, bucket]))
    # a number up to each place, all drawn at once
    for i, j in zip(range(n - 1, 0, -1), draw.integers(0, np.arange(n, 1, -1)).tolist()):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def starts(rows: int, shards: int) -> list[int]:
    """The first place of each shard."""
    return [k * rows // shards for k in range(shards)]


def _shuffle(seed: int, rows: int, shards: int):
    first = np.array(starts(rows, shards), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        del held
        number, base = table["number_"], table["base_"]
        mark = np.flatnonzero(base.is_valid().to_numpy())
        bucket, at = table["bucket_"][int(mark[0])].as_py(), base[int(mark[0])].as_py()
        own = np.flatnonzero(number.is_valid().to_numpy())
        own = own[np.argsort(number.take(pa.array(own)).to_numpy(), kind="stable")]  # the order of arrival must not matter
        own = own[fisher_yates(len(own), seed, bucket)]
        place = at + np.arange(len(own))
        shard = np.searchsorted(first, place, side="right") - 1
        slot = place - first[shard]
        row = table["row_"]
        step = max(1, len(own) * BATCH_BYTES // max(1, table.nbytes))
        for a in range(0, len(own), step):
            part = row.take(pa.array(own[a : a + step])).combine_chunks()
            part = part.chunk(0) if isinstance(part, pa.ChunkedArray) else part
            yield pa.RecordBatch.from_arrays([part, pa.array(shard[a : a + step], pa.int32()), pa.array(slot[a : a + step], pa.int64())], names=["row", "shard", "slot"])
        trim()

    return run


def write_shards(docs: DataFrame, shards: int = 16, text_col: str = "text", seed: int = 12, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """Write the shuffled rows below `path` (by default in the shared folder), a folder for each shard, and read them back:
    the columns of docs, shard and slot (a shard's order, gapless from 0)."""
    spark = docs.sparkSession
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    d = docs.select(F.struct(*[docs[f"`{c}`"] for c in own]).alias("row_"), F.coalesce(F.octet_length(docs[text_col].cast("string")), F.lit(0)).alias("size_"), F.monotonically_increasing_id().alias("number_"))
    d = materialize(d)
    rows, size = d.agg(F.count("*"), F.coalesce(F.sum("size_"), F.lit(0))).first()
    buckets = buckets or max(LEAST_BUCKETS, -(-(size + rows * ROW_BYTES) // BUCKET_BYTES))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "number_"), F.lit(buckets)).cast("int")
    d = d.select(bucket.alias("bucket_"), "number_", F.lit(None).cast("long").alias("base_"), "row_")
    ahead = Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy("bucket_").agg(F.count("*").alias("n")).select("bucket_", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base_"))
    base = base.select("bucket_", F.lit(None).cast("long").alias("number_"), "base_", F.lit(None).cast(d.schema["row_"].dataType).alias("row_"))
    shard, slot = T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())
    out = T.StructType([T.StructField("row", d.schema["row_"].dataType), shard, slot])
    dealt = d.unionByName(base).repartitionById(buckets, F.col("bucket_")).mapInArrow(_shuffle(seed, rows, shards), out)
    path = path or shared_dir(spark)
    flat = dealt.select("row.*", "shard", "slot").sortWithinPartitions("shard", "slot")
    flat.write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(path)
    return spark.read.schema(T.StructType([*[f for f in docs.schema.fields if f.name in own], slot, shard])).parquet(path)


def digest(shards: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of shards read back."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return shards.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
