"""The engine's frames, derived from the driver's tables, and the same derivations as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C

EPOCH = 1_704_067_200  # 2024-01-01, from which stand-in times count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as records: a fifth are sessions; doc d of last digit 9 supersedes d - 1; some are undated."""
    d = table(spark, sf_dir, "documents")
    types = F.array(*map(F.lit, C.TYPES))
    return d.select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, "session").otherwise("memory").alias("kind"), F.element_at(types, (F.col("doc_id") % 6 + 1).cast("int")).alias("type"),
        F.array("lang", "source").alias("tags"), F.when(F.col("doc_id") % 10 == 9, F.col("doc_id") - 1).alias("supersedes"),
        F.when(F.col("doc_id") % 50 != 7, F.col("doc_id") + EPOCH).alias("created_at"), "text", "lang", "source", "n_chars",
    )


REC = """rec AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'session' ELSE 'memory' END AS kind,
  ['fact', 'preference', 'insight', 'doc', 'profile', 'correction'][1 + doc_id % 6] AS type, CASE WHEN doc_id % 10 = 9 THEN doc_id - 1 END AS supersedes,
  CASE WHEN doc_id % 50 <> 7 THEN doc_id + 1704067200 END AS created_at, text, lang, source, n_chars FROM documents),
tag AS (SELECT DISTINCT id, unnest([lang, source]) AS tag FROM rec)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def query_vector(spark: SparkSession, sf_dir: str, id_: int = 0) -> list[float]:
    """The vector of one row, by a pushed filter; an embedding model would supply it."""
    row = vectors(spark, sf_dir).where(F.col("id") == id_).select("vector").first()
    return [float(x) for x in row[0]] if row else [0.0]


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("session"), F.col("turn").alias("pos"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "role", "text",
        F.when(F.col("turn") % 3 != 0, F.col("conv_id") * 1000 + F.col("turn") + EPOCH).alias("created"), F.octet_length("text").cast("long").alias("bytes"),
    )


TURNS = """turns AS (SELECT conv_id AS session, turn AS pos, conv_id || ':' || turn AS id, role, text,
  CASE WHEN turn % 3 <> 0 THEN conv_id * 1000 + turn + 1704067200 END AS created, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM conversations)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as session heads."""
    t = turns(spark, sf_dir)
    s = t.groupBy(F.col("session").alias("id")).agg(F.count("*").alias("messages"), F.sum("bytes").alias("bytes"), F.max("created").alias("updated_at"), F.min_by("text", "pos").alias("first"))
    kind = F.element_at(F.array(*map(F.lit, C.SESSION_KINDS)), (F.col("id") % 3 + 1).cast("int"))
    return s.select("id", F.substring("first", 1, 40).alias("title"), kind.alias("kind"), F.concat(F.lit("p"), (F.col("id") % 7).cast("string")).alias("project"), (F.col("id") % 9 == 4).alias("archived"), "messages", "bytes", "updated_at", F.array(F.concat(F.lit("t"), (F.col("id") % 4).cast("string"))).alias("tags"), F.when(F.col("id") % 3 == 1, F.col("id") - 1).alias("parent"))


SESS = (
    TURNS
    + """,
sess AS (SELECT id, substr(first, 1, 40) AS title, ['main', 'subagent', 'background'][1 + id % 3] AS kind, 'p' || (id % 7) AS project, id % 9 = 4 AS archived,
  messages, bytes, updated_at, 't' || (id % 4) AS tag, CASE WHEN id % 3 = 1 THEN id - 1 END AS parent FROM
  (SELECT session AS id, count(*) AS messages, CAST(sum(bytes) AS BIGINT) AS bytes, max(created) AS updated_at, arg_min(text, pos) AS first FROM turns GROUP BY session))"""
)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a catalog log: an entry per user, errors are tombstones."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.element_at(F.array(*map(F.lit, C.KINDS)), (F.col("user_id") % 3 + 1).cast("int")).alias("kind"), (F.col("event_type") == "error").alias("deleted"),
        F.concat(F.lit("o"), (F.col("event_id") % 500).cast("string")).alias("object_ref"), F.concat(F.lit("s"), (F.col("event_id") % 40).cast("string")).alias("slab_id"), F.col("value").alias("bytes"),
    )


LOG = """log AS (SELECT event_id AS seq, user_id AS id, ['memory', 'session', 'chunk'][1 + user_id % 3] AS kind, event_type = 'error' AS deleted,
  'o' || (event_id % 500) AS object_ref, 's' || (event_id % 40) AS slab_id, value AS bytes FROM events),
folded AS (SELECT id, max(seq) AS seq, min(seq) AS first_seen, arg_max(kind, seq) AS kind, arg_max(deleted, seq) AS deleted,
  arg_max(object_ref, seq) AS object_ref, arg_max(slab_id, seq) AS slab_id, arg_max(bytes, seq) AS bytes FROM log GROUP BY id)"""


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as stored objects: a slab is a supplier, open lines are live."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("ref"), F.col("l_suppkey").alias("slab"), (F.col("l_linestatus") == "O").alias("live"), F.col("l_quantity").cast("long").alias("bytes"))


OBJ = "obj AS (SELECT l_orderkey || ':' || l_linenumber AS ref, l_suppkey AS slab, l_linestatus = 'O' AS live, CAST(l_quantity AS BIGINT) AS bytes FROM lineitem)"


def slabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("slab"))


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    claimed = F.when(F.col("event_id") % 4 == 1, F.col("ts"))
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("r"), (F.col("event_id") % 3000).cast("string")).alias("record_id"), F.col("ts").alias("queued_at"), F.col("props").alias("payload"), claimed.alias("claimed_at"), F.col("user_id").cast("string").alias("key"), F.octet_length("props").cast("long").alias("bytes"))


QUEUE = """queue AS (SELECT event_id AS seq, 'r' || (event_id % 3000) AS record_id, ts AS queued_at, props AS payload, CASE WHEN event_id % 4 = 1 THEN ts END AS claimed_at,
  CAST(user_id AS VARCHAR) AS key, CAST(octet_length(encode(props)) AS BIGINT) AS bytes FROM events)"""
