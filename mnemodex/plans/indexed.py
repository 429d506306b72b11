"""Registered queries over stores on disk: a lexical index that was written, written again in part and forgotten in part, and packed slabs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval
from ..sources.lexical import LexicalIndex
from ..sources.shared import shared_dir, written
from ..sources.slabs import SlabStore
from . import stand_ins as S
from .catalogue import _BEST, _RANK, BM25, QUERY_TEXT, _parts, _pool, _request, query


def _index(spark, sf) -> LexicalIndex:
    """documents in an index in the shared folder: a seventh was written with other texts first, and as many more came and went."""
    d = S.records(spark, sf).select("id", "text")
    index = LexicalIndex(spark, shared_dir(spark, "lexical"))
    old = F.when(F.col("id") % 7 == 3, F.reverse("text")).otherwise(F.col("text"))
    index.put(d.select("id", old.alias("text")).unionByName(d.where("id % 7 = 2").select((-F.col("id") - 1).alias("id"), "text")))
    index.forget(d.where("id % 7 = 2").select((-F.col("id") - 1).alias("id")))
    index.put(d.where("id % 7 = 3"))
    return index


@query(f"WITH {BM25} SELECT id, round(score, 6) AS score FROM lex ORDER BY lex.score DESC, id LIMIT 10")
def bm25_stored(spark, sf):
    return retrieval.shown(retrieval.bm25_topk(_index(spark, sf), T.analyze(QUERY_TEXT), 10))


@query(f"WITH {_pool()} {_RANK} WHERE NOT superseded {_BEST} LIMIT 10")
def recall_stored(spark, sf):
    v, _, m = _parts(spark, sf)
    return retrieval.recall(v, _index(spark, sf), m, _request(spark, sf))


@query(f"WITH {_pool(repr('memory'))} {_RANK} WHERE NOT superseded AND kind = 'memory' {_BEST} LIMIT 10")
def recall_stored_scoped(spark, sf):
    v, _, m = _parts(spark, sf)
    return retrieval.recall(v, _index(spark, sf), m, _request(spark, sf, kinds=["memory"]))


def _blobs(spark, sf):
    d = S.records(spark, sf)
    body = F.coalesce("text", F.lit("")).cast("binary")
    return d.select(F.md5(F.col("id").cast("string").cast("binary")).alias("id"), F.lit("memory").alias("kind"), F.sha2(body, 256).alias("cid"), body.alias("payload"), F.col("id").alias("n"))


@query("""SELECT md5(CAST(doc_id AS VARCHAR)) AS id, md5(coalesce(text, '')) AS payload_md5, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes, true AS moved FROM documents WHERE doc_id % 3 > 0""")
def repacked_blobs(spark, sf):
    """Texts as blobs of two writes, a third of them forgotten; after a repack each is read back from a slab of the repack."""
    store = SlabStore(spark, shared_dir(spark, "slabs"), slab_bytes=1 << 20)
    b = _blobs(spark, sf)
    for part in (0, 1):
        store.put(b.where(F.col("n") % 2 == part).drop("n"))
    before = written(store.ledger.state().where("state = 'pinned'").select("slab"))
    store.forget(b.where("n % 3 = 0").select("id"))
    store.repack()
    live = store.live().select("id", F.col("object_ref").alias("ref"), F.col("slab_id").alias("slab"), "bytes")
    old = before.withColumn("old", F.lit(True))
    read = store.read(live).select("ref", F.md5("payload").alias("payload_md5"))
    return live.join(read, "ref").join(old, "slab", "left").select("id", "payload_md5", "bytes", F.col("old").isNull().alias("moved"))
