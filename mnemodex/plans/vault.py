"""Registered queries over a device's own files: the vector log and its damage, a rebuilt index, a restored vault."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import vectors
from ..sources.device import Device
from ..sources.formats import pack_frames
from ..sources.shared import shared_dir
from . import stand_ins as S
from .catalogue import query

_HEX = "lpad(lower(hex({0})), 32, '0')"  # the same in Spark and DuckDB
_BYTES = 4 + vectors.OVERHEAD + 1


def _number(c):
    """A record's number again."""
    return F.conv(F.substring(c, 17, 16), 16, 10).cast("long")


def _vectors(spark, sf):
    """embeddings as records of the log: vector v is of model m or n."""
    return S.vectors(spark, sf).select(F.col("id").alias("n"), F.expr(_HEX.format("id")).alias("id"), F.when(F.col("id") % 2 == 0, "m").otherwise("n").alias("model"), "vector")


@query(f"""WITH v AS (SELECT vec_id AS n, vec_id // 16 AS ref, embedding AS e, {_BYTES} + 4 * len(embedding) AS b, row_number() OVER (PARTITION BY vec_id // 16 ORDER BY vec_id) AS i, count(*) OVER (PARTITION BY vec_id // 16) AS k FROM embeddings),
s AS (SELECT *, CASE ref % 5 WHEN 0 THEN true WHEN 1 THEN i > 1 WHEN 2 THEN false WHEN 3 THEN i < k ELSE false END AS ok FROM v)
SELECT ref, count(*) FILTER (WHERE ok) AS entries, min(n) FILTER (WHERE ok) AS lowest, max(e[1]) FILTER (WHERE ok) AS top, CAST(CASE WHEN ref % 5 = 1 THEN 1 ELSE 0 END AS BIGINT) AS skipped,
 CAST(CASE WHEN ref % 5 = 2 OR ref % 5 = 4 AND count(*) > 1 THEN sum(b) ELSE 0 END AS BIGINT) AS lost FROM s GROUP BY ref HAVING count(*) FILTER (WHERE ok) > 0 OR ref % 5 = 1 OR ref % 5 = 2 OR ref % 5 = 4 AND count(*) > 1""")
def vector_log_damage(spark, sf):
    """Segments of 16 vectors, of five kinds: whole; the first record does not open; the first length is wild in a base; a delta cut off in its last record; a
    delta whose first length is wild before whole records."""
    v = _vectors(spark, sf).select(F.floor(F.col("n") / 16).alias("ref"), F.col("n").alias("pos"), "id", "model", "vector")
    kind, wild = F.col("ref") % 5, F.unhex(F.lit("FFFFFFFF"))
    c = F.col("content")
    content = F.when(kind == 1, F.overlay(c, F.lit(b"x"), 7, 1)).when(kind.isin(2, 4), F.overlay(c, wild, 1, 4)).when(kind == 3, F.substring(c, F.lit(1), F.octet_length(c) - 1)).otherwise(c)
    blobs = vectors.pack_vectors(v).select(F.lit(0).alias("seq"), F.col("ref").cast("int").alias("segment"), content.alias("content"), (kind > 2).alias("delta"))
    read = vectors.read_vectors(blobs)
    return read.groupBy(F.col("segment").cast("long").alias("ref")).agg(F.count("id").alias("entries"), F.min(_number("id")).alias("lowest"), F.max(F.try_element_at("vector", F.lit(1))).alias("top"), F.sum("skipped").alias("skipped"), F.sum("lost").alias("lost"))


@query("""WITH v AS (SELECT *, vec_id % 5 = 2 AND vec_id % 21 <> 3 AS turned FROM embeddings WHERE vec_id % 7 <> 3 OR vec_id % 21 = 3)
SELECT vec_id, CASE WHEN turned THEN 'again' WHEN vec_id % 2 = 0 THEN 'm' ELSE 'n' END AS model, CAST(len(embedding) AS INTEGER) AS dim, CASE WHEN turned THEN embedding[len(embedding)] ELSE embedding[1] END AS first FROM v""")
def vector_log_state(spark, sf):
    """Vectors written, a fifth of them again turned round, folded into a base, a seventh removed, and a third of those written once more."""
    v = _vectors(spark, sf)
    log = vectors.VectorLog(spark, shared_dir(spark, "vectors"))
    log.append(v)
    log.append(v.where("n % 5 = 2").select("id", F.lit("again").alias("model"), F.reverse("vector").alias("vector")))
    log.compact()
    log.remove(v.where("n % 7 = 3"))
    log.append(v.where("n % 21 = 3"))
    return log.reading().state().select(_number("id").alias("vec_id"), "model", "dim", F.col("vector")[0].alias("first"))


def _size(texts):
    """A stand-in for a model: a text's bytes, and whether it may be embedded."""
    n = F.octet_length("text")
    return texts.select("id", F.when(n % 17 != 5, F.array(n.cast("float"), F.lit(1.0).cast("float"))).alias("vector"))


@query("""WITH r AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'session' ELSE 'memory' END AS kind, octet_length(encode(text)) AS n, doc_id % 4 <> 1 AS whole, doc_id % 9 <> 2 AS listed, doc_id % 3 = 0 AS had, doc_id % 8 = 7 AS gone FROM documents)
SELECT id, CASE WHEN had THEN -1 ELSE n END AS size FROM r WHERE had AND NOT gone AND (whole OR listed AND doc_catalogued(id)) OR NOT (had AND NOT gone) AND NOT gone AND listed AND whole AND n % 17 <> 5""".replace("doc_catalogued(id)", "id % 6 < 4"))
def index_repaired(spark, sf):
    """A rebuild of an index that lacks two thirds of its vectors, holds some of records that are gone and saw some removed."""
    d = Device(spark, shared_dir(spark, "device"), "size")
    r = S.records(spark, sf).select(F.col("id").alias("n"), F.expr(_HEX.format("id")).alias("id"), "kind", F.coalesce("text", F.lit("")).alias("text"))
    n = F.col("n")
    whole = r.where(n % 4 != 1)
    no = {"type": F.lit(""), "version": F.lit(1).cast("long"), "tags": F.array().cast("array<string>"), "written_at": F.lit(1).cast("long"), "object_ref": F.lit(""), "slab_id": F.lit(""), "bytes": F.lit(1).cast("long"), "deleted": F.lit(False)}
    d._append(d.catalog, r.where(n % 6 < 4).withColumns(no))
    d._append(d.ranking, r.where(n % 9 != 2).withColumns(no))
    d._append(d.bodies, whole.where("kind = 'memory'").select("id", "kind", F.to_json(F.struct(F.col("text").alias("statement"))).alias("body")))
    zero = F.lit(0).cast("long")
    d._append(d.heads, whole.where("kind = 'session'").select("id", F.col("text").alias("title"), *[zero.alias(c) for c in ("messages", "chunks", "bytes", "created", "updated")]))
    kept = F.array(F.lit(-1.0).cast("float"), F.lit(1.0).cast("float")).alias("vector")
    d.vectors.append(r.where(n % 3 == 0).select("id", F.lit("size").alias("model"), kept))
    d.vectors.remove(r.where(n % 8 == 7))
    d.vectors.owe()
    report = d.repair_index(_size)
    if report["unfinished"]:
        raise RuntimeError(f"the rebuild is not finished: {report}")
    return d.vectors.reading().state().select(_number("id").alias("id"), F.col("vector")[0].cast("long").alias("size"))


_BODY = """'{"id":"' || lpad(lower(hex(doc_id)), 32, '0') || '","type":"fact","version":' || (1 + doc_id % 3) || ',"tags":["a"],"updated_at":' || doc_id || ',"statement":"' || md5(coalesce(text, '')) || '"}'"""


@query(f"""WITH f AS (SELECT doc_id, doc_id % 40 AS ref, doc_id % 40 % 7 AS slab, {_BODY} AS body FROM documents WHERE doc_id % 11 <> 3 AND doc_id % 13 <> 4),
s AS (SELECT slab, count(*) AS records FROM f GROUP BY slab)
SELECT doc_id AS id, 's' || slab AS slab, CAST(1 + length(body) AS BIGINT) AS bytes, CAST(1 + doc_id % 3 AS BIGINT) AS version, md5(body) AS body_md5, records AS slab_records, CASE WHEN slab = 2 THEN 'pinned' ELSE 'hydrated' END AS origin FROM f JOIN s USING (slab)""")
def restored_vault(spark, sf):
    """documents as frames in forty objects on seven slabs, taken up by a device: an eleventh is another vault's, a thirteenth was forgotten here, one slab was pinned here."""
    d = Device(spark, shared_dir(spark, "device"), "size")
    t = S.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.col("doc_id")
    body = F.concat(F.lit('{"id":"'), F.expr(_HEX.format("doc_id")), F.lit('","type":"fact","version":'), (n % 3 + 1).cast("string"), F.lit(',"tags":["a"],"updated_at":'), n.cast("string"), F.lit(',"statement":"'), F.md5(F.col("text").cast("binary")), F.lit('"}'))
    ref = n % 40
    frames = t.select(ref.cast("string").alias("ref"), n.alias("pos"), F.lit("memory").alias("kind"), F.expr(_HEX.format("doc_id")).alias("id"), F.concat(F.when(n % 11 == 3, "X").otherwise("S"), body).cast("binary").alias("sealed"))
    objects = pack_frames(frames).select("ref", "content", F.concat(F.lit("s"), (F.col("ref").cast("int") % 7).cast("string")).alias("slab"), F.lit(1).cast("long").alias("updated_at"))
    no = {"type": F.lit(""), "version": F.lit(1).cast("long"), "tags": F.array().cast("array<string>"), "written_at": F.lit(1).cast("long"), "object_ref": F.lit(""), "slab_id": F.lit(""), "bytes": F.lit(1).cast("long")}
    d._append(d.catalog, frames.where("pos % 13 = 4").select("id", "kind").withColumns({**no, "deleted": F.lit(True)}))
    d._append(d.ledger, objects.where("slab = 's2'").select(F.col("slab").alias("slab_id"), F.lit("pinned").alias("origin"), F.lit(0).cast("long").alias("records"), F.lit(0).cast("long").alias("bytes")).distinct())
    d.restore(objects, lambda c: F.when(F.substring(c, 1, 1).cast("string") == "S", F.substring(c, 2, 1 << 30).cast("string")))
    c = d.catalog.state().where("not deleted").select("id", F.col("slab_id").alias("slab"), "bytes", "version")
    led = d.ledger.state().select(F.col("slab_id").alias("slab"), F.col("records").alias("slab_records"), "origin")
    return c.join(d.bodies.state().select("id", F.md5(F.col("body").cast("binary")).alias("body_md5")), "id").join(led, "slab").withColumn("id", _number("id"))
