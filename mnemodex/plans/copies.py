"""Registered queries over stored copies, feeds, session saves and schema versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs, stored, transcripts
from ..sources import migrations
from . import stand_ins as S
from .catalogue import query


def _feed(spark, sf):
    return S.catalog(spark, sf).select("seq", "id", "deleted", (F.col("seq") % 11 != 3).alias("readable"))


@query(f"WITH {S.LOG} SELECT id, max(seq) AS seq, min(seq) AS first_seen FROM log GROUP BY id HAVING NOT arg_max(deleted OR seq % 11 = 3, seq)")
def feed_live(spark, sf):
    return stored.feed_live(_feed(spark, sf), "id", "seq", F.col("deleted"), F.col("readable")).select("id", "seq", "first_seen")


@query(f"WITH {S.LOG}, f AS (SELECT id, arg_max(deleted OR seq % 11 = 3, seq) AS off, count(*) AS n FROM log GROUP BY id) SELECT count(*) AS events, count(*) FILTER (WHERE NOT deleted AND seq % 11 = 3) AS unreadable, CAST(ceil(count(*) / 300) AS BIGINT) AS pages, count(*) FILTER (WHERE deleted) AS deleted, (SELECT CAST(sum(n - 1) AS BIGINT) FROM f) AS superseded, (SELECT count(*) FROM f WHERE NOT off) AS live FROM log")
def feed_pages(spark, sf):
    return logs.feed_counters(_feed(spark, sf), "id", "seq", F.col("deleted"), F.col("readable"), page=300)


@query("SELECT s_suppkey AS slab, (row_number() OVER (ORDER BY s_suppkey) - 1) // 16 AS page FROM supplier")
def slab_pages(spark, sf):
    return stored.list_pages(S.slabs(spark, sf), "slab", 16)


@query("SELECT doc_id AS ref, substr(hex(encode(text)), 2 * (doc_id % 50) + 1, 40) AS part FROM documents")
def range_read(spark, sf):
    d = S.table(spark, sf, "documents").select(F.col("doc_id").alias("ref"), F.to_binary("text", F.lit("utf-8")).alias("content"))
    return stored.read_range(d, F.col("ref") % 50, 20).select("ref", F.hex("content").alias("part"))


@query(f"WITH {S.LOG}, fr AS (SELECT object_ref, arg_max(id, seq) AS named FROM log WHERE CAST(substr(object_ref, 2) AS INT) % 7 <> 0 GROUP BY 1) SELECT f.id, CASE WHEN named IS NULL THEN 'absent' WHEN named = f.id THEN 'read' ELSE 'foreign' END AS outcome, CASE WHEN named = f.id THEN 'body ' || named END AS body FROM folded f LEFT JOIN fr USING (object_ref) WHERE NOT deleted")
def read_copies(spark, sf):
    log = S.catalog(spark, sf)
    frames = log.where(F.substring("object_ref", 2, 9).cast("int") % 7 != 0).groupBy(F.col("object_ref").alias("ref")).agg(F.max_by("id", "seq").alias("id"))
    frames = frames.withColumn("sealed", F.concat(F.lit("body "), F.col("id").cast("string")).cast("binary"))
    return stored.read_copies(logs.live(logs.latest(log, "id", "seq")), frames).select("id", "outcome", F.col("sealed").cast("string").alias("body"))


@query(f"""WITH {S.REC}, r AS (SELECT *, CASE WHEN id % 10 = 5 THEN 'chunk' ELSE kind END AS k FROM rec) SELECT id, k AS kind,
 CASE WHEN id % 13 = 4 OR k = 'chunk' THEN NULL ELSE type END AS type, CASE WHEN k = 'chunk' THEN 1 WHEN id % 13 <> 4 THEN 1 + id % 4 END AS version, CASE WHEN k = 'chunk' THEN '' WHEN id % 13 <> 4 THEN lang || ',' || source END AS tags,
 CASE WHEN k = 'chunk' THEN 7 WHEN id % 13 <> 4 THEN created_at END AS written_at, CASE WHEN id % 13 = 4 THEN 'unreadable' WHEN id % 17 = 2 THEN 'names another record' END AS problem FROM r""")
def restored_entries(spark, sf):
    r = S.records(spark, sf)
    kind = F.when(F.col("id") % 10 == 5, "chunk").otherwise(F.col("kind"))
    named = F.when(F.col("id") % 17 == 2, F.col("id") + 1).otherwise(F.col("id")).cast("string")
    body = F.to_json(F.struct(named.alias("id"), "type", (F.col("id") % 4 + 1).alias("version"), "tags", F.col("created_at").alias("updated_at")))
    frames = r.select("id", kind.alias("kind"), F.when(F.col("id") % 13 == 4, "{").otherwise(body).alias("body"), F.lit("o").alias("ref"), F.lit("s").alias("slab"), F.col("n_chars").alias("bytes"), F.lit(7).cast("long").alias("updated_at"))
    return stored.catalog_entries(frames).select("id", "kind", "type", "version", F.array_join("tags", ",").alias("tags"), "written_at", "problem")


@query("""SELECT vec_id AS id, CASE WHEN vec_id % 10 = 3 THEN 'gone' WHEN vec_id % 7 = 1 OR vec_id % 6 = 5 THEN 'unembeddable' WHEN vec_id % 9 = 2 OR vec_id % 13 = 0 THEN 'gone'
 WHEN vec_id % 11 = 4 THEN 'unembeddable' ELSE 'written' END AS outcome FROM embeddings""")
def embed_outcomes(spark, sf):
    v = S.vectors(spark, sf)
    id_, memory = F.col("id"), F.lit("memory").alias("kind")
    before = v.where(id_ % 10 != 3).select("id", memory, (id_ % 7 != 1).alias("readable"), F.when(id_ % 6 != 5, F.col("vector")).alias("vector"))
    now = v.where(id_ % 9 != 2).select("id", F.when(id_ % 13 == 0, "session").otherwise("memory").alias("kind"), (id_ % 11 != 4).alias("readable"))
    return stored.embed_outcomes(v.select("id", memory), before, now).select("id", "outcome")


@query(f"""WITH {S.TURNS}, c AS (SELECT session, session || '/' || (pos // 4) AS id, session % 3 <> 0 AND count(created) > 0 AS dated FROM turns GROUP BY 1, 2, pos // 4),
 fit AS (SELECT session, bool_and(session % 5 < 3 AND session % 11 <> 3 AND session % 13 <> 4 AND session % 17 <> 5 AND NOT dated) AS ok FROM c GROUP BY session)
 SELECT session AS id, 2 AS version, true AS cleared FROM fit WHERE ok AND session % 2 = 0""")
def undated_heads(spark, sf):
    s = F.col("session")
    c = S.turns(spark, sf).groupBy("session", F.floor(F.col("pos") / 4).alias("n")).agg(F.count("created").alias("k"))
    c = c.select("session", F.concat_ws("/", s.cast("string"), F.col("n").cast("string")).alias("id"), ((s % 3 != 0) & (F.col("k") > 0)).alias("dated"))
    heads = c.groupBy(s.alias("id")).agg(F.collect_list("id").alias("chunks")).select("id", F.lit(1).alias("version"), F.col("id").alias("created"), (F.col("id") + F.col("id") % 2).alias("updated"), "chunks")
    entries = c.where(s % 11 != 3).select("id", F.concat(F.lit("s"), (s % 5).cast("string")).alias("slab_id"))
    ledger = spark.range(5).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("slab_id"), F.when(F.col("id") < 3, "hydrated").otherwise("pinned").alias("origin"))
    found = stored.undated_heads(heads, entries, ledger, c.where(s % 13 == 4), c.where(s % 17 != 5))
    return found.select("id", "version", (F.col("created").isNull() & F.col("updated").isNull()).alias("cleared"))


_SAVED = f"""WITH RECURSIVE {S.TURNS}, o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY pos) AS i FROM turns WHERE pos % 2 = 1 AND session % 3 < 2),
p AS (SELECT session, pos, id, bytes, i, 0 AS chunk, bytes AS held FROM o WHERE i = 1
 UNION ALL SELECT o.session, o.pos, o.id, o.bytes, o.i, p.chunk + CASE WHEN p.held + o.bytes > 300 THEN 1 ELSE 0 END, CASE WHEN p.held + o.bytes > 300 THEN o.bytes ELSE p.held + o.bytes END FROM p JOIN o ON o.session = p.session AND o.i = p.i + 1),
ids AS (SELECT DISTINCT session AS id FROM turns), h AS (SELECT id, 1 + id % 3 AS version, 2 + id % 4 AS chunks, 9 AS messages FROM ids WHERE id % 10 <> 9),
s AS (SELECT ids.id, CASE WHEN h.id IS NULL AND ids.id % 4 = 1 OR ids.id % 5 = 2 THEN 'no' ELSE 'yes' END AS fits, h.id IS NULL AS fresh, coalesce(h.chunks, 0) AS had FROM ids LEFT JOIN h USING (id) WHERE ids.id % 3 < 2),
v AS (SELECT *, CASE WHEN fits = 'yes' THEN 'accepted' WHEN fresh THEN 'not_found' ELSE 'stale' END AS outcome FROM s),
k AS (SELECT session, chunk + had AS seq, arg_min(p.id, pos) AS first, arg_max(p.id, pos) AS last, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, fits = 'no' AS withdrawn FROM p JOIN v ON v.id = session GROUP BY session, chunk, had, fits)"""


def _saved(spark, sf):
    t = S.turns(spark, sf)
    ids = t.select(F.col("session").alias("id")).distinct()
    id_ = F.col("id")
    heads = ids.where(id_ % 10 != 9).select("id", (id_ % 3 + 1).cast("long").alias("version"), (id_ % 4 + 2).cast("long").alias("chunks"), F.lit(9).cast("long").alias("messages"))
    stored_ = F.when(id_ % 10 == 9, 0).otherwise(id_ % 3 + 1)
    off = ((id_ % 10 == 9) & (id_ % 4 == 1)) | (id_ % 5 == 2)
    saves = ids.where(id_ % 3 < 2).select("id", (stored_ + F.when(off, 1).otherwise(0)).cast("long").alias("expect"))
    return transcripts.save_sessions(heads, saves, t.where("pos % 2 = 1 and session % 3 < 2"), target=300)


@query(f"""{_SAVED}, g AS (SELECT session AS id, count(*) AS c, CAST(sum(n) AS BIGINT) AS m FROM k WHERE NOT withdrawn GROUP BY 1)
SELECT id, coalesce(h.version, 0) + CASE WHEN outcome = 'accepted' THEN 1 ELSE 0 END AS version, coalesce(h.chunks, 0) + coalesce(c, 0) AS chunks, coalesce(h.messages, 0) + coalesce(m, 0) AS messages, outcome
FROM h FULL JOIN v USING (id) LEFT JOIN g USING (id) WHERE h.version IS NOT NULL OR outcome = 'accepted'""")
def session_save(spark, sf):
    return _saved(spark, sf)[0]


@query(f"{_SAVED} SELECT * FROM k")
def session_save_chunks(spark, sf):
    return _saved(spark, sf)[1]


@query(f"""WITH {S.SESS}, a AS (SELECT session, count(*) AS turns, min(pos) AS p0, max(pos) AS p1, min(pos) FILTER (WHERE said IS NOT NULL) AS d0, max(pos) FILTER (WHERE said IS NOT NULL) AS d1,
 arg_min(said, pos) FILTER (WHERE said IS NOT NULL) AS f, arg_max(said, pos) FILTER (WHERE said IS NOT NULL) AS l FROM (SELECT *, CASE WHEN session % 4 = 0 THEN pos + 1 WHEN session % 4 < 3 THEN created END AS said FROM turns) GROUP BY session)
SELECT session, turns, CASE WHEN d0 IS NULL THEN 'none' WHEN d0 = p0 AND d1 = p1 THEN 'both' ELSE 'some' END AS dated,
 CASE WHEN d0 IS NULL THEN coalesce('no later than ' || u, '') WHEN d0 = p0 AND d1 = p1 THEN 'from ' || f || ' to ' || l
 ELSE 'began ' || CASE WHEN d0 > p0 THEN 'before ' ELSE 'at ' END || f || ', ended ' || CASE WHEN d1 < p1 THEN 'after ' ELSE 'at ' END || l END AS span
FROM a JOIN (SELECT id, CASE WHEN id % 8 <> 7 THEN updated_at END AS u FROM sess) ON id = session""")
def resume_framing(spark, sf):
    s = F.col("session")
    said = F.when(s % 4 == 0, (F.col("pos") + 1).cast("long")).when(s % 4 < 3, F.col("created"))
    heads = S.sessions(spark, sf).select("id", F.when(F.col("id") % 8 != 7, F.col("updated_at")).alias("updated_at"))
    return transcripts.framing(S.turns(spark, sf).withColumn("created", said), heads)


_CASES = 7


@query(f"""WITH {S.TURNS} SELECT session, pos, CASE (session + pos) % {_CASES} WHEN 1 THEN 'missing id' WHEN 2 THEN 'unknown role' WHEN 3 THEN 'no parts' WHEN 4 THEN 'tool part without call id' WHEN 5 THEN 'id too long' END AS problem FROM turns""")
def message_validation(spark, sf):
    n = (F.col("session") + F.col("pos")) % _CASES
    inner = '[{"type":"tool_result","call_id":"c","content":[{"type":"text","text":"a"},{"type":"tool_call","call_id":" "}]}]'
    parts = F.when(n == 3, "[]").when(n == 4, inner).otherwise('[{"type":"text","text":"a"},{"type":"tool_call","call_id":"c"}]')
    t = S.turns(spark, sf).withColumns({"parts": parts, "id": F.when(n == 1, " ").when(n == 5, F.repeat(F.lit("x"), 257)).otherwise(F.col("id")), "role": F.when(n == 2, "nobody").otherwise(F.lit("user"))})
    return transcripts.message_problems(t).select("session", "pos", "problem")


STEPS = [
    migrations.Step(lambda d: d.withColumn("archived", F.lit(False)), lambda d: d.drop("archived")),
    migrations.Step(lambda d: d.withColumn("title", F.concat("lang", F.lit(" "), "source")).drop("lang", "source"), lambda d: d.withColumn("lang", F.split("title", " ")[0]).withColumn("source", F.split("title", " ")[1]).drop("title")),
]


@query("SELECT doc_id AS id, false AS archived, lang || ' ' || source AS title FROM documents")
def schema_up(spark, sf):
    return migrations.migrate(S.records(spark, sf).select("id", "lang", "source"), 0, 2, STEPS)


@query("SELECT doc_id AS id, lang, source FROM documents")
def schema_down(spark, sf):
    return migrations.migrate(schema_up(spark, sf), 2, 0, STEPS)
