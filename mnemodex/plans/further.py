"""Further registered queries: point reads, revisions, caches, restores, sweeps, formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import constants as C
from ..operators import listing, logs, retrieval, storage, transcripts
from ..sources import formats
from . import stand_ins as S
from .catalogue import _BOOST, _OWN, BM25, DENSE, _parts, _pool, _request, query


@query(f"WITH {S.REC} SELECT id, kind, type FROM rec WHERE id = 42")
def point_lookup(spark, sf):
    return S.records(spark, sf).where("id = 42").select("id", "kind", "type")


@query(f"WITH {S.REC} SELECT id, created_at FROM rec WHERE kind = 'session' ORDER BY created_at, id")
def ids_of_kind(spark, sf):
    return S.records(spark, sf).where("kind = 'session'").orderBy("created_at", "id").select("id", "created_at")


@query(f"WITH {S.REC} SELECT rec.id, kind, type, coalesce(t, '') AS tags FROM rec LEFT JOIN (SELECT id, string_agg(tag, ',' ORDER BY tag) AS t FROM tag GROUP BY id) USING (id)")
def ranking_meta_all(spark, sf):
    r = S.records(spark, sf)
    t = listing.tag_rows(r).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("t"))
    return r.join(t, "id", "left").select("id", "kind", "type", F.coalesce("t", F.lit("")).alias("tags"))


@query(f"WITH {S.REC}, {S.LOG} SELECT id, kind FROM rec WHERE id NOT IN (SELECT id FROM folded WHERE deleted)")
def ranking_meta_forget(spark, sf):
    gone = logs.tombstones(logs.latest(S.catalog(spark, sf), "id", "seq")).select("id")
    return S.records(spark, sf).join(gone, "id", "left_anti").select("id", "kind")


@query(f"WITH {S.SESS} SELECT id, title FROM sess")
def session_titles(spark, sf):
    return S.sessions(spark, sf).select("id", "title")


@query(f"WITH {S.SESS} SELECT parent AS id, row_number() OVER (PARTITION BY parent ORDER BY id) - 1 AS pos, id AS child, title FROM sess WHERE parent IN (SELECT id FROM sess)")
def session_children(spark, sf):
    return transcripts.children(S.sessions(spark, sf)).select("id", F.col("pos").cast("long").alias("pos"), "child", "title")


@query(f"WITH {S.LOG} SELECT coalesce(f.id, v.vec_id) AS id, CASE WHEN f.id IS NOT NULL THEN 'catalog' ELSE 'held' END AS source FROM (SELECT id FROM folded WHERE NOT deleted) f FULL JOIN embeddings v ON v.vec_id = f.id")
def chunk_record_ids(spark, sf):
    live = logs.live(logs.latest(S.catalog(spark, sf), "id", "seq"))
    return transcripts.record_ids(live, S.vectors(spark, sf))


@query("""WITH r AS (SELECT user_id AS id, event_id % 20 AS child, arg_max(event_type <> 'error', event_id) AS add FROM events GROUP BY 1, 2), c AS (SELECT DISTINCT user_id AS id, 100 + user_id % 3 AS child FROM events UNION SELECT DISTINCT user_id, user_id % 20 FROM events)
SELECT id, child FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.id = c.id AND r.child = c.child AND NOT add) UNION SELECT id, child FROM r WHERE add""")
def edge_revisions(spark, sf):
    e = S.table(spark, sf, "events")
    now = e.select(F.col("user_id").alias("id"), (F.col("user_id") % 3 + 100).alias("child")).union(e.select("user_id", F.col("user_id") % 20))
    rev = e.select(F.col("user_id").alias("id"), (F.col("event_id") % 20).alias("child"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("add"))
    return transcripts.revise_edges(now, rev)


@query(f"WITH {S.TURNS} SELECT session, pos, '### ' || role || chr(10) || coalesce(text, '') || chr(10) || chr(10) AS line FROM turns")
def transcript_render(spark, sf):
    return transcripts.render(S.turns(spark, sf))


@query(f"WITH {S.SESS} SELECT id, CASE WHEN id % 2 = 0 THEN 'new' ELSE title END AS title, messages + CASE WHEN id % 2 = 0 THEN 2 ELSE 0 END AS messages, CASE WHEN id % 2 = 0 THEN 'a,b' ELSE 'a' END AS models FROM sess")
def head_merge(spark, sf):
    s = S.sessions(spark, sf)
    old = s.select("id", "title", F.lit("s").alias("summary"), F.array(F.lit("a")).alias("models"), "messages", "bytes")
    new = s.where("id % 2 = 0").select("id", F.lit("new").alias("title"), F.lit("").alias("summary"), F.array(F.lit("b"), F.lit("a")).alias("models"), F.lit(2).alias("messages"), F.lit(0).alias("bytes"))
    return transcripts.merge_head(old, new).select("id", "title", "messages", F.array_join("models", ",").alias("models"))


@query(f"WITH {S.TURNS}, n AS (SELECT session, id FROM turns WHERE pos % 2 = 1 UNION ALL SELECT session, id FROM turns WHERE pos = 1 AND session % 3 = 0), e AS (SELECT session, arg_min(id, pos) AS f, arg_max(id, pos) AS l FROM turns GROUP BY session) SELECT session, id FROM n GROUP BY session, id HAVING count(*) > 1 UNION SELECT n.session, n.id FROM n JOIN e ON e.session = n.session AND n.id IN (f, l)")
def duplicate_appends(spark, sf):
    t = S.turns(spark, sf)
    new = t.where("pos % 2 = 1").select("session", "id").union(t.where("pos = 1 and session % 3 = 0").select("session", "id"))
    return transcripts.duplicate_appends(new, transcripts.chunk_refs(t.withColumn("chunk", F.lit(0))))


@query(f"WITH {S.TURNS} SELECT session, CAST(CASE WHEN max(CASE WHEN id = '3:5' THEN 1 ELSE 0 END) = 1 THEN min(pos // 4) FILTER (WHERE id = '3:5') ELSE 0 END AS BIGINT) AS seq FROM (SELECT *, first_value(id) OVER w AS f, last_value(id) OVER w AS l FROM turns WINDOW w AS (PARTITION BY session, pos // 4 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE id IN (f, l) GROUP BY session")
def start_chunk(spark, sf):
    refs = transcripts.chunk_refs(S.turns(spark, sf).withColumn("chunk", F.floor(F.col("pos") / 4)))
    return transcripts.start_chunk(refs, "3:5")


@query("SELECT o.user_id AS id, min(CASE WHEN epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last) < 86400000000 AND (s.slab IS NOT NULL) THEN 1 ELSE 0 END) = 1 AS hit FROM (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) o, unnest([user_id % 4, user_id % 7]) AS x(slab) LEFT JOIN (SELECT DISTINCT user_id % 6 AS slab FROM events) s ON s.slab = x.slab GROUP BY 1")
def cache_hits(spark, sf):
    e = S.table(spark, sf, "events")
    loc = e.groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("cached_at")).withColumn("slabs", F.array(F.col("id") % 4, F.col("id") % 7))
    slabs = e.select((F.col("user_id") % 6).alias("slab")).distinct().withColumn("cached_at", F.lit("2024-01-30 23:00:00").cast("timestamp"))
    return storage.cache_hits(loc, slabs, "2024-01-31 00:00:00", 86_400)


@query("SELECT count(*) AS objects, CAST(sum(octet_length(encode(props))) AS BIGINT) AS objects_bytes, (SELECT count(*) FROM supplier) AS slabs, (SELECT CAST(sum(octet_length(encode(s_name))) AS BIGINT) FROM supplier) AS slabs_bytes, (sum(octet_length(encode(props))) + (SELECT sum(octet_length(encode(s_name))) FROM supplier)) / count(*) AS per_object FROM events")
def cache_size(spark, sf):
    return storage.cache_size(S.table(spark, sf, "events").select(F.col("props").alias("blob")), S.table(spark, sf, "supplier").select(F.col("s_name").alias("blob")))


@query("SELECT slab_id, 'pinned' AS origin, origin = 'hydrated' AS taken FROM (SELECT 's' || (event_id % 40) AS slab_id, max(CASE WHEN event_id % 40 < 11 THEN 'hydrated' ELSE 'pinned' END) AS origin FROM events GROUP BY 1)")
def take_slab_ownership(spark, sf):
    e = S.catalog(spark, sf).groupBy("slab_id").agg(F.max(F.when(F.col("seq") % 40 < 11, "hydrated").otherwise("pinned")).alias("origin"))
    return storage.take_ownership(e)


@query("SELECT user_id AS id, 's' || (user_id % 5) || '=m' || (user_id % 5) || ',s' || (user_id % 3) || '=m' || (user_id % 3) AS slabs FROM events GROUP BY user_id")
def location_rejoin(spark, sf):
    e = S.table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()
    slab = lambda n: F.struct(F.concat(F.lit("s"), (F.col("id") % n).cast("string")).alias("slab"), F.concat(F.lit("m"), (F.col("id") % n).cast("string")).alias("meta"))
    o, s = storage.split_locations(e.withColumn("slabs", F.array(slab(5), slab(3))))
    j = storage.join_locations(o, s)
    return j.select("id", F.array_join(F.transform("slabs", lambda x: F.concat(x["slab"], F.lit("="), x["meta"])), ",").alias("slabs"))


def _frames(spark, sf):
    """records as frames found by a walk: ten to an object, every 13th of another vault."""
    r = S.records(spark, sf)
    kind = F.when(F.col("id") % 4 == 3, "chunk").otherwise(F.col("kind"))
    return r.select(F.floor(F.col("id") / 10).alias("ref"), (F.col("id") % 40).alias("slab"), "id", kind.alias("kind"), (F.col("id") % 13 != 5).alias("opened"), F.col("n_chars").alias("bytes"))


_FRAMES = """found AS (SELECT id // 10 AS ref, id % 40 AS slab, id, CASE WHEN id % 4 = 3 THEN 'chunk' ELSE kind END AS kind, n_chars AS bytes,
  CASE WHEN id % 13 = 5 THEN 'foreign' WHEN id IN (SELECT id FROM folded WHERE deleted) THEN 'forgotten' ELSE 'restored' END AS outcome FROM rec)"""


def _restored(spark, sf, depth):
    return storage.restore_plan(_frames(spark, sf), logs.tombstones(logs.latest(S.catalog(spark, sf), "id", "seq")), depth)


@query(f"WITH {S.REC}, {S.LOG}, {_FRAMES} SELECT id, depth, outcome, outcome = 'restored' AS catalogued, outcome = 'restored' AND n > 0 AS body, outcome = 'restored' AND n > 0 AND kind IN ('memory', 'session') AS ranked, outcome = 'restored' AND n = 2 AND kind IN ('memory', 'session') AS embedded FROM found, (VALUES ('catalog', 0), ('metadata', 1), ('index', 2)) d(depth, n)")
def restore_plan(spark, sf):
    every = [_restored(spark, sf, d).select("id", F.lit(d).alias("depth"), "outcome", "catalogued", "body", "ranked", "embedded") for d in storage.DEPTHS]
    return every[0].union(every[1]).union(every[2])


@query(f"WITH {S.REC}, {S.LOG}, {_FRAMES}, r AS (SELECT * FROM found WHERE outcome = 'restored') SELECT (SELECT count(DISTINCT ref) FROM found) AS objects, (SELECT count(*) FROM found) AS frames, (SELECT count(*) FROM found WHERE id % 13 = 5) AS foreign, (SELECT count(*) FROM found WHERE outcome = 'forgotten') AS forgotten, count(*) AS records, count(DISTINCT slab) AS slabs, count(*) AS bodies, count(*) FILTER (WHERE kind <> 'chunk') AS embedded FROM r")
def restore_report(spark, sf):
    return storage.restore_report(_restored(spark, sf, "index"))


@query(f"WITH {S.REC}, {S.LOG}, {_FRAMES} SELECT slab AS slab_id, count(*) AS records, CAST(sum(bytes) AS BIGINT) AS bytes, 'hydrated' AS origin FROM found WHERE outcome = 'restored' GROUP BY slab")
def restore_adopts(spark, sf):
    return storage.adopted_slabs(_restored(spark, sf, "catalog"))


_HELD = """held AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey || ':' || l_linenumber AS ref, l_suppkey AS slab, l_orderkey % 97 = 0 AS gone FROM lineitem WHERE l_linestatus = 'O'),
written AS (SELECT id AS cid, 'n' || ref AS ref, CASE WHEN slab % 11 = 0 THEN slab ELSE 1000000 + id % 5 END AS slab FROM held WHERE NOT gone), owed AS (SELECT s_suppkey AS slab FROM supplier WHERE s_suppkey % 7 = 0)"""


def _repack(spark, sf):
    o = S.table(spark, sf, "lineitem").where("l_linestatus = 'O'")
    id_ = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    held = o.select(id_.alias("id"), id_.alias("cid"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("ref"), F.col("l_suppkey").cast("long").alias("slab"), (F.col("l_orderkey") % 97 == 0).alias("lost"))
    written = held.where("not lost").select("cid", F.concat(F.lit("n"), F.col("ref")).alias("ref"), F.when(F.col("slab") % 11 == 0, F.col("slab")).otherwise(F.col("id") % 5 + 1_000_000).alias("slab"), F.lit(1).alias("bytes"))
    return held.drop("lost"), held.where("lost").select("ref"), written, S.slabs(spark, sf).where("slab % 7 = 0")


@query(f"WITH {_HELD} SELECT DISTINCT slab FROM held WHERE slab NOT IN (SELECT slab FROM written) AND slab NOT IN (SELECT slab FROM owed) AND slab NOT IN (SELECT slab FROM held WHERE gone)")
def repack_release(spark, sf):
    return storage.repack_release(*_repack(spark, sf))


@query(f"WITH {_HELD}, w AS (SELECT DISTINCT slab FROM written), k AS (SELECT slab FROM w UNION SELECT slab FROM held WHERE gone) SELECT count(*) FILTER (WHERE NOT gone) AS moved, count(*) FILTER (WHERE gone) AS gone, count(DISTINCT slab) AS before, (SELECT count(*) FROM k) AS after, count(DISTINCT slab) + (SELECT count(*) FROM w) AS peak FROM held")
def repack_report(spark, sf):
    return storage.repack_report(*_repack(spark, sf)[:3])


@query(f"WITH {_HELD} SELECT held.id, 'n' || held.ref AS \"to\", w.slab FROM held JOIN written w ON w.cid = held.id")
def repack_moves(spark, sf):
    return storage.repack_moves(*_repack(spark, sf)[:3]).select("id", "to", "slab")


@query(f"WITH {_HELD} SELECT count(DISTINCT slab) AS slabs, count(DISTINCT slab) FILTER (WHERE slab % 3 = 0) AS foreign, count(*) FILTER (WHERE slab % 3 = 0) > 0 AS refused FROM held")
def repack_refusal(spark, sf):
    ledger = S.slabs(spark, sf).withColumn("origin", F.when(F.col("slab") % 3 == 0, "hydrated").otherwise("pinned"))
    return storage.repack_refusal(_repack(spark, sf)[0], ledger)


def _claimed_queue(spark, sf):
    """The queue with the claimants of what is claimed."""
    return S.queue(spark, sf).withColumn("claimed_by", F.when(F.col("claimed_at").isNotNull(), F.concat(F.lit("c"), "key")))


@query(f"WITH {S.QUEUE} SELECT seq, record_id, CASE WHEN record_id NOT IN ('r7', 'r8') THEN claimed_at END AS claimed_at, CASE WHEN record_id NOT IN ('r7', 'r8') AND claimed_at IS NOT NULL THEN 'c' || key END AS claimed_by FROM queue")
def queue_release(spark, sf):
    q = _claimed_queue(spark, sf)
    return storage.release_claims(q, q.where("record_id in ('r7', 'r8')")).select("seq", "record_id", "claimed_at", "claimed_by")


@query(f"WITH {S.QUEUE} SELECT seq, record_id FROM queue WHERE record_id NOT IN ('r7', 'r8')")
def queue_drop(spark, sf):
    q = S.queue(spark, sf)
    return storage.drop_queued(q, q.where("record_id in ('r7', 'r8')")).select("seq", "record_id")


@query(f"WITH {S.QUEUE}, c AS (SELECT seq FROM queue WHERE claimed_at IS NULL OR claimed_at < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 600 SECOND ORDER BY seq LIMIT 50) SELECT seq, CASE WHEN seq IN (SELECT seq FROM c) THEN TIMESTAMP '2024-01-15 00:00:00' ELSE claimed_at END AS claimed_at, CASE WHEN seq IN (SELECT seq FROM c) THEN 'me' WHEN claimed_at IS NOT NULL THEN 'c' || key END AS claimed_by FROM queue")
def queue_mark_claims(spark, sf):
    q = _claimed_queue(spark, sf)
    return storage.mark_claims(q, storage.claimable(q, "2024-01-15 00:00:00", limit=50), "2024-01-15 00:00:00", "me").select("seq", "claimed_at", "claimed_by")


@query(f"WITH {S.OBJ}, {_OWN} SELECT ref, count(*) FILTER (WHERE slab NOT IN (SELECT slab FROM own)) AS foreign FROM obj GROUP BY ref")
def slab_ownership(spark, sf):
    return storage.ownership(S.objects(spark, sf), S.slabs(spark, sf).where("slab % 3 <> 0"))


@query(f"WITH {S.LOG} SELECT id, (row_number() OVER (ORDER BY seq) - 1) // 64 AS batch FROM folded WHERE deleted AND object_ref NOT IN (SELECT object_ref FROM folded WHERE NOT deleted)")
def delete_batches(spark, sf):
    f = logs.latest(S.catalog(spark, sf), "id", "seq")
    return storage.delete_batches(logs.stale_objects(f).join(f.select("id", "seq"), "id")).select("id", "batch")


@query(f"WITH {S.QUEUE} SELECT seq, record_id, record_id IN (SELECT record_id FROM queue WHERE seq % 5 = 0) AS written FROM queue")
def flush_match(spark, sf):
    q = S.queue(spark, sf).withColumn("cid", F.col("record_id"))
    return storage.flush_match(q.where("seq % 5 = 0"), q).select("seq", "record_id", "written")


@query(f"WITH {S.LOG} SELECT DISTINCT slab_id FROM folded WHERE deleted AND slab_id NOT IN (SELECT slab_id FROM folded WHERE NOT deleted)")
def slabs_owed_a_deletion(spark, sf):
    f = logs.latest(S.catalog(spark, sf), "id", "seq")
    return logs.tombstones(f).select("slab_id").distinct().join(logs.live(f).select("slab_id"), "slab_id", "left_anti")


@query("SELECT count(*) FILTER (WHERE vec_id % 3 = 0) AS indexed, count(*) FILTER (WHERE vec_id % 3 <> 0) AS stale FROM embeddings")
def index_health(spark, sf):
    v = S.vectors(spark, sf).select(F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("model"), F.size("vector").alias("dim"))
    return logs.index_health(v, "m0", 64)


_SWEEP = [(0.0, 0.0), (0.002, 0.00067), (0.005, 0.002), (0.01, 0.0), (0.0, 0.005), (0.05, 0.02)]
_W = ", ".join(f"(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for a, b in _SWEEP)


@query(f"""WITH {_pool()}, w(tag_weight, type_weight) AS (VALUES {_W}),
s AS (SELECT id, tag_weight, type_weight, fused + tag_weight * ((CASE WHEN lang = 'en' THEN 1 ELSE 0 END + CASE WHEN source = 'src1' THEN 1 ELSE 0 END) / 2) + type_weight * CASE WHEN type IN ('fact', 'doc') THEN 1 ELSE 0 END AS score FROM said, w WHERE NOT superseded)
SELECT tag_weight, type_weight, CAST(place AS INTEGER) AS place, id FROM (SELECT *, row_number() OVER (PARTITION BY tag_weight, type_weight ORDER BY score DESC, id) AS place FROM s) WHERE place <= 10""")
def weight_sweep(spark, sf):
    return retrieval.weight_sweep(*_parts(spark, sf), _request(spark, sf), _SWEEP)


_LEX = [0.0, 0.01, 0.02, 0.03, 0.035, 0.04, 0.1, 1.0]


@query(f"""WITH {S.REC}, {DENSE}, {BM25}, wt(weight) AS (VALUES {", ".join(f"(CAST({x} AS DOUBLE))" for x in _LEX)}),
d AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS dr FROM dense ORDER BY dr LIMIT 100), l AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS lr FROM lex ORDER BY lr LIMIT 100),
s AS (SELECT weight, coalesce(d.id, l.id) AS id, coalesce(CAST(1.0 AS DOUBLE) / (60 + dr), 0.0) + coalesce(weight / (60 + lr), 0.0) AS fused FROM d FULL JOIN l ON d.id = l.id, wt WHERE dr IS NOT NULL OR weight > 0)
SELECT weight, CAST(place AS INTEGER) AS place, id FROM (SELECT *, row_number() OVER (PARTITION BY weight ORDER BY fused DESC, id) AS place FROM s) WHERE place <= 10""")
def lexical_sweep(spark, sf):
    v, t, _ = _parts(spark, sf)
    return retrieval.lexical_sweep(v, t, _request(spark, sf), _LEX)


@query(f"WITH {_pool(repr('session'))} SELECT id, round(similarity, 6) AS similarity FROM said WHERE NOT superseded AND kind = 'session' ORDER BY fused + {_BOOST} DESC, id LIMIT 1")
def topic_session(spark, sf):
    req = _request(spark, sf, kinds=["session"])
    req.limit = 1
    return retrieval.recall(*_parts(spark, sf), req).select("id", "similarity")


@query("SELECT event_id AS seq, 'u' || user_id AS id, event_id % 9 = 4 AS bad FROM events WHERE event_id % 9 <> 4 UNION ALL SELECT event_id, NULL, true FROM events WHERE event_id % 9 = 4")
def catalog_line_decode(spark, sf):
    e = S.table(spark, sf, "events")
    line = F.base64(F.to_json(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.col("event_id").alias("version"))).cast("binary"))
    return formats.read_catalog(e.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 9 == 4, "!!").otherwise(line).alias("value"))).select("seq", "id", "bad")


@query("SELECT CAST(user_id AS VARCHAR) AS ref, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS pos, md5(CAST(event_id AS VARCHAR)) AS id, props AS body FROM events")
def frames_round_trip(spark, sf):
    e = S.table(spark, sf, "events")
    r = e.select(F.col("user_id").cast("string").alias("ref"), F.col("event_id").alias("pos"), F.lit("memory").alias("kind"), F.md5(F.col("event_id").cast("string")).alias("id"), F.col("props").cast("binary").alias("sealed"))
    return formats.split_frames(formats.pack_frames(r)).select("ref", "pos", "id", F.col("sealed").cast("string").alias("body"))


@query("SELECT doc_id AS id, lower(trim(lang)) AS tag, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS project, source || chr(10) || chr(10) || lang AS index_text, sha256(source) AS body_cid, to_base64(unhex(substr(sha256(source), 1, 12))) AS stamp, greatest(n_chars - 500, 0) AS freed FROM documents")
def scalar_functions_2(spark, sf):
    d = S.table(spark, sf, "documents")
    repo = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("")
    return d.select(
        F.col("doc_id").alias("id"), T.normalize_tag(F.concat(F.lit("\t"), F.upper("lang"), F.lit(" "))).alias("tag"), T.project_key(repo, F.col("lang")).alias("project"), T.index_text(F.col("source"), F.col("lang")).alias("index_text"),
        T.content_id(F.col("source")).alias("body_cid"), F.translate(T.query_stamp(F.col("source")), "-_", "+/").alias("stamp"), T.saturating_minus(F.col("n_chars"), F.lit(500)).alias("freed"),
    )


@query(f"WITH {S.QUEUE} SELECT seq, record_id FROM queue WHERE record_id NOT IN ('r7', 'r8') OR (SELECT bool_or(claimed_at IS NOT NULL AND claimed_at >= TIMESTAMP '2024-01-15' - INTERVAL 600 SECOND) FROM queue WHERE record_id IN ('r7', 'r8'))")
def queue_withdraw_all(spark, sf):
    q = S.queue(spark, sf)
    return storage.withdraw_all(q, q.where("record_id in ('r7', 'r8')"), "2024-01-15 00:00:00").select("seq", "record_id")


@query(f"""WITH {S.REC}, c AS (SELECT count(*) AS records, count(*) FILTER (WHERE kind = 'memory') AS memories, count(*) FILTER (WHERE kind = 'session') AS sessions FROM rec),
v AS (SELECT tag AS top_tag FROM tag GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 1) SELECT *, (SELECT count(*) FROM embeddings) AS indexed FROM c, v""")
def vault_summary(spark, sf):
    r = S.records(spark, sf)
    c = r.agg(F.count("*").alias("records"), F.count_if(F.col("kind") == "memory").alias("memories"), F.count_if(F.col("kind") == "session").alias("sessions"))
    v = listing.tag_vocabulary(listing.tag_rows(r), 1).select(F.col("tag").alias("top_tag"))
    return c.crossJoin(v).crossJoin(S.vectors(spark, sf).agg(F.count("*").alias("indexed")))  # one row each


@query(f"WITH {S.SESS} SELECT id, title, updated_at FROM sess ORDER BY updated_at DESC NULLS LAST, id LIMIT 15")
def recent_conversations(spark, sf):
    return listing.recent_conversations(S.sessions(spark, sf))


@query("SELECT slab_id, pinned_at FROM (SELECT 's' || (event_id % 40) AS slab_id, min(event_id) AS pinned_at FROM events GROUP BY 1) ORDER BY pinned_at, slab_id")
def tracked_slabs(spark, sf):
    return storage.tracked_slabs(S.catalog(spark, sf).groupBy("slab_id").agg(F.min("seq").alias("pinned_at")))


@query("SELECT user_id AS id, CASE WHEN user_id % 2 = 0 THEN 'b' ELSE 'a,c' END AS left_over FROM (SELECT DISTINCT user_id FROM events)")
def owed_minus_written(spark, sf):
    e = S.table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()
    owed = e.withColumn("owed", F.when(F.col("id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("c")))).withColumn("written", F.when(F.col("id") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"))))
    return storage.settle(owed).select("id", F.array_join("left", ",").alias("left_over"))


@query(f"""WITH {S.SESS} SELECT id, CASE WHEN id % 13 = 1 THEN 'unknown schema' WHEN id % 13 = 2 THEN 'missing schema version' WHEN id % 13 = 3 THEN 'version below 1' WHEN id % 13 = 4 THEN 'empty title' WHEN id % 13 = 5 THEN 'empty tag'
 WHEN id % 13 = 6 THEN 'tag too long' WHEN id % 13 = 7 THEN 'too many tags' WHEN kind = 'subagent' AND id % 2 = 0 THEN 'subagent without parent' WHEN id % 13 = 8 THEN 'chunk without id' WHEN id % 5 = 2 THEN 'chunks out of sequence' END AS problem FROM sess""")
def session_validation(spark, sf):
    n = F.col("id") % 13
    s = S.sessions(spark, sf).withColumns({
        "schema": F.when(n == 1, "other").otherwise(C.MESSAGE_SCHEMA), "schema_version": F.when(n == 2, 0).otherwise(1), "version": F.when(n == 3, 0).otherwise(2), "title": F.when(n == 4, " \n").otherwise("t"), "summary": F.lit(""),
        "tags": F.when(n == 5, F.array(F.lit("a"), F.lit(" "))).when(n == 6, F.array(F.repeat(F.lit("é"), 33))).when(n == 7, F.array_repeat(F.lit("a"), 33)).otherwise(F.array()), "parent": F.when(~((F.col("kind") == "subagent") & (F.col("id") % 2 == 0)), F.coalesce("parent", F.lit(0).cast("long"))),
        "chunks": F.array(*[F.struct(F.when((n == 8) & F.lit(i == 1), "").otherwise("c").alias("id"), F.when(F.col("id") % 5 == 2, 2 * i).otherwise(i).alias("seq")) for i in range(3)]),
    })
    return listing.session_problem(s).select("id", "problem")


@query("""WITH d AS (SELECT *, epoch_ms(1704067200123 + doc_id * 1000) AS ts, trim(regexp_replace(substr(text, 1, 40), '\\s+', ' ', 'g')) AS flat FROM documents WHERE text IS NOT NULL)
SELECT doc_id AS id, lower(lang) || ',' || lower(source) AS tags, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS written, 1704067200123 + doc_id * 1000 AS millis, doc_id % 2 = 0 AS valid, CASE WHEN doc_id % 3 <> 0 THEN source END AS opened,
 CASE WHEN length(flat) <= 20 THEN flat WHEN strpos(reverse(substr(flat, 11, 10)), ' ') > 0 THEN trim(substr(flat, 1, 20 - strpos(reverse(substr(flat, 11, 10)), ' '))) || '…' ELSE trim(substr(flat, 1, 19)) || '…' END AS clipped, CAST(least(greatest(doc_id / 10, 1), 60) AS DOUBLE) AS tick, source || chr(10) || lang || chr(10) || lang || chr(10) || source AS lexical FROM d""")
def scalar_functions_3(spark, sf):
    d = S.table(spark, sf, "documents").where("text is not null")
    id_, lang, source = F.col("doc_id"), F.col("lang"), F.col("source")
    ms = id_ * 1000 + 1_704_067_200_123
    at = T.format_time(F.timestamp_millis(ms))
    sealed = T.seal(source.cast("binary"), "0123456789abcdef")
    opened = F.when(id_ % 3 != 0, T.open_sealed(sealed, "0123456789abcdef")).otherwise(T.open_sealed(sealed, "fedcba9876543210"))
    return d.select(
        id_.alias("id"), F.array_join(T.normalize_tags(F.array(F.upper(lang), F.concat(F.lit(" "), source), F.lit(" "), lang)), ",").alias("tags"), at.alias("written"), F.unix_millis(T.parse_time(at)).alias("millis"),
        T.valid_id(F.when(id_ % 2 == 0, F.md5("text")).otherwise(F.substring(F.md5("text"), 2, 40))).alias("valid"), opened.cast("string").alias("opened"), T.clip_title(F.substring("text", 1, 40), 20).alias("clipped"),
        T.flush_tick(id_.cast("double")).alias("tick"), T.lexical_text(source, lang, F.array(lang), F.array(source)).alias("lexical"),
    )


@query("""SELECT event_id AS id, CASE WHEN event_id % 5 > 0 THEN '' WHEN event_id % 3 > 0 AND user_id % 2 = 0 THEN 'the filters select nothing' WHEN event_id % 3 > 0 AND user_id % 7 > 0 THEN 'nothing is stored here, and not all that the catalog names has been restored'
  WHEN event_id % 3 > 0 THEN 'nothing is stored yet' WHEN user_id % 5 > 0 AND event_id % 11 > 0 THEN 'all that is left past the cursor has been replaced' ELSE 'the listing ends here' END AS browse,
 CASE WHEN event_id % 5 > 0 AND user_id % 3 > 0 THEN 'the scope removed candidates: ' || user_id % 3 || CASE WHEN user_id % 7 > 0 THEN '; not restored: ' || user_id % 7 ELSE '' END
  WHEN event_id % 5 > 0 THEN CASE WHEN user_id % 7 > 0 THEN 'not restored: ' || user_id % 7 ELSE '' END
  WHEN event_id % 7 > 0 THEN 'nothing ranks past this cursor' || CASE WHEN user_id % 7 > 0 THEN '; not restored: ' || user_id % 7 ELSE '' END
  WHEN user_id % 3 > 0 THEN 'nothing in scope matched; outside it: ' || user_id % 3 || CASE WHEN user_id % 7 > 0 THEN '; not restored: ' || user_id % 7 ELSE '' END
  WHEN user_id % 2 > 0 AND user_id % 5 > 0 THEN 'nothing current matched; replaced: ' || user_id % 5 || CASE WHEN user_id % 7 > 0 THEN '; not restored: ' || user_id % 7 ELSE '' END
  WHEN user_id % 7 > 0 THEN 'nothing to search here; not restored: ' || user_id % 7 ELSE 'nothing to search' END AS recalled,
 CASE WHEN user_id % 4 > 0 AND event_id % 3 = 0 THEN (user_id % 4) || ' near duplicates; every tag is common' WHEN user_id % 4 > 0 THEN (user_id % 4) || ' near duplicates' WHEN event_id % 3 = 0 THEN 'every tag is common' ELSE '' END AS advice,
 CASE WHEN event_id % 2 = 0 THEN 'a..b' ELSE 'a' END AS span FROM events""")
def texts_of_answers(spark, sf):
    e = S.table(spark, sf, "events")
    id_, user = F.col("event_id"), F.col("user_id")
    span = T.parse_span(F.when(id_ % 2 == 0, " a .. b").otherwise("a.."))
    return e.select(
        id_.alias("id"), listing.browse_hint(id_ % 5, user % 2 == 0, id_ % 3 == 0, user % 5, id_ % 11 == 0, user % 7).alias("browse"), retrieval.recall_hint(id_ % 5, id_ % 7, user % 3, user % 2, user % 5, user % 7).alias("recalled"),
        listing.write_advice(user % 4, F.lit(2), F.when(id_ % 3 == 0, 2).otherwise(3)).alias("advice"), T.format_span(span["first"], span["last"]).alias("span"),
    )


@query(f"WITH {S.TURNS}, b AS (SELECT session, pos, CASE WHEN pos % 2 = 0 THEN 'result' ELSE 'call' END AS x FROM turns) SELECT session, pos, 0 AS at, '0' AS path, 'text' AS type FROM b UNION ALL SELECT session, pos, 1, '1', 'tool_' || x FROM b UNION ALL SELECT session, pos, 2, '1.0', 'text' FROM b WHERE pos % 2 = 0")
def nested_parts(spark, sf):
    t = S.turns(spark, sf)
    flat = F.when(F.col("pos") % 2 == 0, F.lit('[{"type":"text","text":"a"},{"type":"tool_result","call_id":"c","content":[{"type":"text","text":"in"}]}]')).otherwise(F.lit('[{"type":"text","text":"a"},{"type":"tool_call","call_id":"c","name":"n"}]'))
    return transcripts.walk_parts(t.withColumn("parts", flat)).select("session", "pos", "at", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"), "type")
