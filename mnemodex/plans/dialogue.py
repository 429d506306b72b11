"""Registered queries over messages of nested parts and over agent logs; both are made of the conversations table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import heads, importer, listing
from ..operators import parts as P
from . import stand_ins as S
from .catalogue import query


def _json(text):
    """A string as JSON."""
    a = F.to_json(F.array(F.coalesce(text, F.lit(""))))
    return F.substring(a, F.lit(2), F.length(a) - 2)


def _say(*pieces):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces])


def _messages(spark, sf) -> DataFrame:
    """Turns whose parts are of five shapes, up to three deep."""
    t = S.turns(spark, sf)
    said, call, n = _json(F.col("text")), F.floor(F.col("pos") / 3), (F.col("session") + F.col("pos")) % 5
    parts = (
        F.when(n == 0, _say('[{"type":"text","text":', said, "}]")).when(n == 1, _say('[{"type":"toolCall","callId":"c', call, '","name":"n","input":{"z":1,"a":"q"}}]'))
        .when(n == 2, _say('[{"type":"toolResult","callId":"c', call, '","isError":true,"content":[{"type":"text","text":', said, '},{"type":"odd"}]}]'))
        .when(n == 3, '[{"type":"reasoning","text":""},{"type":"file","mediaType":"image/png","filename":"f"},{"type":"resourceLink","uri":"u"}]')
        .otherwise(_say('[{"type":"toolResult","callId":"x","content":[{"type":"toolResult","callId":"c', call, '","content":[{"type":"reasoning","text":', said, "}]}]}]"))
    )
    return t.withColumn("parts", parts)


_TALK = S.TURNS + ", m AS (SELECT *, (session + pos) % 5 AS n, 'c' || (pos // 3) AS call, coalesce(text, '') AS said FROM turns)"


@query(f"""WITH {_TALK} SELECT session, pos, '### ' || role || chr(10) || CASE n WHEN 0 THEN said || chr(10) WHEN 1 THEN '→ called n({{"z":1,"a":"q"}})' || chr(10) WHEN 2 THEN '← returned an error: ' || said || chr(10) || '[a odd part this build does not render]' || chr(10) || chr(10)
 WHEN 3 THEN '[image/png attachment f]' || chr(10) || '[see u]' || chr(10) ELSE '← returned ← returned ' || CASE WHEN said <> '' THEN '(thinking) ' || said || chr(10) ELSE '' END || chr(10) || chr(10) END || chr(10) AS text FROM m""")
def rendered_turns(spark, sf):
    return P.rendered_turns(_messages(spark, sf))


@query(rf"""WITH {_TALK}, u AS (SELECT session, arg_min(said, pos) AS t FROM m WHERE role = 'user' AND n IN (0, 2) AND trim(regexp_replace(said, '\s+', ' ', 'g')) <> '' GROUP BY session),
f AS (SELECT session, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM u)
SELECT s.session, CASE WHEN f.t IS NULL THEN 'Recovered session ' || lpad(CAST(s.session AS VARCHAR), 8, '0') WHEN length(f.t) <= 72 THEN f.t ELSE rtrim(substr(f.t, 1, 72)) || '…' END AS title FROM (SELECT DISTINCT session FROM m) s LEFT JOIN f USING (session)""")
def spoken_titles(spark, sf):
    return P.spoken_titles(_messages(spark, sf))


@query(f"""WITH {_TALK}, p AS (SELECT session, pos, id, 0 AS k, n = 1 AS is_call, call AS call_id, n = 2 AS error FROM m WHERE n IN (1, 2) UNION ALL SELECT session, pos, id, 0, false, 'x', false FROM m WHERE n = 4 UNION ALL SELECT session, pos, id, 1, false, call, false FROM m WHERE n = 4),
f AS (SELECT *, row_number() OVER (PARTITION BY session, call_id ORDER BY pos, k) AS i FROM p), r AS (SELECT session, call_id, id, error, row_number() OVER (PARTITION BY session, call_id ORDER BY pos DESC, k DESC) AS j FROM p WHERE NOT is_call)
SELECT f.session, f.call_id, f.pos AS met, CASE WHEN is_call THEN 'n' END AS name, CASE WHEN is_call THEN '{{"z":1,"a":"q"}}' END AS input, CASE WHEN is_call THEN f.id END AS call_message, r.id AS result_message, r.error AS is_error, r.id IS NOT NULL AS matched
FROM f LEFT JOIN r ON r.session = f.session AND r.call_id = f.call_id AND j = 1 WHERE i = 1""")
def tool_exchanges(spark, sf):
    return P.tool_exchanges(_messages(spark, sf)).withColumn("met", F.col("met.pos"))


@query(f"""WITH {S.TURNS} SELECT session, pos, CASE (session + pos) % 8 WHEN 0 THEN 'malformed part' WHEN 1 THEN 'malformed part' WHEN 2 THEN 'part without type' WHEN 3 THEN 'tool part without call id' WHEN 4 THEN 'malformed part' WHEN 5 THEN 'no parts' END AS problem FROM turns""")
def malformed_parts(spark, sf):
    n = (F.col("session") + F.col("pos")) % 8
    deep = '[{"type":"toolResult","callId":"a","content":[{"type":"toolResult","callId":"b","content":[{"type":"toolCall","callId":" "}]}]}]'
    parts = F.when(n == 0, "{broken").when(n == 1, '["a"]').when(n == 2, '[{"text":"x"}]').when(n == 3, deep).when(n == 4, '[{"type":"toolResult","callId":"a","content":"x"}]').when(n == 5, "[]").otherwise('[{"type":"new","kept":1}]')
    return P.message_problems(S.turns(spark, sf).withColumns({"parts": parts, "role": F.lit("user")})).select("session", "pos", "problem")


def _log(spark, sf) -> DataFrame:
    """The conversations as an agent's log: whole lines, cut ones, other kinds, and lines that the message schema cannot hold or not exactly."""
    t = S.turns(spark, sf)
    said, n = _json(F.col("text")), (F.col("session") * 3 + F.col("pos")) % 12
    content = (
        F.when(n == 2, _say('[{"type":"thinking","thinking":', said, "}]")).when(n == 5, '[{"type":"tool_use","id":"","name":"n","input":{}}]').when(n == 6, said)
        .when(n == 7, _say('[{"type":"tool_result","tool_use_id":"c","is_error":true,"content":[{"type":"text","text":', said, ',"more":{"b":1,"a":[2.5]}},{"type":"new","x":null}]}]'))
        .otherwise(_say('[{"type":"text","text":', said, '},{"type":"tool_use","id":"c","name":"n","input":{"q":', said, "}}]"))
    )
    role = F.when(n == 8, "boss").otherwise(F.when(F.col("role") == "assistant", "assistant").otherwise("user"))
    message = _say('{"role":"', role, '"', F.when(n == 3, "").otherwise(_say(',"content":', content)), ',"usage":{"output_tokens":', F.col("pos"), "}}")
    value = _say(
        '{"type":"', F.when(n == 1, "system").otherwise("user"), '","uuid":"', F.col("id"), '","parentUuid":', F.when(F.col("pos") == 0, "null").otherwise(_say('"', F.col("session"), ":", F.col("pos") - 1, '"')),
        ',"timestamp":"2026-01-01T00:00:00', F.when(n == 4, "Z").otherwise(".000Z"), '","sessionId":"', F.col("session"), '","cwd":"/w","message":', message, "}",
    )
    return t.select(F.lit("log").alias("file"), (F.col("session") * 100_000 + F.col("pos")).alias("line"), F.when(n == 0, F.substring(value, 1, 30)).otherwise(value).alias("value"))


@query(f"""WITH {S.TURNS}, x AS (SELECT (session * 3 + pos) % 12 AS n FROM turns)
SELECT CASE WHEN n IN (0, 3, 5, 8) THEN 'refused' WHEN n IN (2, 4) THEN 'diverged' WHEN n = 1 THEN 'other' ELSE 'rebuilt' END AS outcome,
 CASE n WHEN 0 THEN 'the line does not parse' WHEN 3 THEN 'message has no content' WHEN 5 THEN 'tool part without call id' WHEN 8 THEN 'unknown role' WHEN 2 THEN 'message.content[thinking].signature added' WHEN 4 THEN 'timestamp' WHEN 1 THEN 'system' ELSE '' END AS detail, count(*) AS n FROM x GROUP BY 1, 2""")
def import_census(spark, sf):
    return importer.census(importer.outcomes(importer.to_messages(_log(spark, sf))))


@query(f"""WITH {S.TURNS}, x AS (SELECT (session * 3 + pos) % 12 AS n FROM turns), p AS (SELECT unnest(CASE WHEN n IN (0, 1, 3) THEN [] WHEN n = 2 THEN ['thinking'] WHEN n = 5 THEN ['tool_use'] WHEN n = 6 THEN ['<string>'] WHEN n = 7 THEN ['tool_result', 'text', 'new'] ELSE ['text', 'tool_use'] END) AS type FROM x)
SELECT type, count(*) AS n FROM p GROUP BY type""")
def import_parts(spark, sf):
    return importer.part_census(_log(spark, sf))


def _graph(spark, sf) -> DataFrame:
    """Lines whose parents fork, are cut off, lead round in a circle, or stand in a side chain; some lines come twice."""
    t, pos, s = S.turns(spark, sf), F.col("pos"), F.col("session").cast("string")
    up = F.when(pos == 0, None).when(pos % 16 == 12, pos + 1).when(pos % 9 == 8, -1).when(pos % 7 == 4, pos - 2).otherwise(pos - 1)
    g = t.select(s.alias("session"), "id", _say(s, ":", up).alias("parent"), pos.alias("line"), (pos % 5 == 3).alias("sidechain"))
    return g.unionByName(g.where("line % 6 = 1").withColumn("line", F.col("line") + 1000))


_CHAIN = f"""{S.TURNS}, g AS (SELECT session, pos, id, CASE WHEN pos = 0 THEN NULL WHEN pos % 16 = 12 THEN pos + 1 WHEN pos % 9 = 8 THEN -1 WHEN pos % 7 = 4 THEN pos - 2 ELSE pos - 1 END AS up, pos % 5 = 3 AS side FROM turns),
e AS (SELECT g.*, p.pos AS par FROM g LEFT JOIN g p ON p.session = g.session AND p.pos = g.up),
r(session, pos, root, depth) AS (SELECT session, pos, id, 0 FROM e WHERE par IS NULL UNION ALL SELECT e.session, e.pos, r.root, r.depth + 1 FROM e JOIN r ON r.session = e.session AND r.pos = e.par),
w(session, pos) AS (SELECT session, max(pos) FROM e WHERE NOT side GROUP BY session UNION SELECT e.session, e.par FROM e JOIN w USING (session, pos) WHERE e.par IS NOT NULL)"""


@query(f"""WITH RECURSIVE {_CHAIN} SELECT CAST(e.session AS VARCHAR) AS session, id, e.pos AS line, root, CAST(depth AS BIGINT) AS depth, CASE WHEN side THEN 'side' WHEN w.pos IS NOT NULL THEN 'main' ELSE 'fork' END AS branch, CASE WHEN root IS NULL THEN 'circle' WHEN up IS NOT NULL AND par IS NULL THEN 'cut' END AS problem
FROM e LEFT JOIN r ON r.session = e.session AND r.pos = e.pos LEFT JOIN w ON w.session = e.session AND w.pos = e.pos UNION ALL SELECT CAST(session AS VARCHAR), id, pos + 1000, NULL, NULL, NULL, 'repeated' FROM turns WHERE pos % 6 = 1""")
def import_chains(spark, sf):
    return importer.chains(_graph(spark, sf))


@query(f"""WITH RECURSIVE {_CHAIN} SELECT CAST(session AS VARCHAR) AS session, CAST(depth AS BIGINT) AS pos, id FROM w JOIN e USING (session, pos) JOIN r USING (session, pos) WHERE NOT side""")
def import_turns(spark, sf):
    g = _graph(spark, sf)
    m = g.withColumns({"refused": F.lit(None).cast("string"), "role": F.lit("user"), "parts": F.lit("[]"), "created": F.lit(None).cast("timestamp")})
    return importer.imported_turns(m, importer.chains(g)).select("session", "pos", "id")


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 7 = 1 THEN 'unknown kind' WHEN doc_id % 7 = 2 THEN 'unknown schema' WHEN doc_id % 7 = 3 THEN 'missing schema version' WHEN doc_id % 7 = 4 THEN 'no session' WHEN doc_id % 7 = 5 THEN 'negative sequence' WHEN doc_id % 7 = 6 THEN 'no messages' END AS problem FROM documents""")
def chunk_validation(spark, sf):
    from ..functions import constants as C

    d, n = S.table(spark, sf, "documents"), F.col("doc_id") % 7
    chunks = d.select(
        F.col("doc_id").alias("id"), F.when(n == 1, "memory").otherwise("chunk").alias("kind"), F.when(n == 2, "x").otherwise(C.MESSAGE_SCHEMA).alias("schema"), F.when(n == 3, 0).otherwise(1).alias("schema_version"),
        F.when(n == 4, "").otherwise("s").alias("session"), F.when(n == 5, -1).otherwise(0).alias("seq"), F.when(n == 6, 0).otherwise(3).alias("messages"),
    )
    return listing.chunk_problem(chunks).select("id", "problem")


def _transcript(spark, sf):
    """Messages of models, tokens and memories in context, their chunks, and the memories that name a session."""
    n, s = F.col("session") * 7 + F.col("pos"), F.col("session")
    m = _messages(spark, sf).withColumns({
        "model": F.when(s % 4 > 0, F.when(n % 3 == 0, "").otherwise(_say("m", n % 4))), "tokens_in": F.when(s % 3 > 0, n % 50), "tokens_out": F.when(s % 3 > 0, n % 20), "created": F.when(s % 5 > 0, F.col("created")),
        "memory_refs": F.when((s % 2 == 0) & (F.col("pos") % 4 == 1), F.array(F.col("pos") % 6, F.lit(1000).cast("long"))).otherwise(F.array().cast("array<long>")),
    })
    chunks = S.turns(spark, sf).groupBy("session", F.floor(F.col("pos") / 4).alias("seq")).agg(F.sum("bytes").alias("bytes"))
    back = S.records(spark, sf).where("id % 6 <> 2").select((F.col("id") % 97).alias("session"), "id")
    return m, chunks, back


_HEAD = _TALK + r""", x AS (SELECT session, pos, id, role, CASE WHEN session % 4 > 0 AND (session * 7 + pos) % 3 > 0 THEN 'm' || (session * 7 + pos) % 4 END AS model, CASE WHEN session % 3 > 0 THEN (session * 7 + pos) % 50 ELSE 0 END AS ti, CASE WHEN session % 3 > 0 THEN (session * 7 + pos) % 20 ELSE 0 END AS tout,
  CASE WHEN session % 5 > 0 THEN created END AS created, CASE WHEN session % 2 = 0 AND pos % 4 = 1 THEN [pos % 6, 1000] ELSE [] END AS refs FROM m),
a AS (SELECT session, count(*) AS messages, CAST(sum(ti) AS BIGINT) AS tokens_in, CAST(sum(tout) AS BIGINT) AS tokens_out, arg_min(created, pos) FILTER (WHERE created IS NOT NULL) AS created, arg_max(created, pos) FILTER (WHERE created IS NOT NULL) AS updated, arg_max(id, pos) AS head_message FROM x GROUP BY session),
mo AS (SELECT session, string_agg(model, ',' ORDER BY met) AS models FROM (SELECT session, model, min(pos) AS met FROM x WHERE model IS NOT NULL GROUP BY ALL) GROUP BY session),
ch AS (SELECT session, count(*) AS chunks, CAST(sum(b) AS BIGINT) AS bytes FROM (SELECT session, pos // 4 AS q, sum(bytes) AS b FROM turns GROUP BY ALL) GROUP BY session),
li AS (SELECT session, count(DISTINCT id) AS memories FROM (SELECT doc_id % 97 AS session, doc_id AS id FROM documents WHERE doc_id % 6 <> 2 UNION ALL SELECT session, unnest(refs) FROM x) GROUP BY session),
u AS (SELECT session, arg_min(said, pos) AS t FROM m WHERE role = 'user' AND n IN (0, 2) AND trim(regexp_replace(said, '\s+', ' ', 'g')) <> '' GROUP BY session),
h AS (SELECT a.*, coalesce(mo.models, '') AS models, chunks, bytes, coalesce(memories, 0) AS memories, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM a JOIN ch USING (session) LEFT JOIN mo USING (session) LEFT JOIN li USING (session) LEFT JOIN u USING (session))"""


@query(f"""WITH {_HEAD} SELECT session, messages, chunks, bytes, tokens_in, tokens_out, created, updated, models, head_message, memories,
 CASE WHEN t IS NULL THEN 'Recovered session ' || lpad(CAST(session AS VARCHAR), 8, '0') WHEN length(t) <= 72 THEN t ELSE rtrim(substr(t, 1, 72)) || '…' END AS title FROM h""")
def head_rebuild(spark, sf):
    h = heads.rebuild_heads(*_transcript(spark, sf))
    return h.drop("origins", "kind", "version").withColumn("models", F.array_join("models", ","))


@query(f"""WITH {_HEAD}, o AS (SELECT session, unnest([
 {{'f': 'id', 'o': 'chunk'}}, {{'f': 'schema', 'o': 'chunk'}}, {{'f': 'schemaVersion', 'o': 'chunk'}}, {{'f': 'version', 'o': 'synthesised'}}, {{'f': 'title', 'o': 'synthesised'}}, {{'f': 'summary', 'o': 'lost'}}, {{'f': 'tags', 'o': 'lost'}}, {{'f': 'project', 'o': 'lost'}},
 {{'f': 'created', 'o': CASE WHEN created IS NULL THEN 'lost' ELSE 'observed' END}}, {{'f': 'updated', 'o': CASE WHEN created IS NULL THEN 'lost' ELSE 'observed' END}}, {{'f': 'archived', 'o': 'lost'}}, {{'f': 'agent', 'o': 'lost'}}, {{'f': 'agentRef', 'o': 'lost'}},
 {{'f': 'models', 'o': CASE WHEN models = '' THEN 'lost' ELSE 'observed' END}}, {{'f': 'counts.messages', 'o': 'derived'}}, {{'f': 'counts.chunks', 'o': 'derived'}}, {{'f': 'counts.bytes', 'o': 'derived'}}, {{'f': 'counts.tokens', 'o': CASE WHEN tokens_in > 0 OR tokens_out > 0 THEN 'observed' ELSE 'lost' END}},
 {{'f': 'counts.durationMs', 'o': 'lost'}}, {{'f': 'kind', 'o': 'synthesised'}}, {{'f': 'lineage', 'o': 'lost'}}, {{'f': 'headMessage', 'o': 'derived'}}, {{'f': 'preservedTail', 'o': 'lost'}}, {{'f': 'chunks', 'o': 'derived'}},
 {{'f': 'links.memories', 'o': CASE WHEN memories > 0 THEN 'reverse' ELSE 'lost' END}}, {{'f': 'embedding', 'o': 'lost'}}]) AS x FROM h) SELECT session, x.f AS field, x.o AS origin FROM o""")
def head_origins(spark, sf):
    return heads.rebuild_heads(*_transcript(spark, sf)).select("session", F.explode("origins").alias("field", "origin"))


@query(f"""WITH {_HEAD}, o AS (SELECT 'title' AS field, 1 AS k, 'synthesised' AS origin UNION ALL SELECT 'created', CASE WHEN count(*) FILTER (WHERE created IS NULL) > 0 THEN 1 ELSE 0 END, CASE WHEN count(*) FILTER (WHERE created IS NULL) > 0 THEN 'lost' ELSE 'observed' END FROM h
 UNION ALL SELECT 'links.memories', 0, CASE WHEN count(*) FILTER (WHERE memories = 0) > 0 THEN 'lost' ELSE 'reverse' END FROM h UNION ALL SELECT 'counts.bytes', 0, 'derived') SELECT field, origin FROM o""")
def head_origins_worst(spark, sf):
    return heads.worst_origins(heads.rebuild_heads(*_transcript(spark, sf))).where("field in ('title', 'created', 'links.memories', 'counts.bytes')")
