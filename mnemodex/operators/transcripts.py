"""Transcripts: chunk packing, paging, facts, head rebuild, tool calls, spans.

Turns are a frame (session, pos, id, role, text, created); chunks (session, seq, messages array<struct<id, role, text, created>>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from .parts import message_problems, walk_parts  # noqa: F401  nested parts, beside the other transcript operators


def message_bytes(message: Column) -> Column:
    return F.octet_length(F.to_json(message))


def chunk_numbers(turns: DataFrame, size: str = "bytes", target: int = C.CHUNK_TARGET_BYTES) -> DataFrame:
    """turns(session, pos, `size`) with `chunk`: a new one starts when a non-empty one would exceed the target.

    The greedy reset needs state, which is a number per session: sorted partitions are streamed with it.
    """
    import pyarrow as pa

    kinds = dict(turns.dtypes)

    def run(batches):
        last, chunk, held = object(), 0, 0
        for batch in batches:
            out = []
            for s, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if s != last:
                    last, chunk, held = s, 0, 0
                elif held + n > target:
                    chunk, held = chunk + 1, 0
                held += n
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.int64())], names=["session", "pos", size, "chunk"])

    rows = turns.select("session", "pos", size).repartition("session").sortWithinPartitions("session", "pos")
    return rows.mapInArrow(run, f"session {kinds['session']}, pos {kinds['pos']}, {size} {kinds[size]}, chunk long")


def chunk_refs(turns: DataFrame) -> DataFrame:
    """(session, seq, first, last, n, bytes) of turns(session, pos, id, bytes, chunk)."""
    return turns.groupBy("session", F.col("chunk").alias("seq")).agg(F.min_by("id", "pos").alias("first"), F.max_by("id", "pos").alias("last"), F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def flatten(chunks: DataFrame) -> DataFrame:
    """Turns of chunks, by chunk and place in it."""
    return chunks.select("session", "seq", F.posexplode("messages").alias("at", "m")).select("session", "seq", "at", "m.*")


def page(turns: DataFrame, session, start=None, limit: int = 0) -> DataFrame:
    """A session's turns from message `start` (inclusive) with `more` and the message that the next page starts from (`next`,
    null on the last one); limit 0 takes all. An unknown start is an error."""
    t = turns.where(F.col("session") == session)
    if start is not None:
        absent = F.raise_error(F.lit(f"session {session} holds no message {start}")).cast("long")
        first = t.where(F.col("id") == start).agg(F.coalesce(F.min("pos").cast("long"), absent).alias("p"))
        t = t.crossJoin(F.broadcast(first)).where("pos >= p").drop("p")  # one row
    t = t.orderBy("pos")
    if not limit:
        return t.withColumns({"more": F.lit(False), "next": F.lit(None).cast("string")})
    ahead = t.limit(limit + 1).agg(F.count("*").alias("n"), F.max_by("id", "pos").alias("last_"))
    return t.limit(limit).crossJoin(ahead).withColumns({"more": F.col("n") > limit, "next": F.when(F.col("n") > limit, F.col("last_"))}).drop("n", "last_")  # one row


def start_chunk(refs: DataFrame, message) -> DataFrame:
    """(session, seq): the first chunk whose first or last message it is, else 0; only statistics are read."""
    hit = (F.col("first") == message) | (F.col("last") == message)
    return refs.groupBy("session").agg(F.coalesce(F.min(F.when(hit, F.col("seq"))), F.lit(0)).alias("seq"))


def tail(turns: DataFrame, n: int = C.RESUME_TURNS) -> DataFrame:
    """The last turns of each session, by a top-n per key that Spark applies before its shuffle."""
    n = min(n or C.RESUME_TURNS, C.RESUME_MAX)
    w = Window.partitionBy("session").orderBy(F.desc("pos"))
    return turns.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def facts(turns: DataFrame) -> DataFrame:
    """Per session: messages, bytes, and the first and last dated turns in transcript order (not by time)."""
    dated = F.when(F.col("created").isNotNull(), F.col("pos"))
    return turns.groupBy("session").agg(
        F.count("*").alias("messages"), F.sum(F.octet_length("text")).alias("bytes"),
        F.min_by("created", dated).alias("first_dated"), F.max_by("created", dated).alias("last_dated"), F.max_by("id", "pos").alias("head_message"),
    )


def sequence_gaps(chunks: DataFrame) -> DataFrame:
    """(session, gap): whether any chunk's number differs from its place. Numbers 0..n-1 without repeats are exactly those without a gap."""
    return chunks.groupBy("session").agg(((F.min("seq") != 0) | (F.max("seq") != F.count("*") - 1) | (F.count_distinct("seq") != F.count("*"))).alias("gap"))


def titles(turns: DataFrame) -> DataFrame:
    """The first user turn with text as a title, else a recovered-session one."""
    t = turns.groupBy("session").agg(F.min_by("text", "pos").alias("any"), F.min_by("text", F.when((F.col("role") == "user") & (F.trim("text") != ""), F.col("pos"))).alias("t"))
    return t.select("session", F.coalesce(T.truncate_title(F.col("t")), F.concat(F.lit("Recovered session "), F.substring(F.lpad(F.col("session").cast("string"), 8, "0"), 1, 8))).alias("title"))


def select_span(turns: DataFrame, spans: DataFrame) -> DataFrame:
    """Turns between spans(session, first, last), inclusive: an absent first gives none, an absent last one turn."""
    f = turns.select("session", F.col("id").alias("first"), F.col("pos").alias("a"))
    l = turns.select("session", F.col("id").alias("last"), F.col("pos").alias("b"))  # noqa: E741
    s = spans.join(f, ["session", "first"]).join(l, ["session", "last"], "left").select("session", "a", F.coalesce("b", "a").alias("b"))
    return turns.join(s, "session").where("pos >= a and pos <= b").drop("a", "b")


def tool_pairs(parts: DataFrame) -> DataFrame:
    """parts(session, pos, kind, call_id, name, text), pos in reading order: what was met of each call id, by first appearance.

    The first call gives the name, unless a result of that id came before it: then the call stays empty (an orphan). Of
    several results the last one counts. Nested parts come from `walk_parts`.
    """
    key = ["session", "call_id"]
    is_result = F.col("kind") == "tool_result"
    p = parts.where(F.col("kind").isin("tool_call", "tool_result"))
    a = p.groupBy(*key).agg(
        F.min("pos").alias("met"), F.min_by(F.struct("kind", "name"), "pos").alias("f"), F.max_by("text", F.when(is_result, F.col("pos"))).alias("result"), F.max(F.when(is_result, F.col("pos"))).alias("answered"),
    )
    call = F.col("f.kind") == "tool_call"
    return a.select(*key, "met", F.when(call, F.col("f.name")).alias("name"), F.when(call, F.col("met")).alias("called"), "result", "answered", (~call).alias("orphan"))


def backlinks(memories: DataFrame) -> DataFrame:
    """(session, n, first): memories by their source session. Lists stay out, as a session may have a third of all memories."""
    return memories.where("session is not null").groupBy("session").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def merge_head(old: DataFrame, new: DataFrame) -> DataFrame:
    """Heads(id, title, summary, models, messages, bytes): new values that are not empty win, models unite, counters add."""
    n = new.select("id", *[F.col(c).alias(f"n_{c}") for c in ("title", "summary", "models", "messages", "bytes")])
    pick = lambda c: F.coalesce(F.nullif(f"n_{c}", F.lit("")), c).alias(c)
    none = F.array().cast("array<string>")
    return old.join(n, "id", "left").select("id", pick("title"), pick("summary"), F.array_union("models", F.coalesce("n_models", none)).alias("models"), *[(F.col(c) + F.coalesce(f"n_{c}", F.lit(0))).alias(c) for c in ("messages", "bytes")])


def merge_origins(fields: DataFrame) -> DataFrame:
    """fields(field, origin): the worst origin of each field."""
    worst = F.array_position(F.array(*map(F.lit, C.ORIGINS)), F.col("origin"))
    return fields.groupBy("field").agg(F.max_by("origin", worst).alias("origin"))


def duplicate_appends(new: DataFrame, refs: DataFrame) -> DataFrame:
    """(session, id) of new messages whose id repeats among them or is the first or last of a stored chunk."""
    again = new.groupBy("session", "id").agg(F.count("*").alias("n")).where("n > 1").select("session", "id")
    ends = refs.select("session", F.explode(F.array("first", "last")).alias("id"))
    return again.union(new.select("session", "id").join(ends, ["session", "id"], "left_semi")).distinct()


def children(sessions: DataFrame) -> DataFrame:
    """(id, pos, child, title): subagents of each session in the order of their ids; sessions(id, title, parent)."""
    c = sessions.where("parent is not null").select(F.col("parent").alias("id"), F.col("id").alias("child"), "title")
    return c.join(sessions.select("id"), "id", "left_semi").withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy("child")) - 1)


def record_ids(catalogued: DataFrame, held: DataFrame) -> DataFrame:
    """(id, source): catalogued ids, then those only held."""
    both = catalogued.select("id", F.lit(0).alias("s")).union(held.select("id", F.lit(1).alias("s")))
    return both.groupBy("id").agg(F.when(F.min("s") == 0, "catalog").otherwise("held").alias("source"))


def revise_edges(current: DataFrame, revisions: DataFrame) -> DataFrame:
    """(id, child) after revisions(id, child, seq, add): the last revision of an edge decides; edges commute, so nothing is retried."""
    last = revisions.groupBy("id", "child").agg(F.max_by("add", "seq").alias("add"))
    kept = current.select("id", "child").distinct().join(last, ["id", "child"], "left").where(F.coalesce("add", F.lit(True))).select("id", "child")
    return kept.union(last.where("add").select("id", "child")).distinct()


def render(turns: DataFrame) -> DataFrame:
    """(session, pos, line): turns of one text each, as shown when a conversation is resumed; `parts.rendered_turns` shows turns of parts."""
    return turns.select("session", "pos", F.concat(F.lit("### "), "role", F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n\n")).alias("line"))


def framing(turns: DataFrame, heads: DataFrame) -> DataFrame:
    """(session, turns, dated, span): when a conversation of turns(session, pos, created) took place, as far as its turns say.

    `both` ends dated give a span; `some` turns give bounds, as an undated end lies before or after the nearest dated
    turn; with `none` the time at which the head(id, updated_at) was stored last bounds it, if there is one.
    """
    is_dated = F.col("created").isNotNull()
    a = turns.groupBy("session").agg(
        F.count("*").alias("turns"), F.min("pos").alias("p0"), F.max("pos").alias("p1"), F.min(F.when(is_dated, F.col("pos"))).alias("d0"), F.max(F.when(is_dated, F.col("pos"))).alias("d1"),
        F.min_by("created", F.when(is_dated, F.col("pos"))).alias("first"), F.max_by("created", F.when(is_dated, F.col("pos"))).alias("last"),
    )
    a = a.join(heads.select(F.col("id").alias("session"), "updated_at"), "session", "left")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    c = F.col
    began, ended = F.when(c("d0") > c("p0"), "before ").otherwise("at "), F.when(c("d1") < c("p1"), "after ").otherwise("at ")
    kind = F.when(c("d0").isNull(), "none").when((c("d0") == c("p0")) & (c("d1") == c("p1")), "both").otherwise("some")
    span = (
        F.when(kind == "both", say("from ", c("first"), " to ", c("last"))).when(kind == "some", say("began ", began, c("first"), ", ended ", ended, c("last")))
        .otherwise(F.coalesce(say("no later than ", c("updated_at")), F.lit("")))
    )
    return a.select("session", "turns", kind.alias("dated"), span.alias("span"))


def save_sessions(heads: DataFrame, saves: DataFrame, turns: DataFrame, target: int = C.CHUNK_TARGET_BYTES) -> tuple[DataFrame, DataFrame]:
    """Appends to conversations: (heads, chunks) after saves(id, expect), one a conversation, of new turns(session, pos, id, bytes).

    heads(id, version, chunks, messages); a save is accepted iff it expects the stored version (0 where there is none): the head
    then counts the new chunks and turns, one version on. Heads come back with `outcome` (accepted, stale, not_found, or null
    where nothing was saved). Chunks (session, seq, first, last, n, bytes) follow the stored ones; those of a refused
    save are marked `withdrawn`. Repeated saves of one conversation in a batch go through `logs.head_cas` first.
    """
    none = F.lit(0).cast("long")
    s = saves.select("id", "expect").join(heads, "id", "left").withColumn("now_", F.coalesce("version", none))
    verdict = F.when(F.col("expect") == F.col("now_"), "accepted").when(F.col("version").isNull(), "not_found").otherwise("stale")
    s = s.select("id", verdict.alias("outcome"), F.coalesce("chunks", none).alias("stored_"))
    numbers = chunk_numbers(turns, target=target).select("session", "pos", "chunk")
    refs = chunk_refs(turns.join(numbers, ["session", "pos"])).join(s.withColumnRenamed("id", "session"), "session")
    refs = refs.select("session", (F.col("seq") + F.col("stored_")).alias("seq"), "first", "last", "n", "bytes", (F.col("outcome") != "accepted").alias("withdrawn"))
    added = refs.where(~F.col("withdrawn")).groupBy(F.col("session").alias("id")).agg(F.count("*").alias("c_"), F.sum("n").alias("m_"))
    h = heads.join(s.drop("stored_"), "id", "full_outer").join(added, "id", "left").where("version is not null or outcome = 'accepted'")
    step = F.when(F.col("outcome") == "accepted", 1).otherwise(0)
    grown = [(F.coalesce(c, none) + F.coalesce(n, none)).alias(c) for c, n in (("chunks", "c_"), ("messages", "m_"))]
    return h.select("id", (F.coalesce("version", none) + step).alias("version"), *grown, "outcome"), refs
