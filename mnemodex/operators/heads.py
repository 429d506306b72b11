"""Session heads rebuilt from stored transcripts, and how each of their fields came back.

Frames: messages(session, pos, id, role, parts, created, model, tokens_in, tokens_out, memory_refs), tokens_in being what was sent and what was
read from a cache; chunks(session, seq, bytes); backlinks(session, id) of memories whose source is the session. What is gathered in a row is bounded
by the distinct models of a conversation; its memories stay rows (`head_links`), as one session may have a third of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from .parts import spoken_titles

# The fields of a head
FIELDS = (
    "id", "schema", "schemaVersion", "version", "title", "summary", "tags", "project", "created", "updated", "archived", "agent", "agentRef", "models", "counts.messages", "counts.chunks",
    "counts.bytes", "counts.tokens", "counts.durationMs", "kind", "lineage", "headMessage", "preservedTail", "chunks", "links.memories", "embedding",
)


def observed(messages: DataFrame) -> DataFrame:
    """Per session: messages, tokens_in, tokens_out, created and updated (of the first and last dated turn in the order they were said, not by
    the clock), models (distinct, in order of their first turn), head_message."""
    dated = F.when(F.col("created").isNotNull(), F.col("pos"))
    none = lambda c: F.coalesce(F.sum(c), F.lit(0))
    a = messages.groupBy("session").agg(
        F.count("*").alias("messages"), none("tokens_in").alias("tokens_in"), none("tokens_out").alias("tokens_out"), F.min_by("created", dated).alias("created"), F.max_by("created", dated).alias("updated"), F.max_by("id", "pos").alias("head_message"),
    )
    named = messages.where(F.coalesce("model", F.lit("")) != "").groupBy("session", "model").agg(F.min("pos").alias("at"))
    models = named.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "model"))), lambda x: x["model"]).alias("models"))
    return a.join(models, "session", "left").withColumn("models", F.coalesce("models", F.array().cast("array<string>")))


def head_links(messages: DataFrame, backlinks: DataFrame) -> DataFrame:
    """(session, id, place): the memories of each session, those that name it as their source first, then those its turns had in context; each once, by
    its first place."""
    back = backlinks.select("session", "id", F.struct(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("pos"), F.lit(0).alias("at")).alias("place"))
    said = messages.select("session", "pos", F.posexplode("memory_refs").alias("at", "id")).select("session", "id", F.struct(F.lit(1).alias("kind"), F.col("pos").cast("long").alias("pos"), "at").alias("place"))
    return back.unionByName(said).groupBy("session", "id").agg(F.min("place").alias("place"))


def _origins(known: dict[str, Column | str]) -> Column:
    """A map of every field to its origin; what is not known is lost."""
    values = [F.lit(known[f]) if isinstance(known.get(f), str) else known.get(f, F.lit("lost")) for f in FIELDS]
    return F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array(*values))


def rebuild_heads(messages: DataFrame, chunks: DataFrame, backlinks: DataFrame, embed: bool = False) -> DataFrame:
    """(session, title, kind, version, messages, chunks, bytes, tokens_in, tokens_out, created, updated, models, head_message, memories, origins).

    origins maps every field of a head to chunk (a chunk carries it), derived (computed from chunks), observed (read in the turns), reverse
    (from memories), synthesised (invented here) or lost. Undated conversations stay undated. One without turns has no head.
    """
    o, t = observed(messages), spoken_titles(messages)
    c = chunks.groupBy("session").agg(F.count("*").alias("chunks"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    m = head_links(messages, backlinks).groupBy("session").agg(F.count("*").alias("memories"))
    h = o.join(t, "session").join(c, "session").join(m, "session", "left").withColumn("memories", F.coalesce("memories", F.lit(0)))
    if_ = lambda cond, origin: F.when(cond, origin).otherwise("lost")
    dated = if_(F.col("created").isNotNull(), "observed")
    origins = _origins({
        **dict.fromkeys(("id", "schema", "schemaVersion"), "chunk"), **dict.fromkeys(("version", "kind", "title"), "synthesised"), **dict.fromkeys(("chunks", "counts.messages", "counts.chunks", "counts.bytes"), "derived"),
        "counts.tokens": if_((F.col("tokens_in") > 0) | (F.col("tokens_out") > 0), "observed"), "created": dated, "updated": dated, "models": if_(F.size("models") > 0, "observed"),
        "headMessage": if_(F.coalesce("head_message", F.lit("")) != "", "derived"), "links.memories": if_(F.col("memories") > 0, "reverse"), "embedding": "synthesised" if embed else "lost",
    })
    return h.select(
        "session", "title", F.lit("main").alias("kind"), F.lit(1).alias("version"), "messages", "chunks", "bytes", "tokens_in", "tokens_out", "created", "updated", "models", "head_message", "memories", origins.alias("origins"),
    )


def worst_origins(heads: DataFrame) -> DataFrame:
    """(field, origin): the weakest origin of each field over all heads, in the order of C.ORIGINS."""
    worst = F.array_position(F.array(*map(F.lit, C.ORIGINS)), F.col("origin"))
    return heads.select(F.explode("origins").alias("field", "origin")).groupBy("field").agg(F.max_by("origin", worst).alias("origin"))
