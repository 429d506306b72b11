"""Listings with hard filters, keyset and offset paging, tag statistics, advice.

Frames: records(id, kind, type, tags, supersedes, created_at), tags(id, tag), sessions(...).
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T


def tag_rows(records: DataFrame) -> DataFrame:
    return records.select("id", F.explode("tags").alias("tag")).distinct()


def with_all_tags(df: DataFrame, tags: DataFrame, want: list[str]) -> DataFrame:
    """Rows that carry every wanted tag (relational division)."""
    want = list(dict.fromkeys(want))
    if not want:
        return df
    have = tags.where(F.col("tag").isin(want)).groupBy("id").agg(F.count_distinct("tag").alias("n")).where(F.col("n") == len(want))
    return df.join(have, "id", "left_semi")


def superseded_ids(records: DataFrame) -> DataFrame:
    return records.where("supersedes is not null").select(F.col("supersedes").alias("id")).distinct()


def superseded_flag(records: DataFrame) -> DataFrame:
    return records.join(superseded_ids(records).withColumn("superseded", F.lit(True)), "id", "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))


def encode_cursor(created: str, id_: str) -> str:
    return base64.urlsafe_b64encode(f"{created}\0{id_}".encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[str, str]:
    raw = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode()
    created, sep, id_ = raw.partition("\0")
    if not sep:
        raise ValueError("not a listing cursor")
    return created, id_


def list_records(records: DataFrame, tags: DataFrame, kinds: list[str] | None = None, types: list[str] | None = None, want: list[str] | None = None, include_superseded: bool = False, after: tuple | None = None, page: int = C.RECORD_PAGE) -> DataFrame:
    """A page by created_at descending (unknown last), then id; strictly after the position `after` = (created_at, id).

    A row beyond the page tells whether there is more: `more` is true on every row then. Filters are pushed to the scan, and the sort is a top-k.
    """
    page = min(page or C.RECORD_PAGE, C.RECORD_PAGE_MAX)
    df = records
    if kinds:
        df = df.where(F.col("kind").isin(kinds))
    if types:
        df = df.where(F.col("type").isin(types))
    df = with_all_tags(df, tags, want or [])
    if not include_superseded:
        df = df.join(superseded_ids(records), "id", "left_anti")
    if after is not None:
        created, id_ = after
        later = F.col("created_at").isNull() & (F.col("id") > id_)
        if created is not None:
            later = (F.col("created_at") < F.lit(created)) | F.col("created_at").isNull() | ((F.col("created_at") == F.lit(created)) & (F.col("id") > id_))
        df = df.where(later)
    order = [F.desc_nulls_last("created_at"), F.asc("id")]
    some = df.orderBy(*order).limit(page + 1)
    n = some.agg(F.count("*").alias("n"))
    return some.orderBy(*order).limit(page).crossJoin(n).withColumn("more", F.col("n") > page).drop("n")  # one row


def attach_tags(page: DataFrame, tags: DataFrame) -> DataFrame:
    """A page's rows with their sorted tags; a page is bounded, so its ids are broadcast to the tag scan."""
    own = tags.join(F.broadcast(page.select("id")), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return page.drop("tags").join(own, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def session_filter(sessions: DataFrame, kinds=None, parent=None, project=None, since=None, until=None, want=None, archived: bool | None = False) -> DataFrame:
    """Sessions by conditions that all hold; archived None takes both, times are inclusive."""
    df = sessions
    if archived is not None:
        df = df.where(F.col("archived") == archived)
    if kinds:
        df = df.where(F.col("kind").isin(kinds))
    for name, value in (("parent", parent), ("project", project)):
        if value is not None:
            df = df.where(F.col(name) == value)
    if since is not None:
        df = df.where(F.col("updated_at") >= F.lit(since))
    if until is not None:
        df = df.where(F.col("updated_at") <= F.lit(until))
    for t in want or []:
        df = df.where(F.array_contains("tags", t))
    return df


def list_sessions(sessions: DataFrame, limit: int = C.SESSION_PAGE, offset: int = 0, **conditions) -> DataFrame:
    df = session_filter(sessions, **conditions).orderBy(F.desc_nulls_last("updated_at"), "id")
    return df.offset(max(offset, 0)).limit(limit or C.SESSION_PAGE)


def count_by_kind(records: DataFrame) -> DataFrame:
    return records.groupBy("kind").agg(F.count("*").alias("n"))


def tag_frequencies(tags: DataFrame, records: DataFrame, want: list[str], self_id=None) -> DataFrame:
    """(position, tag, n, total): uses of each requested tag in input order, zero-filled, the record itself left out."""
    others = F.lit(True) if self_id is None else F.col("id") != self_id
    asked = tags.sparkSession.createDataFrame(list(enumerate(want)), "position int, tag string")
    n = tags.where(F.col("tag").isin(want) & others).groupBy("tag").agg(F.count("*").alias("n"))
    total = records.where(others).agg(F.count("*").alias("total"))
    return asked.join(n, "tag", "left").crossJoin(total).select("position", "tag", F.coalesce("n", F.lit(0)).alias("n"), "total")  # one row


def tag_vocabulary(tags: DataFrame, limit: int = C.VOCABULARY_LIMIT) -> DataFrame:
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(limit)


def tag_specificity(frequencies: DataFrame) -> DataFrame:
    """tag_frequencies with share, is_new, too_common."""
    share = F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0)
    common = (F.col("total") >= C.TAG_ADVICE_MIN_RECORDS) & (share > C.TAG_COMMON_SHARE)
    return frequencies.select("*", F.round(share, 6).alias("share"), (F.col("n") == 0).alias("is_new"), common.alias("too_common"))


def needs_narrower(specificity: DataFrame) -> DataFrame:
    """One row: discriminating tags, and whether none of some tags discriminates."""
    a = specificity.agg(F.count("*").alias("tags"), F.count_if(~F.col("too_common")).alias("discriminating"))
    return a.withColumn("needs_narrower", (F.col("tags") > 0) & (F.col("discriminating") == 0))


def labels(ids: DataFrame, sessions: DataFrame, memories: DataFrame) -> DataFrame:
    """A session's title, else a memory's statement, else empty."""
    s = sessions.select("id", F.col("title").alias("t"))
    m = memories.select("id", F.col("statement").alias("m"))
    return ids.join(s, "id", "left").join(m, "id", "left").select("id", F.coalesce("t", "m", F.lit("")).alias("label"))


def first_failing_rule(memories: DataFrame) -> DataFrame:
    """memories with `problem`: the first rule of the record format that a row breaks, or null. kind and schema_version are judged where they are columns."""
    c, no, tag = F.col, F.lit(False), tag_problem(F.col("tags"))
    rules = [
        (c("id").isNull(), "missing id"), (~c("kind").eqNullSafe("memory") if "kind" in memories.columns else no, "unknown kind"), (F.coalesce("schema_version", F.lit(0)) <= 0 if "schema_version" in memories.columns else no, "missing schema version"), (c("created_at").isNull(), "missing created_at"), (c("type").isNull(), "missing type"),
        (~c("type").isin(*C.TYPES), "unknown type"), (F.coalesce(F.trim("statement"), F.lit("")) == "", "empty statement"), (F.coalesce(F.trim("context"), F.lit("")) == "", "empty context"),
        (F.octet_length("statement") > C.STATEMENT_MAX, "statement too long"), (F.octet_length("context") > C.CONTEXT_MAX, "context too long"),
        *[(tag == name, name) for name in ("too many tags", "empty tag", "tag too long")], (~c("importance").between(0, 1), "importance out of range"), (~c("confidence").between(0, 1), "confidence out of range"), (c("valid_until") < c("valid_from"), "validity ends before it starts"),
    ]
    return memories.withColumn("problem", F.coalesce(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for cond, name in rules]))


def held_records(meta: DataFrame, sessions: DataFrame, bodies: DataFrame, heads: DataFrame) -> DataFrame:
    """(id, in_meta, in_sessions, in_bodies, in_heads) over the four id sets."""
    sets = [d.select("id", *[F.lit(i == j).alias(n) for j, n in enumerate(names)]) for i, d in enumerate((meta, sessions, bodies, heads)) for names in [("in_meta", "in_sessions", "in_bodies", "in_heads")]]
    every = sets[0].union(sets[1]).union(sets[2]).union(sets[3])
    return every.groupBy("id").agg(*[F.bool_or(n).alias(n) for n in ("in_meta", "in_sessions", "in_bodies", "in_heads")])


def listing_dates(listing: DataFrame, bodies: DataFrame, heads: DataFrame) -> DataFrame:
    """(id, kind, body): the stored body, or the session head where there is none."""
    b = bodies.select("id", F.col("body").alias("b"))
    h = heads.select("id", F.col("head").alias("h"))
    return listing.join(b, "id", "left").join(h, "id", "left").select("id", "kind", F.coalesce("b", "h").alias("body"))


def recent_conversations(sessions: DataFrame, n: int = C.RESUME_CHOICES) -> DataFrame:
    return sessions.orderBy(F.desc_nulls_last("updated_at"), "id").limit(n).select("id", "title", "updated_at")


def browse_hint(shown: Column, filtered: Column, cursor: Column, replaced: Column, history: Column | None = None, missing: Column | None = None) -> Column:
    """Why a page is empty. filtered, cursor: whether filters and a cursor were given; replaced: records past the cursor that the
    filters select and others replace; history: whether those are listed too; missing: catalogued records that this device lacks.

    Filters are blamed on a first page only: behind a cursor the listing has ended, or the rest of it has been replaced.
    """
    no = F.lit(False)
    nothing = F.when(F.coalesce(missing, F.lit(0)) > 0, "nothing is stored here, and not all that the catalog names has been restored") if missing is not None else F.when(no, "")
    return (
        F.when(shown > 0, "").when(~cursor & filtered, "the filters select nothing").when(~cursor, nothing.otherwise("nothing is stored yet"))
        .when(~(history if history is not None else no) & (replaced > 0), "all that is left past the cursor has been replaced").otherwise("the listing ends here")
    )


def write_advice(conflicts, too_common, tags):
    """What a writer should know: near duplicates, and tags that tell nothing apart."""
    dup = F.when(conflicts > 0, F.concat(conflicts.cast("string"), F.lit(" near duplicates")))
    tag = F.when((tags > 0) & (too_common == tags), F.lit("every tag is common"))
    return F.concat_ws("; ", dup, tag)


def tag_problem(tags: Column) -> Column:
    """The first tag rule broken, in the order of the tags; or null."""
    bad = F.transform(tags, lambda t: F.when(T.trimmed(F.coalesce(t, F.lit(""))) == "", "empty tag").when(F.octet_length(t) > C.TAG_BYTES_MAX, "tag too long"))
    return F.when(F.size(tags) > C.TAGS_MAX, "too many tags").otherwise(F.try_element_at(F.array_compact(bad), F.lit(1)))


def _blank(x: Column) -> Column:
    return T.trimmed(F.coalesce(x, F.lit(""))) == ""


def session_problem(sessions: DataFrame) -> DataFrame:
    """sessions(id, schema, schema_version, version, kind, title, summary, tags, parent, chunks array<struct<id, seq>>) with
    `problem`: the first rule of the record format that a head breaks, or null. Rules that need an absent column are of null values."""
    c = F.col
    number = lambda x: F.coalesce(c(x), F.lit(0))
    chunk = F.transform("chunks", lambda x, i: F.when(_blank(x["id"].cast("string")), "chunk without id").when(~x["seq"].eqNullSafe(i), "chunks out of sequence"))
    rules = [
        F.when(_blank(c("id").cast("string")), "missing id"), F.when(~c("schema").eqNullSafe(C.MESSAGE_SCHEMA), "unknown schema"), F.when(number("schema_version") <= 0, "missing schema version"), F.when(number("version") <= 0, "version below 1"),
        F.when(~F.coalesce(c("kind").isin(*C.SESSION_KINDS), F.lit(False)), "unknown kind"), F.when(_blank(c("title")), "empty title"), F.when(F.octet_length("title") > C.TITLE_MAX, "title too long"), F.when(F.octet_length("summary") > C.SUMMARY_MAX, "summary too long"),
        tag_problem(c("tags")), F.when((c("kind") == "subagent") & c("parent").isNull(), "subagent without parent"), F.try_element_at(F.array_compact(chunk), F.lit(1)),
    ]
    return sessions.withColumn("problem", F.coalesce(*rules))


def chunk_problem(chunks: DataFrame) -> DataFrame:
    """chunks(id, kind, schema, schema_version, session, seq, messages) with `problem`, messages being their number; the messages' own rules are `parts.message_problems`."""
    c = F.col
    number = lambda x: F.coalesce(c(x), F.lit(0))
    rules = [
        F.when(_blank(c("id").cast("string")), "missing id"), F.when(~c("kind").eqNullSafe("chunk"), "unknown kind"), F.when(~c("schema").eqNullSafe(C.MESSAGE_SCHEMA), "unknown schema"), F.when(number("schema_version") <= 0, "missing schema version"),
        F.when(_blank(c("session").cast("string")), "no session"), F.when(number("seq") < 0, "negative sequence"), F.when(number("messages") == 0, "no messages"),
    ]
    return chunks.withColumn("problem", F.coalesce(*rules))
