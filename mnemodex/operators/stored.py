"""What is stored elsewhere: ranges and copies of objects, entries of restored frames, feeds, dates of adopted heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import logs


def feed_live(events: DataFrame, key: str, order: str, deleted: Column, readable: Column) -> DataFrame:
    """The live rows of a change feed, in the order in which their keys were first seen. The last event of a key is the truth: one that
    deletes it, or that cannot be read, leaves nothing of it."""
    folded = logs.latest(events.withColumn("gone_", deleted | ~F.coalesce(readable, F.lit(False))), key, order)
    return logs.live(folded, "gone_").drop("gone_").orderBy("first_seen")


def list_pages(ids: DataFrame, order: str, size: int) -> DataFrame:
    """A listing with the `page` of each row: `size` rows a page by a whole-number column, the last one shorter."""
    return logs.number_rows(ids, order, "place_").withColumn("page", F.floor(F.col("place_") / size)).drop("place_")


def read_range(blobs: DataFrame, offset, length) -> DataFrame:
    """blobs(ref, content) with that many bytes of the content from the offset (columns or numbers); past its end there are none."""
    c = lambda v: v if isinstance(v, Column) else F.lit(v)
    return blobs.withColumn("content", F.substring("content", (c(offset) + 1).cast("int"), c(length).cast("int")))


def read_copies(entries: DataFrame, frames: DataFrame) -> DataFrame:
    """(id, object_ref, outcome, sealed) of entries(id, object_ref) by the frames(ref, id, sealed) of their objects.

    `absent` where the object has no frame, `foreign` where the frame names another record, which is refused: then there is no body.
    """
    f = frames.select(F.col("ref").alias("object_ref"), F.col("id").alias("named_"), F.col("sealed").alias("body_"), F.lit(True).alias("there_"))
    same = F.col("named_").eqNullSafe(F.col("id"))
    outcome = F.when(F.col("there_").isNull(), "absent").when(same, "read").otherwise("foreign")
    return entries.select("id", "object_ref").join(f, "object_ref", "left").select("id", "object_ref", outcome.alias("outcome"), F.when(same, F.col("body_")).alias("sealed"))


BODY = "id string, type string, version long, tags array<string>, updated_at long"


def catalog_entries(frames: DataFrame) -> DataFrame:
    """Catalog entries of restored frames(ref, slab, id, kind, body: opened JSON, bytes, updated_at), with `problem`.

    A chunk's entry has version 1 and the object's time; any other takes type, version, tags and time from its body. A body that
    does not parse, and one that names another record, is a problem, and its entry is not to be stored.
    """
    b = F.from_json("body", BODY)
    chunk = F.col("kind") == "chunk"
    own = lambda name, other: F.when(chunk, other).otherwise(F.col(f"b_.{name}")).alias(name)
    problem = F.when(F.col("b_.id").isNull(), "unreadable").when(~F.col("b_.id").eqNullSafe(F.col("id").cast("string")), "names another record")
    return frames.withColumn("b_", b).select(
        "id", "kind", own("type", F.lit(None).cast("string")), own("version", F.lit(1).cast("long")), own("tags", F.array().cast("array<string>")),
        F.col("ref").alias("object_ref"), F.col("slab").alias("slab_id"), "bytes", F.when(chunk, F.col("updated_at")).otherwise(F.col("b_.updated_at")).alias("written_at"), problem.alias("problem"),
    )


def embed_outcomes(asked: DataFrame, embedded: DataFrame, now: DataFrame) -> DataFrame:
    """(id, outcome, vector) of asked(id, kind): embedded(id, kind, readable, vector) is what was read and made of it, and
    now(id, kind, readable) what is held since; ids are unique in each.

    `gone` if either reading lacks the record under its kind, `unembeddable` if a reading failed or no vector came, else `written`:
    only then is there a vector, so that a record forgotten meanwhile does not return to a search.
    """
    first = embedded.select("id", "kind", F.col("readable").alias("r1_"), "vector")
    second = now.select("id", "kind", F.col("readable").alias("r2_"))
    j = asked.select("id", "kind").join(first, ["id", "kind"], "left").join(second, ["id", "kind"], "left")
    outcome = F.when(F.col("r1_").isNull(), "gone").when(~F.col("r1_") | F.col("vector").isNull(), "unembeddable").when(F.col("r2_").isNull(), "gone").when(~F.col("r2_"), "unembeddable").otherwise("written")
    return j.select("id", outcome.alias("outcome"), F.when(outcome == "written", F.col("vector")).alias("vector"))


def undated_heads(heads: DataFrame, entries: DataFrame, ledger: DataFrame, queued: DataFrame, chunks: DataFrame) -> DataFrame:
    """Heads(id, version, created, updated, chunks array) whose dates are only those of their adoption, without them and one version on.

    Such a head was written once (created = updated), every chunk of it is in entries(id, slab_id) on a slab that the
    ledger(slab_id, origin) has as hydrated, none is queued(id), and all are held in chunks(id, dated) with no dated turn.
    A head's references are folded by partial sums, so one of very many chunks is no single task's burden.
    """
    once = heads.where((F.col("created") == F.col("updated")) & (F.size("chunks") > 0))
    hydrated = entries.join(ledger.where("origin = 'hydrated'").select("slab_id").distinct(), "slab_id", "left_semi").select(F.col("id").alias("ref_"))
    fit = hydrated.join(queued.select(F.col("id").alias("ref_")).distinct(), "ref_", "left_anti").join(chunks.where(~F.col("dated")).select(F.col("id").alias("ref_")), "ref_", "left_semi").distinct()
    refs = once.select("id", F.explode("chunks").alias("ref_")).join(fit.withColumn("fit_", F.lit(True)), "ref_", "left")
    good = refs.groupBy("id").agg(F.bool_and(F.col("fit_").isNotNull()).alias("all_")).where("all_").select("id")
    kinds = dict(heads.dtypes)
    gone = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    return once.join(good, "id", "left_semi").select("id", (F.col("version") + 1).alias("version"), gone("created"), gone("updated"), "chunks")
