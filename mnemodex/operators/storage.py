"""Queues, slabs and garbage-collection plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C


def queue_state(queue: DataFrame) -> DataFrame:
    """One row: n, bytes, oldest, newest of queue(queued_at, payload)."""
    return queue.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("bytes"), F.min("queued_at").alias("oldest"), F.max("queued_at").alias("newest"))


def due(state: DataFrame, now, max_records=C.MAX_RECORDS, max_bytes=C.SLAB_BYTES, max_age=C.MAX_AGE_SECONDS, idle=C.IDLE_SECONDS) -> DataFrame:
    """state(n, bytes, oldest, newest) with `reason`: records, bytes, age, idle, in that order, or none."""
    age = lambda c: F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(c.cast("timestamp"))
    reason = (
        F.when(F.col("n") == 0, F.lit("none")).when(F.col("n") >= max_records, F.lit("records")).when(F.col("bytes") >= max_bytes, F.lit("bytes"))
        .when(age(F.col("oldest")) >= max_age * 1_000_000, F.lit("age")).when(age(F.col("newest")) >= idle * 1_000_000, F.lit("idle")).otherwise(F.lit("none"))
    )
    return state.withColumn("reason", reason)


def claimable(queue: DataFrame, now, stale: int = C.CLAIM_SECONDS, limit: int = 0) -> DataFrame:
    """Unclaimed rows and those whose claim is stale, oldest first; stale of 0 or less takes all."""
    df = queue
    if stale > 0:
        df = df.where(F.col("claimed_at").isNull() | (F.unix_micros(F.col("claimed_at").cast("timestamp")) < F.unix_micros(F.lit(now).cast("timestamp")) - stale * 1_000_000))
    df = df.orderBy("seq")
    return df.limit(limit) if limit else df


def slab_ledger(entries: DataFrame) -> DataFrame:
    """Additive upserts: records and bytes add up, `pinned` is the stronger origin."""
    return entries.groupBy("slab_id").agg(F.min("pinned_at").alias("pinned_at"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"), F.max("origin").alias("origin"))


def tier_stats(reads: DataFrame) -> DataFrame:
    """reads(tier, nanos, missed): reads, nanos, misses, mean (0 without reads)."""
    a = reads.groupBy("tier").agg(F.count_if(~F.col("missed")).alias("reads"), F.sum(F.when(~F.col("missed"), F.col("nanos")).otherwise(0)).alias("nanos"), F.count_if("missed").alias("misses"))
    return a.withColumn("mean", F.coalesce(F.try_divide("nanos", "reads"), F.lit(0.0)))


def dead_objects(objects: DataFrame, owned: DataFrame, live: DataFrame) -> DataFrame:
    """objects(ref, slab) on owned slabs that no live entry names."""
    return objects.join(owned.select("slab"), "slab", "left_semi").join(live.select("ref"), "ref", "left_anti").select("ref", "slab")


def foreign_objects(objects: DataFrame, owned: DataFrame) -> DataFrame:
    return objects.join(owned.select("slab"), "slab", "left_anti").agg(F.count("*").alias("n"))


def releasable_slabs(owned: DataFrame, live_slabs: DataFrame) -> DataFrame:
    return owned.select("slab").join(live_slabs.select("slab"), "slab", "left_anti")


def orphans(pinned: DataFrame, occupied: DataFrame, tracked: DataFrame, named: DataFrame) -> DataFrame:
    """(slab, tracked, named) of pinned slabs that hold nothing."""
    flag = lambda d, n: d.select("slab").distinct().withColumn(n, F.lit(True))
    o = pinned.select("slab").distinct().join(occupied.select("slab"), "slab", "left_anti").join(flag(tracked, "tracked"), "slab", "left").join(flag(named, "named"), "slab", "left")
    return o.select("slab", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("tracked", "named")])


def unledgered(pinned: DataFrame, tracked: DataFrame, occupied: DataFrame) -> DataFrame:
    """(slab, empty) of pinned slabs that the ledger lacks."""
    o = occupied.select("slab").distinct().withColumn("full", F.lit(True))
    return pinned.select("slab").distinct().join(tracked.select("slab"), "slab", "left_anti").join(o, "slab", "left").select("slab", F.col("full").isNull().alias("empty"))


def restoration_gap(catalog: DataFrame, described: DataFrame, held: DataFrame) -> DataFrame:
    """(kind, n) of live catalog(id, kind) that is neither described nor held."""
    have = described.select("id").union(held.select("id")).distinct()
    return catalog.join(have, "id", "left_anti").groupBy("kind").agg(F.count("*").alias("n"))


def index_repair(records: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, action): `drop` vectors whose record may not return, `embed` records with text that have none.

    records(id, listed, head, body, catalogued, text, pass_over)."""
    v = vectors.select("id").distinct().withColumn("has", F.lit(True))
    r = records.join(v, "id", "full_outer")
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    may = on("head") | on("body") | (on("listed") & on("catalogued"))
    action = F.when(on("has") & ~may, F.lit("drop")).when(~on("has") & on("listed") & (F.coalesce("text", F.lit("")) != "") & ~on("pass_over"), F.lit("embed"))
    return r.select("id", action.alias("action")).where("action is not null")


def repack_writes(objects: DataFrame, overhead: int, slab_bytes: int = C.SLAB_BYTES) -> DataFrame:
    """One row: slabs a repack of objects(slab, bytes) writes: by size, or by slabs where a size is unknown."""
    a = objects.agg(F.coalesce(F.sum(F.col("bytes") + overhead), F.lit(0)).alias("bytes"), F.count_distinct("slab").alias("slabs"), F.coalesce(F.bool_and(F.col("bytes") > 0), F.lit(True)).alias("known"))
    return a.select("bytes", "slabs", F.when(F.col("known"), F.ceil(F.col("bytes") / slab_bytes)).otherwise(F.col("slabs")).cast("long").alias("writes"))


def watermark(state: DataFrame, slab_bytes: int = C.SLAB_BYTES) -> DataFrame:
    """state(pinned, max, writes) with used, due, affordable."""
    used = F.coalesce(F.try_divide("pinned", "max"), F.lit(0.0))
    free = F.greatest(F.col("max") - F.col("pinned"), F.lit(0))
    return state.select("*", F.round(used, 6).alias("used"), (used >= C.REPACK_WATERMARK).alias("due"), (free >= F.col("writes") * slab_bytes).alias("affordable"))


def keep_set(catalog: DataFrame) -> DataFrame:
    """One row: live objects, live slabs, catalogued entries of catalog(id, object_ref, slab_id, deleted)."""
    on = ~F.col("deleted")
    return catalog.agg(F.count_distinct(F.when(on, F.nullif("object_ref", F.lit("")))).alias("objects"), F.count_distinct(F.when(on, F.nullif("slab_id", F.lit("")))).alias("slabs"), F.count_if(on).alias("catalogued"))


def check_keep_set(keep: DataFrame, pinned: str = "pinned", release_all: bool = False) -> DataFrame:
    """keep(objects, slabs, catalogued, pinned) with `refusal`: why a sweep must not run, or null.

    Nothing catalogued is fine where nothing is pinned, or where the caller says that all is to go; otherwise every
    catalogued record needs an object that the set names, and some slab.
    """
    c = F.col
    none = (c("catalogued") == 0) & ((c(pinned) == 0) | F.lit(release_all))
    return keep.withColumn(
        "refusal",
        F.when(c("catalogued") < 0, F.lit("a negative number of records is catalogued")).when(none, F.lit(None).cast("string")).when(c("catalogued") == 0, F.lit("nothing is catalogued"))
        .when(c("objects") == 0, F.lit("no live object is named")).when(c("objects") < c("catalogued"), F.lit("fewer objects are named than records are catalogued")).when(c("slabs") == 0, F.lit("no live slab is named")),
    )


def check_occupancy(pinned: int, occupied: int, forced: bool = False) -> None:
    if pinned > 0 and occupied == 0 and not forced:
        raise ValueError("slabs are pinned but none is reported as occupied")


def cache_hits(locations: DataFrame, slabs: DataFrame, now, ttl: int) -> DataFrame:
    """(id, hit): an object's location and every slab of it are cached and younger than ttl. locations(id, slabs, cached_at), slabs(slab, cached_at)."""
    fresh = lambda c: F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(c.cast("timestamp")) < ttl
    l = locations.select("id", F.explode_outer("slabs").alias("slab"), fresh(F.col("cached_at")).alias("own"))  # noqa: E741
    s = slabs.select("slab", fresh(F.col("cached_at")).alias("part"))
    return l.join(s, "slab", "left").groupBy("id").agg((F.bool_and("own") & F.bool_and(F.col("slab").isNull() | F.coalesce("part", F.lit(False)))).alias("hit"))


def withdraw_all(queue: DataFrame, ids: DataFrame, now, stale: int = C.CLAIM_SECONDS) -> DataFrame:
    """The queue without these ids, or whole if any of them is under a live claim."""
    live = F.col("claimed_at").isNotNull() & (F.unix_micros(F.col("claimed_at").cast("timestamp")) >= F.unix_micros(F.lit(now).cast("timestamp")) - stale * 1_000_000)
    asked = ids.select("record_id").distinct().withColumn("asked", F.lit(True))
    blocked = queue.join(asked, "record_id").agg(F.coalesce(F.bool_or(live), F.lit(False)).alias("blocked"))
    return queue.join(asked, "record_id", "left").crossJoin(blocked).where(F.col("blocked") | F.col("asked").isNull()).drop("asked", "blocked")  # one row


def flush_match(flushed: DataFrame, queue: DataFrame) -> DataFrame:
    """queue rows with `written`: whether a flush result has their cid; any false means an error."""
    f = flushed.select("cid").distinct().withColumn("written", F.lit(True))
    return queue.join(f, "cid", "left").withColumn("written", F.coalesce("written", F.lit(False)))


def split_locations(locations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Object rows (id, pos, slab) and shared slab rows (slab, meta) of locations(id, slabs array<struct<slab, meta>>)."""
    x = locations.select("id", F.posexplode("slabs").alias("pos", "s"))
    return x.select("id", "pos", "s.slab"), x.groupBy("s.slab").agg(F.max("s.meta").alias("meta"))


def ownership(objects: DataFrame, releasable: DataFrame) -> DataFrame:
    """(ref, foreign): slabs of each object that this device may not release."""
    r = releasable.select("slab").distinct().withColumn("mine", F.lit(True))
    return objects.join(r, "slab", "left").groupBy("ref").agg(F.count_if(F.col("mine").isNull()).alias("foreign"))


def cache_size(objects: DataFrame, slabs: DataFrame) -> DataFrame:
    """One row: counts and bytes of cached objects(blob) and slabs(blob), and bytes per object."""
    size = lambda d, n: d.agg(F.count("*").alias(n), F.coalesce(F.sum(F.octet_length("blob")), F.lit(0)).alias(f"{n}_bytes"))
    a = size(objects, "objects").crossJoin(size(slabs, "slabs"))  # one row each
    return a.withColumn("per_object", F.coalesce(F.try_divide(F.col("objects_bytes") + F.col("slabs_bytes"), F.col("objects")), F.lit(0.0)))


def take_ownership(ledger: DataFrame) -> DataFrame:
    """The ledger with every slab pinned by this device, and `taken`: whether that changed it."""
    return ledger.withColumn("taken", F.col("origin") == "hydrated").withColumn("origin", F.lit("pinned"))


def join_locations(objects: DataFrame, slabs: DataFrame) -> DataFrame:
    """(id, slabs): object rows with their shared slab data in order; a missing slab is an error."""
    s = slabs.select("slab", "meta").withColumn("there", F.lit(True))
    j = objects.join(s, "slab", "left").withColumn("meta", F.when(F.col("there"), F.col("meta")).otherwise(F.raise_error(F.lit("a slab is missing"))))
    return j.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "slab", "meta"))).alias("slabs"))  # a handful of slabs an object


DEPTHS = ("catalog", "metadata", "index")


def restore_plan(found: DataFrame, forgotten: DataFrame, depth: str = "metadata") -> DataFrame:
    """found(ref, slab, id, kind, opened) with what a restore does with each frame: `outcome` (foreign: it does not open;
    forgotten; restored) and, for restored ones, whether it is catalogued, and from deeper levels on has its body stored,
    its metadata ranked and its vector made. Chunks are bodies only."""
    level = DEPTHS.index(depth)
    f = forgotten.select("id").distinct().withColumn("f_", F.lit(True))
    out = F.when(~F.col("opened"), "foreign").when(F.col("f_"), "forgotten").otherwise("restored")
    done, searched = F.col("outcome") == "restored", F.col("kind") != "chunk"
    return found.join(f, "id", "left").withColumn("outcome", out).drop("f_").withColumns({"catalogued": done, "body": done & F.lit(level > 0), "ranked": done & F.lit(level > 0) & searched, "embedded": done & F.lit(level > 1) & searched})


def restore_report(plan: DataFrame) -> DataFrame:
    """One row of a restore's counters."""
    done = F.when(F.col("catalogued"), F.col("slab"))
    return plan.agg(
        F.count_distinct("ref").alias("objects"), F.count("*").alias("frames"), F.count_if(F.col("outcome") == "foreign").alias("foreign"), F.count_if(F.col("outcome") == "forgotten").alias("forgotten"),
        F.count_if("catalogued").alias("records"), F.count_distinct(done).alias("slabs"), F.count_if("body").alias("bodies"), F.count_if("embedded").alias("embedded"),
    )


def adopted_slabs(plan: DataFrame) -> DataFrame:
    """Ledger rows of a restore: slabs taken on for reading, with records and sealed bytes, of a plan that has `bytes`."""
    return plan.where("catalogued").groupBy(F.col("slab").alias("slab_id")).agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes")).withColumn("origin", F.lit("hydrated"))


def _on_slab() -> Column:
    return F.coalesce(F.col("slab").cast("string"), F.lit("")) != ""


def repack_refusal(held: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: slabs of held(slab), those that this device did not pin (ledger(slab, origin)), and whether a repack is refused for them."""
    ours = ledger.where("origin = 'pinned'").select("slab").distinct().withColumn("ours_", F.lit(True))
    a = held.where(_on_slab()).select("slab").distinct().join(ours, "slab", "left").agg(F.count("*").alias("slabs"), F.count_if(F.col("ours_").isNull()).alias("foreign"))
    return a.withColumn("refused", F.col("foreign") > 0)


def repack_moves(held: DataFrame, gone: DataFrame, written: DataFrame) -> DataFrame:
    """(id, cid, from, to, slab, bytes): held(id, cid, ref) whose object is not gone(ref), with where written(cid, ref, slab, bytes) put it; one that was not written is an error."""
    w = written.select("cid", F.col("ref").alias("to"), F.col("slab").alias("slab"), "bytes")
    m = held.select("id", "cid", F.col("ref").alias("from")).join(gone.select(F.col("ref").alias("from")).distinct(), "from", "left_anti").join(w, "cid", "left")
    return m.select("id", "cid", "from", F.when(F.col("to").isNull(), F.raise_error(F.concat(F.lit("not written: "), F.col("cid").cast("string"))).cast("string")).otherwise(F.col("to")).alias("to"), "slab", "bytes")


def repack_release(held: DataFrame, gone: DataFrame, written: DataFrame, owed: DataFrame) -> DataFrame:
    """Slabs that a repack lets go: those it read from, but for ones that it wrote to, ones with a record left behind, and ones that owe a deletion."""
    left = held.join(gone.select("ref").distinct(), "ref", "left_semi").select("slab")
    moved = held.join(gone.select("ref").distinct(), "ref", "left_anti").limit(1).select(F.lit(True).alias("any_"))
    stay = written.select("slab").union(left).union(owed.select("slab")).distinct()
    return held.where(_on_slab()).select("slab").distinct().join(stay, "slab", "left_anti").crossJoin(moved).select("slab")  # one row: nothing goes if nothing moved


def repack_report(held: DataFrame, gone: DataFrame, written: DataFrame) -> DataFrame:
    """One row: moved and gone records, slabs before and after, and the peak while both stand."""
    g = gone.select("ref").distinct().withColumn("gone_", F.lit(True))
    h = held.join(g, "ref", "left").withColumn("gone_", F.col("gone_").isNotNull())
    a = h.agg(F.count_if(~F.col("gone_")).alias("moved"), F.count_if("gone_").alias("gone"), F.count_distinct(F.when(_on_slab(), F.col("slab"))).alias("before"))
    w = written.select("slab").distinct()
    after = w.union(h.where(F.col("gone_") & _on_slab()).select("slab")).distinct().agg(F.count("*").alias("after"))
    return a.crossJoin(after).crossJoin(w.agg(F.count("*").alias("new"))).select("moved", "gone", "before", "after", (F.col("before") + F.col("new")).alias("peak"))  # one row each


def delete_batches(stale: DataFrame, order: str = "seq", size: int = 64) -> DataFrame:
    """Deletions with `batch`: at most `size` of them in each, in order."""
    from .logs import number_rows

    return number_rows(stale, order, "place_").withColumn("batch", F.floor(F.col("place_") / size)).drop("place_")


def release_claims(queue: DataFrame, ids: DataFrame) -> DataFrame:
    """The queue after a failed flush: these records are unclaimed again, of time and claimant."""
    asked = ids.select("record_id").distinct().withColumn("asked_", F.lit(True))
    mine = [c for c in ("claimed_at", "claimed_by") if c in queue.columns]
    return queue.join(asked, "record_id", "left").withColumns({c: F.when(F.col("asked_").isNull(), F.col(c)) for c in mine}).select(*queue.columns)


def drop_queued(queue: DataFrame, ids: DataFrame) -> DataFrame:
    """The queue without records that reached the network, claimed or not."""
    return queue.join(ids.select("record_id").distinct(), "record_id", "left_anti").select(*queue.columns)


def mark_claims(queue: DataFrame, claimed: DataFrame, now, by: str) -> DataFrame:
    """The queue with the rows of `claimed`(seq) under a claim; others keep theirs."""
    c = claimed.select("seq").distinct().withColumn("mine_", F.lit(True))
    was = F.col("claimed_by") if "claimed_by" in queue.columns else F.lit(None).cast("string")
    taken = {"claimed_at": F.when(F.col("mine_"), F.lit(now).cast("timestamp")).otherwise(F.col("claimed_at")), "claimed_by": F.when(F.col("mine_"), F.lit(by)).otherwise(was)}
    return queue.join(c, "seq", "left").withColumns(taken).drop("mine_")


def tracked_slabs(ledger: DataFrame) -> DataFrame:
    """The ledger, oldest pins first."""
    return ledger.orderBy("pinned_at", "slab_id")


def settle(owed: DataFrame) -> DataFrame:
    """owed(id, owed array, written array) with what is still owed, in order."""
    return owed.withColumn("left", F.array_except("owed", "written"))
