"""What a device holds of a vault, as tables below one folder, and the two jobs that put it right: restoring from stored objects, and
rebuilding the vector index after damage.

Both take what reaches outside as functions over frames: `open_` makes bodies of sealed bytes, `embed` makes (id, vector) of (id, text). Each step
appends rows of which the last of a key counts, so a job that was cut off is run again from its start and ends the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import heads, storage, stored
from .formats import split_frames
from .shared import written
from .vectors import Reading, VectorLog
from .versions import Versioned

# Rounds of a rebuild
ROUNDS = 3

CATALOG = "id string, seq long, kind string, type string, version long, tags array<string>, object_ref string, slab_id string, bytes long, written_at long, deleted boolean"
LEDGER = "slab_id string, seq long, origin string, records long, bytes long"
BODIES = "id string, seq long, kind string, body string"
RANKING = "id string, seq long, kind string, type string, version long, tags array<string>, written_at long"
HEADS = "id string, seq long, title string, messages long, chunks long, bytes long, created long, updated long"
#: What is read of the body of a memory, and of a chunk. `parts` stays JSON.
MEMORY = "statement string, context string"
CHUNK = "session string, seq long, messages array<struct<id string, role string, parts string, created long, model string, tokens_in long, tokens_out long, memory_refs array<string>>>"
#: Places of a chunk's messages in their conversation; a chunk has fewer.
CHUNK_PLACES = 1 << 20

Embed = Callable[[DataFrame], DataFrame]


class Device:
    """Tables below `root`: catalog, ledger, bodies, ranking rows, heads and vectors. Vectors are of `model`."""

    def __init__(self, spark: SparkSession, root: str, model: str):
        self.spark, self.root, self.model = spark, root.rstrip("/"), model
        self.catalog = Versioned(spark, f"{self.root}/catalog", CATALOG, "id")
        self.ledger = Versioned(spark, f"{self.root}/ledger", LEDGER, "slab_id")
        self.bodies = Versioned(spark, f"{self.root}/bodies", BODIES, "id")
        self.ranking = Versioned(spark, f"{self.root}/ranking", RANKING, "id")
        self.heads = Versioned(spark, f"{self.root}/heads", HEADS, "id")
        self.vectors = VectorLog(spark, f"{self.root}/vectors")

    def _append(self, table: Versioned, rows: DataFrame) -> None:
        """Append rows under the next sequence number."""
        seq = (table.read().agg(F.max("seq")).first()[0] or 0) + 1
        table.append(rows.withColumn("seq", F.lit(seq).cast("long")).select(*[f.split(" ")[0] for f in table.schema.split(", ")]))

    def forget(self, ids: DataFrame) -> None:
        """Mark ids(id) as no longer held; the catalog remembers that."""
        gone = self.catalog.state().drop("first_seen").where("not deleted").join(ids.select("id").distinct(), "id", "left_semi")
        self._append(self.catalog, gone.withColumn("deleted", F.lit(True)))

    def held(self) -> DataFrame:
        """(id, kind, listed, head, body, catalogued, text) of every record that any table names; text, what is embedded, is null where the
        stored body does not open."""
        on = lambda d, name, *more: d.select("id", F.lit(True).alias(name), *more)
        memory = F.from_json("body", MEMORY)
        said = F.concat_ws("\n", "m_.statement", F.nullif("m_.context", F.lit("")))
        bodies = self.bodies.state().where("kind = 'memory'").withColumn("m_", memory)
        b = on(bodies, "body", F.when(F.col("m_.statement").isNotNull(), said).alias("text_b"))
        h = on(self.heads.state(), "head", F.col("title").alias("text_h"))
        r = on(self.ranking.state(), "listed", "kind")
        c = on(self.catalog.state().where("not deleted"), "catalogued")
        j = r.join(b, "id", "full").join(h, "id", "full").join(c, "id", "full")
        no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
        return j.select("id", "kind", no("listed"), no("head"), no("body"), no("catalogued"), F.when(F.col("kind") == "session", F.col("text_h")).otherwise(F.col("text_b")).alias("text"))

    # ---- restore

    def restore(self, objects: DataFrame, open_: Callable[[Column], Column], depth: str = "metadata", embed: Embed | None = None) -> dict:
        """Take up objects(ref, slab, updated_at, content): the frames of each that open, as far as `depth` says.

        `catalog` names them and adopts their slabs; `metadata` also stores bodies, ranking rows and the heads rebuilt from chunks; `index` also
        embeds memories and heads. Frames that do not open are another vault's; records that this device forgot stay forgotten, and
        their slab is not adopted for them. A body that does not parse or names another record is a `problem` and not stored. Returns counters.

        A slab's records and bytes are counted from the catalog, so that a restore may run again; one that this device pinned stays its own.
        """
        if depth not in storage.DEPTHS:
            raise ValueError(f"depth {depth!r} is not one of {', '.join(storage.DEPTHS)}")
        if depth == "index" and embed is None:
            raise ValueError("an embedder is needed to restore the index")
        blobs = objects.select(F.col("ref").cast("string"), F.col("slab").alias("slab_"), F.col("updated_at").alias("at_"))
        f = written(split_frames(objects.select("ref", "content")).join(blobs, "ref").withColumn("body", open_(F.col("sealed"))))
        found = f.where("error = ''").select("ref", F.col("slab_").alias("slab"), "id", "kind", F.octet_length("sealed").cast("long").alias("bytes"), F.col("at_").alias("updated_at"), "body", F.col("body").isNotNull().alias("opened"))
        forgotten = written(self.catalog.state().where("deleted").select("id"))
        plan = storage.restore_plan(found.withColumn("opened_", F.col("body")), forgotten, depth)
        entries = written(stored.catalog_entries(plan.where("catalogued").withColumn("body", F.col("opened_"))))
        good = entries.where("problem is null").drop("problem").withColumn("deleted", F.lit(False))
        self._append(self.catalog, good)
        on_slabs = self.catalog.state().where("not deleted").join(good.select("slab_id").distinct().where("slab_id <> ''"), "slab_id", "left_semi")
        counted = on_slabs.groupBy("slab_id").agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes"))
        mine = self.ledger.state().where("origin = 'pinned'").select("slab_id", F.lit("pinned").alias("was"))
        self._append(self.ledger, counted.join(mine, "slab_id", "left").withColumn("origin", F.coalesce("was", F.lit("hydrated"))))
        made = {"heads": 0, "embedded": 0, "unembeddable": 0}
        if depth != "catalog":
            kept = plan.where("body").join(good.select("id", F.col("object_ref").alias("ref")), ["id", "ref"], "left_semi").select("id", "kind", F.col("opened_").alias("body"))
            self._append(self.bodies, kept)
            self._append(self.ranking, good.where("kind <> 'chunk'"))
            made["heads"] = self.rebuild_heads()
        if depth == "index":
            # only what this restore brought and what has no vector yet: a second run embeds nothing anew
            ids = good.where("kind <> 'chunk'").select("id").union(self.heads.state().select("id")).distinct()
            none = ids.join(self.vectors.reading().state(vectors=False), "id", "left_anti")
            done = self._embed(none, embed)
            made |= {k: done[k] for k in ("embedded", "unembeddable")}
        bad = entries.where("problem is not null").select("id", F.col("object_ref").alias("ref"), F.lit(True).alias("bad_"))
        counted = plan.join(bad, ["id", "ref"], "left").withColumns({c: F.col(c) & F.col("bad_").isNull() for c in ("catalogued", "body", "embedded")})
        seen = {"objects": objects.select("ref").count(), "damaged": f.where("error <> ''").count(), "problems": bad.count()}
        return {**storage.restore_report(counted.drop("opened_")).first().asDict(), **seen, **made}

    def rebuild_heads(self) -> int:
        """Heads of the conversations whose chunks are held, made of them; returns how many."""
        c = self.bodies.state().where("kind = 'chunk'").select("body", F.from_json("body", CHUNK).alias("c")).select("c.*", F.octet_length("body").cast("long").alias("bytes")).where("session is not null")
        m = c.select("session", "seq", F.posexplode("messages").alias("n", "m")).select("session", (F.col("seq") * CHUNK_PLACES + F.col("n")).alias("pos"), "m.*")
        none = self.spark.createDataFrame([], "session string, id string")
        h = heads.rebuild_heads(m, c.select("session", "seq", "bytes"), none)
        rows = written(h.select(F.col("session").alias("id"), "title", *[F.col(x).cast("long").alias(x) for x in ("messages", "chunks", "bytes", "created", "updated")]))
        self._append(self.heads, rows)
        ranked = rows.select("id", F.lit("session").alias("kind"), F.lit(None).cast("string").alias("type"), F.lit(1).cast("long").alias("version"), F.array().cast("array<string>").alias("tags"), F.col("updated").alias("written_at"))
        self._append(self.ranking, ranked)
        return rows.count()

    # ---- rebuild of the index

    def _embed(self, ids: DataFrame, embed: Embed) -> dict[str, int]:
        """Give records(id) vectors from their texts. What is held is read again when the model is done, so that a record forgotten meanwhile
        gets none. Returns counts, and the refused ids as `refused`."""
        whole = lambda d: d.where("listed and (kind = 'session' and head or kind = 'memory' and body)").select("id", "kind", F.col("text").isNotNull().alias("readable"), "text")
        asked = written(ids.join(self.held(), "id").select("id", "kind"))
        before = whole(self.held()).join(asked.select("id"), "id", "left_semi")
        made = embed(before.where("readable").select("id", "text")).select("id", F.col("vector").cast("array<float>").alias("vector"))
        vectors = written(before.drop("text").join(made, "id", "left"))
        out = written(stored.embed_outcomes(asked, vectors, whole(self.held()).drop("text")))
        done = out.where("outcome = 'written'").select("id", F.lit(self.model).alias("model"), "vector")
        counts = {r.outcome: r["count"] for r in out.groupBy("outcome").count().collect()}
        if counts.get("written"):
            self.vectors.append(done)
        return {"embedded": counts.get("written", 0), "unembeddable": counts.get("unembeddable", 0), "refused": out.where("outcome = 'unembeddable'").select("id")}

    def _plan(self, reading: Reading, passed: DataFrame) -> DataFrame:
        """(id, action) left to do by a reading of the index, and then of what is held; records in passed(id) are not embedded."""
        over = passed.select("id").distinct().withColumn("pass_over", F.lit(True))
        # a record of which only the text cannot be read is still held, and embedding it fails
        there = F.expr("kind = 'session' and head or kind = 'memory' and body")
        r = self.held().withColumn("text", F.when(there, "held")).join(over, "id", "left")
        return storage.index_repair(r.withColumn("pass_over", F.coalesce("pass_over", F.lit(False))), reading.state(vectors=False))

    def repair_index(self, embed: Embed) -> dict:
        """If a rebuild is owed: drop vectors of what is not held, take damage off the disk, embed what is held whole and has no vector, read again, and
        so on until a reading finds nothing left, three rounds at most. Returns counters; `unfinished` if something was left, then it stays owed.

        Removed ids are passed over, as a removal is a forget that may not be finished; so are ids that the model refused. A record
        forgotten while it was embedded gets no vector.
        """
        v = self.vectors
        found = v.check()
        report = {"ran": v.owed(), "rounds": 0, "dropped": 0, "embedded": 0, "failed": 0, "skipped": found.skipped, "lost": found.lost, "unfinished": False}
        passed = self.spark.createDataFrame([], "id string")
        while report["ran"] and report["rounds"] < ROUNDS:
            report["rounds"] += 1
            now = v.reading()
            passed = passed.union(written(now.removed()))
            plan = written(self._plan(now, passed))
            drop = plan.where("action = 'drop'")
            if n := drop.count():
                v.remove(drop)
                report["dropped"] += n
            damage = v.check(now)
            if damage.skipped or damage.lost:
                v.compact(removals=True)
            missing = plan.where("action = 'embed'").select("id")
            if not missing.isEmpty():
                made = self._embed(missing, embed)
                passed = passed.union(made["refused"])
                report["embedded"] += made["embedded"]
                report["failed"] += made["unembeddable"]
            last = v.reading()
            passed = passed.union(written(last.removed()))
            damage = last.damage()
            if not damage.skipped and not damage.lost and self._plan(last, passed).isEmpty() and v.settle(last):
                return report
        report["unfinished"] = report["ran"]
        return report
