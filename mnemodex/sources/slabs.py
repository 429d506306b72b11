"""Sealed blobs packed into slabs on disk, and a repack that a crash between any two steps leaves recoverable.

A slab is one blob of frames of bounded size. What is where stands in three append-only tables, of which the last row of a key
counts: objects (a frame's place in its slab), the ledger (slabs, whose they are, and whether they are written, pinned
or released) and the catalog (records and the object that holds each). Slabs are never changed; a new one has a new name.

Packing is first-fit with a bounded number of open slabs in each task, over sizes alone; payloads are shuffled once, to their slab.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from .commits import CommitLog
from .formats import frame_overhead, pack_frames, split_frames
from .versions import Versioned

OBJECTS = "ref string, seq long, slab string, pos long, bytes long, deleted boolean"
LEDGER = "slab string, seq long, origin string, state string, run string, records long, bytes long"
CATALOG = "id string, seq long, kind string, cid string, object_ref string, slab_id string, bytes long, deleted boolean"
#: Slabs that a task keeps open, and slabs' worth of blobs that it packs.
OPEN, TASK_SLABS = 16, 64


def pack(sizes: DataFrame, run: str, slab_bytes: int = C.SLAB_BYTES, open_slabs: int = OPEN) -> DataFrame:
    """(key, slab, pos) of sizes(key string, bytes): each blob's slab and its place there, by first fit among at most `open_slabs`.

    Blobs are dealt by a hash, so a task packs some slabs' worth whatever the table's size; one larger than a slab has its own.
    """
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    parts = max(1, -(-total // (slab_bytes * TASK_SLABS)))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        room: list[list] = []  # [bytes left, name, next place]
        for batch in batches:
            slabs, places = [], []
            for n in batch.column(1).to_pylist():
                need = n + frame_overhead(n)
                at = next((r for r in room if r[0] >= need), None)
                if at is None:
                    at = [slab_bytes, f"{run}-{task}-{made}", 0]
                    made += 1
                    room.append(at)
                    if len(room) > open_slabs:
                        room.remove(min(room[:-1], key=lambda r: r[0]))  # the fullest one is closed
                slabs.append(at[1])
                places.append(at[2])
                at[0] -= need
                at[2] += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slabs, pa.string()), pa.array(places, pa.int64())], names=["key", "slab", "pos"])

    rows = sizes.select(F.col("key").cast("string"), F.col("bytes").cast("long")).repartition(parts, F.xxhash64("key")).sortWithinPartitions("key")
    return rows.mapInArrow(fit, "key string, slab string, pos long")


class SlabStore:
    """Slabs and their tables below `root`. `device` names whose slabs this store may release."""

    def __init__(self, spark: SparkSession, root: str, device: str = "me", slab_bytes: int = C.SLAB_BYTES):
        self.spark, self.root, self.device, self.slab_bytes = spark, root.rstrip("/"), device, slab_bytes
        self.objects = Versioned(spark, f"{self.root}/objects", OBJECTS, "ref")
        self.ledger = Versioned(spark, f"{self.root}/ledger", LEDGER, "slab")
        self.catalog = Versioned(spark, f"{self.root}/catalog", CATALOG, "id")
        self.journal = CommitLog(spark, f"{self.root}/journal")

    def _append(self, table: Versioned, rows: DataFrame) -> None:
        """Append rows under the next sequence number; none is no append."""
        seq = (table.read().agg(F.max("seq")).first()[0] or 0) + 1
        rows = rows.withColumn("seq", F.lit(seq).cast("long")).select(*[f.split(" ")[0] for f in table.schema.split(", ")])
        if not rows.isEmpty():
            table.append(rows)

    # ---- blobs

    def upload(self, blobs: DataFrame, run: str, sizes: DataFrame | None = None) -> DataFrame:
        """Write blobs(id hex, kind, cid, payload) as slabs of `run` and return where each is: (cid, id, ref, slab, pos, bytes). Nothing is pinned yet.
        sizes(cid, id, bytes) may stand for the payloads where only their lengths count, if the blobs take long to read."""
        b = blobs.select("cid", "id", "kind", "payload")
        sizes = b.select("cid", "id", F.octet_length("payload").cast("long").alias("bytes")) if sizes is None else sizes
        placed = f"{self.root}/placed/{run}"
        sized = sizes.select(F.col("cid").alias("key"), "bytes").groupBy("key").agg(F.max("bytes").alias("bytes"))  # equal blobs are one
        pack(sized, run, self.slab_bytes).write.parquet(placed)
        place = self.spark.read.schema("key string, slab string, pos long").parquet(placed)
        one = b.groupBy("cid").agg(F.min_by(F.struct("id", "kind", "payload"), "id").alias("b"))
        frames = one.join(place, F.col("cid") == F.col("key")).select(F.col("slab").alias("ref"), "pos", "b.kind", "b.id", F.col("b.payload").alias("sealed"))
        pack_frames(frames).write.parquet(f"{self.root}/data/run={run}")
        return self._written(run, sizes)

    def pin(self, written: DataFrame, run: str, step: Callable[[str], None] = lambda _: None) -> None:
        """Make uploaded blobs retrievable, in the order that leaves no slab billed and unknown: ledger, slabs, objects."""
        slabs = written.dropDuplicates(["ref"]).groupBy("slab").agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes"))
        slabs = slabs.select("slab", F.lit(self.device).alias("origin"), F.lit(run).alias("run"), "records", "bytes")
        self._append(self.ledger, slabs.withColumn("state", F.lit("written")))
        step("ledger")
        self._append(self.ledger, slabs.withColumn("state", F.lit("pinned")))
        step("slabs")
        self._append(self.objects, written.dropDuplicates(["ref"]).select("ref", "slab", "pos", "bytes", F.lit(False).alias("deleted")))
        step("objects")

    def put(self, blobs: DataFrame, step: Callable[[str], None] = lambda _: None) -> None:
        """Write blobs(id, kind, cid, payload) and name them in the catalog; `step` is called behind each step."""
        run = uuid.uuid4().hex[:16]
        written = self.upload(blobs, run)
        step("upload")
        self.pin(written, run, step)
        named = blobs.select("id", "kind", "cid").join(written.select("id", "ref", "slab", "bytes"), "id")
        self._append(self.catalog, named.select("id", "kind", "cid", F.col("ref").alias("object_ref"), F.col("slab").alias("slab_id"), "bytes", F.lit(False).alias("deleted")))
        step("catalog")

    def _written(self, run: str, sizes: DataFrame) -> DataFrame:
        place = self.spark.read.schema("key string, slab string, pos long").parquet(f"{self.root}/placed/{run}")
        return sizes.select("cid", "id", "bytes").join(place, F.col("cid") == F.col("key")).select("cid", "id", F.concat("slab", F.lit(":"), "pos").alias("ref"), "slab", "pos", "bytes")

    def forget(self, ids: DataFrame, objects: bool = True) -> None:
        """Take records(id) out of the catalog, and their objects off the network where no live record shares them."""
        now = self.catalog.state().drop("first_seen")
        gone = now.where("not deleted").join(ids.select("id").distinct(), "id", "left_semi")
        kept = now.where("not deleted").join(ids.select("id").distinct(), "id", "left_anti").select(F.col("object_ref").alias("ref"))
        refs = gone.select(F.col("object_ref").alias("ref")).distinct().join(kept, "ref", "left_anti")
        if objects:
            self._delete(refs)
        self._append(self.catalog, gone.withColumn("deleted", F.lit(True)))

    def _delete(self, refs: DataFrame) -> None:
        here = self.objects.state().drop("first_seen").where("not deleted").join(refs.select("ref").distinct(), "ref", "left_semi")
        self._append(self.objects, here.withColumn("deleted", F.lit(True)))

    def read(self, refs: DataFrame) -> DataFrame:
        """(ref, payload) of refs(ref) that are there: only their slabs are read, each split into its frames once."""
        return self._frames(refs.select("ref").distinct(), F.col("payload"))

    def _frames(self, asked: DataFrame, what: Column) -> DataFrame:
        """Rows of asked(ref...), whose objects are there, with `what` of their payload. It is taken where a slab is split, and the other joins are
        of narrow rows, so a payload is shuffled once and a number made of it instead of it."""
        o = self.objects.state().where("not deleted").select("ref", "slab", "pos").join(asked, "ref")
        led = self.ledger.state().where("state = 'pinned'").join(o.select("slab").distinct(), "slab", "left_semi").select("slab", "run")
        runs = [r.run for r in led.select("run").distinct().collect()]  # one name for each write
        data = self.spark.read.schema("ref string, content binary, run string").parquet(f"{self.root}/data").where(F.col("run").isin(runs)) if runs else self.spark.createDataFrame([], "ref string, content binary, run string")
        data = data.join(F.broadcast(led.select(F.col("slab").alias("ref"))), "ref", "left_semi")  # a name for each slab
        f = split_frames(data).withColumnRenamed("sealed", "payload").select(F.col("ref").alias("slab"), F.col("pos").cast("long").alias("pos"), what)
        return f.join(o, ["slab", "pos"]).drop("slab", "pos")

    def live(self) -> DataFrame:
        return self.catalog.state().drop("first_seen").where("not deleted")

    # ---- repack

    def repack(self, owed: DataFrame | None = None, step: Callable[[str], None] = lambda _: None) -> dict:
        """Move all live records into as few slabs as they fit in, and release the slabs they came from; a run that a crash
        cut off is finished first. Returns figures: moved, gone, before, after, peak, released.

        The journal says how far a run has come, and each step can be done again: write and pin the new slabs; point the catalog at them
        where it still names the old object (a record forgotten or moved meanwhile stays as it is); delete the old objects; release
        the old slabs. Records whose object is gone stay where they are, with their slab; so do slabs of owed(slab), which hold
        a copy whose deletion is owed. `step` is called behind each step.
        """
        n, now = self.journal.newest()
        if not now or now["phase"] == "released":
            self.sweep()
            live = self.live().select("id", "kind", "cid", F.col("object_ref").alias("ref"), F.col("slab_id").alias("slab"))
            foreign = live.where("slab <> ''").select("slab").distinct().join(self.ledger.state().where((F.col("origin") == self.device) & (F.col("state") == "pinned")), "slab", "left_anti").count()
            if foreign:
                raise PermissionError(f"{foreign} slabs are not this device's to release")
            run = uuid.uuid4().hex[:16]
            live.write.parquet(f"{self.root}/runs/{run}/held")
            held = self._held(run)
            asked = held.select("ref", "id", "kind", "cid")
            self._frames(asked, F.octet_length("payload").cast("long").alias("bytes")).select("id", "cid", "bytes").write.parquet(f"{self.root}/runs/{run}/sizes")
            sizes = self.spark.read.schema("id string, cid string, bytes long").parquet(f"{self.root}/runs/{run}/sizes")
            self.upload(self._frames(asked, F.col("payload")), run, sizes)
            step("upload")
            moves = self._written(run, sizes).withColumnRenamed("ref", "to").withColumnRenamed("slab", "new_slab")
            held.join(moves, ["id", "cid"]).select("id", "cid", F.col("ref").alias("from"), "to", F.col("slab").alias("old_slab"), "new_slab", "pos", "bytes").write.parquet(f"{self.root}/runs/{run}/moves")
            self.pin(self._moves(run).select("cid", "id", F.col("to").alias("ref"), F.col("new_slab").alias("slab"), "pos", "bytes"), run, step)
            (owed if owed is not None else self.spark.createDataFrame([], "slab string")).select("slab").write.parquet(f"{self.root}/runs/{run}/owed")
            now = self._reach(n + 1, run, "written", step)
            n += 1
        run = now["run"]
        moves = self._moves(run)
        if now["phase"] == "written":
            still = self.live().select("id", "kind", "cid", "object_ref").join(moves.drop("cid"), "id").where(F.col("object_ref") == F.col("from"))
            self._append(self.catalog, still.select("id", "kind", "cid", F.col("to").alias("object_ref"), F.col("new_slab").alias("slab_id"), "bytes", F.lit(False).alias("deleted")))
            step("catalog")
            now, n = self._reach(n + 1, run, "relocated", step), n + 1
        if now["phase"] == "relocated":
            # what no live record names: the old objects, and new ones whose record went away meanwhile
            named = self.live().select(F.col("object_ref").alias("ref"))
            both = moves.select(F.col("from").alias("ref")).union(moves.select("to")).distinct()
            self._delete(both.join(named, "ref", "left_anti"))
            step("objects deleted")
            now, n = self._reach(n + 1, run, "deleted", step), n + 1
        held, owed = self._held(run), self.spark.read.schema("slab string").parquet(f"{self.root}/runs/{run}/owed")
        left = held.join(moves.select("id"), "id", "left_anti").select("slab")
        go = held.where("slab <> ''").select("slab").distinct().join(moves.select(F.col("new_slab").alias("slab")).union(left).union(owed).distinct(), "slab", "left_anti")
        go = go if not moves.isEmpty() else go.limit(0)
        self._append(self.ledger, self.ledger.state().drop("first_seen").where("state = 'pinned'").join(go, "slab", "left_semi").withColumn("state", F.lit("released")))
        step("slabs released")
        self._reach(n + 1, run, "released", step)
        before, new = held.where("slab <> ''").select("slab").distinct().count(), moves.select("new_slab").distinct().count()
        kept = moves.select(F.col("new_slab").alias("slab")).union(left).where("slab <> ''").distinct().count()
        return {"moved": moves.count(), "gone": held.count() - moves.count(), "before": before, "after": kept, "peak": before + new, "released": go.count()}

    def _held(self, run: str) -> DataFrame:
        return self.spark.read.schema("id string, kind string, cid string, ref string, slab string").parquet(f"{self.root}/runs/{run}/held")

    def _moves(self, run: str) -> DataFrame:
        return self.spark.read.schema("id string, cid string, `from` string, `to` string, old_slab string, new_slab string, pos long, bytes long").parquet(f"{self.root}/runs/{run}/moves")

    def _reach(self, number: int, run: str, phase: str, step) -> dict:
        entry = {"run": run, "phase": phase}
        if not self.journal.commit(number, entry):
            raise RuntimeError("another repack is under way")
        step(phase)
        return entry

    def sweep(self) -> None:
        """Release this device's slabs whose run never came to be: written or pinned, but with no object that the catalog names."""
        named = self.live().select(F.col("slab_id").alias("slab")).distinct()
        begun = self.ledger.state().drop("first_seen").where((F.col("origin") == self.device) & (F.col("state") != "released"))
        lost = begun.join(named, "slab", "left_anti")
        dead = self.objects.state().where("not deleted").join(lost.select("slab"), "slab", "left_semi").select("ref")
        self._delete(dead)
        self._append(self.ledger, lost.withColumn("state", F.lit("released")))
