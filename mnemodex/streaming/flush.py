"""Micro-batches: the flush queue as Structured Streaming.

Offsets and the checkpoint take the place of claims and leases. Sinks are idempotent by batch, so a
replayed batch writes the same folder again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import constants as C
from ..sources.commits import CommitLog
from ..sources.slabs import SlabStore

OUT = "key string, reason string, records long, bytes long, at long"


def idle_windows(queue: DataFrame, key: str = "key", time: str = "queued_at", gap: str = f"{C.IDLE_SECONDS} seconds", late: str = "10 minutes") -> DataFrame:
    """Runs of a key without an idle gap: an idle flush ends each. Works on batch and streaming frames alike."""
    q = queue.withWatermark(time, late) if queue.isStreaming else queue
    w = F.session_window(time, gap)
    return q.groupBy(key, w).agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes")).select(key, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("idle_at"), "records", "bytes")


class FlushPolicy(StatefulProcessor):
    """Counts a key's queued records and bytes and flushes by `storage.due`: at the record or byte limit when a record comes, when the oldest
    is too old, or when none has come for a while. The nearer of these two moments is the key's timer.

    With a time column, time is that of the records: a moment that a record finds behind it was due before the record came, so the
    decisions are those of the records in order of time, however they fall into batches. Without one it is the clock.
    """

    def __init__(self, max_records: int = C.MAX_RECORDS, max_bytes: int = C.SLAB_BYTES, max_age: int = C.MAX_AGE_SECONDS, idle: int = C.IDLE_SECONDS, time: str | None = None):
        self.limits, self.age, self.idle, self.time = (max_records, max_bytes), max_age * 1000, idle * 1000, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("queue", "records long, bytes long, oldest long, newest long")

    def _held(self) -> tuple[int, int, int, int]:
        return tuple(self.state.get()) if self.state.exists() else (0, 0, 0, 0)

    def _due(self, oldest: int, newest: int) -> tuple[int, str]:
        """When these records are due if none comes, and why."""
        age, idle = oldest + self.age, newest + self.idle
        return (age, "age") if age <= idle else (idle, "idle")

    def _keep(self, held: tuple[int, int, int, int]) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if held[0]:
            self.state.update(held)
            self.handle.registerTimer(self._due(*held[2:])[0])
        else:
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        came = pd.concat(list(rows))
        if self.time:
            came = came.sort_values([self.time, "bytes"], kind="stable")
            times = came[self.time].astype("datetime64[ms]").astype("int64").tolist()
        else:
            times = [timerValues.getCurrentProcessingTimeInMs()] * len(came)
        records, size, oldest, newest = self._held()
        out = []
        for at, n in zip(times, came["bytes"].tolist()):
            if records:
                at = max(at, newest)
                moment, reason = self._due(oldest, newest)
                if at >= moment:
                    out.append((key[0], reason, records, size, moment))
                    records = size = 0
            oldest = at if not records else oldest
            records, size, newest = records + 1, size + int(n), at
            if records >= self.limits[0] or size >= self.limits[1]:
                out.append((key[0], "records" if records >= self.limits[0] else "bytes", records, size, at))
                records = size = 0
        self._keep((records, size, oldest, newest))
        if out:
            yield self._frame(out)

    @staticmethod
    def _frame(rows):
        import pandas as pd

        return pd.DataFrame(rows, columns=["key", "reason", "records", "bytes", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        records, size, oldest, newest = self._held()
        moment, reason = self._due(oldest, newest)
        if records and expiredTimerInfo.getExpiryTimeInMs() >= moment:
            self._keep((0, 0, 0, 0))
            yield self._frame([(key[0], reason, records, size, moment)])

    def close(self) -> None:
        pass


def flush_decisions(queue: DataFrame, time: str | None = None, late: str = "0 seconds", **limits) -> DataFrame:
    """queue(key string, bytes long) as a stream to (key, reason, records, bytes, at: milliseconds) of due flushes. Needs the RocksDB state store.

    With the name of a time column decisions follow it, and one that no record brings about is out when the watermark has passed it.
    """
    columns = ["key", "bytes", *([time] if time else [])]
    queue = queue.select(*columns).withWatermark(time, late) if time else queue.select(*columns)
    return queue.groupBy("key").transformWithStateInPandas(FlushPolicy(**limits, time=time), OUT, "Append", "EventTime" if time else "ProcessingTime")


def slab_sink(store: SlabStore, step: Callable[[str], None] = lambda _: None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of batches(record_id hex, seq, kind, cid, payload) into slabs, of which the last write of an id counts.

    A batch is uploaded, its slabs enter the ledger, are pinned, its objects are pinned, the catalog names them, and the batch is
    committed, in this order. A batch that failed between two steps is replayed: what it left behind is released, what the catalog names
    already is not written again, and a committed batch does nothing. So offsets stand for claims: a failure gives the records back.
    """
    journal = CommitLog(store.spark, f"{store.root}/flushed")

    def write(batch: DataFrame, number: int) -> None:
        n, last = journal.newest()
        if n and last["batch"] >= number:
            return
        staged = f"{store.root}/staged/batch-{number}-{uuid.uuid4().hex}"
        batch.groupBy("record_id").agg(F.max_by(F.struct("kind", "cid", "payload"), "seq").alias("s")).select(F.col("record_id").alias("id"), "s.*").write.parquet(staged)
        store.sweep()
        rows = store.spark.read.schema("id string, kind string, cid string, payload binary").parquet(staged)
        rows = rows.join(store.live().select("id", "cid"), ["id", "cid"], "left_anti").select("id", "kind", "cid", "payload")
        if not rows.isEmpty():
            store.put(rows, step)
        if not journal.commit(n + 1, {"batch": number}):
            raise RuntimeError("another stream flushes into this store")
        step("committed")

    return write


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: one folder per batch, overwritten on a replay; the last write of an id in a batch counts."""

    def write(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != "record_id"]
        batch.groupBy("record_id").agg(F.max_by(F.struct(*rest), "seq").alias("s")).select("record_id", "s.*").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def flush_stream(queue: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Start the flush of a queue stream into `path`; without `every` what is there is taken and the stream ends."""
    w = queue.writeStream.foreachBatch(batch_writer(path)).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def dedup_feed(events: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark, of a streamed change feed."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
