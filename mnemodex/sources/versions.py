"""A directory of immutable versions named by a commit log: snapshot reads, appends, compaction.

Rows go through Spark's writers and readers; which parts count stands in the log.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import logs
from .commits import CommitLog


class Versioned:
    """Base and delta of a log under `root`. The newest commit names the base and the deltas that count.

    `keep` says which of the last rows a compaction keeps; appends compact when the delta has outgrown its base.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "id", order: str = "seq", keep=None):
        self.spark, self.root, self.schema, self.key, self.order, self.keep = spark, root.rstrip("/"), schema, key, order, keep
        self.log = CommitLog(spark, self.root)

    def _pointer(self) -> tuple[int, list[str]]:
        version, entry = self.log.newest()
        return version, entry.get("parts", [])

    def append(self, rows: DataFrame) -> None:
        """Add rows; of two writers at once both are kept."""
        part = f"{self.root}/part-{uuid.uuid4().hex}"
        rows.write.parquet(part)
        parts = self.log.update(lambda e: {"parts": [*e.get("parts", []), part]})["parts"]
        base, delta = self._sizes(parts)
        if logs.due_for_compaction(delta, base):
            self.compact(self.keep)

    def _bytes(self, parts: list[str]) -> int:
        """Stored bytes, from file listings: contents are not read."""
        if not parts:
            return 0
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(parts)
        return files.agg(F.sum("length")).first()[0] or 0

    def _sizes(self, parts: list[str]) -> tuple[int, int]:
        base = [p for p in parts if "/base-" in p]
        return self._bytes(base), self._bytes([p for p in parts if p not in base])

    def stats(self) -> dict[str, int]:
        """version, base_bytes and delta_bytes of the current version, bytes_written by all versions, compactions."""
        version, parts = self._pointer()
        if not version:
            return dict.fromkeys(("version", "base_bytes", "delta_bytes", "bytes_written", "compactions"), 0)
        base, delta = self._sizes(parts)
        ever = sorted({p for n in range(1, version + 1) for p in self.log.read(n)["parts"]})  # one name for each write
        return {"version": version, "base_bytes": base, "delta_bytes": delta, "bytes_written": self._bytes(ever), "compactions": sum("/base-" in p for p in ever)}

    def read(self) -> DataFrame:
        """All rows of the current version; a reader keeps its version while writers go on."""
        return self._rows(self._pointer()[1])

    def _rows(self, parts: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def state(self) -> DataFrame:
        return logs.latest(self.read(), self.key, self.order)

    def compact(self, keep=None) -> None:
        """One base with the last row of each key (and of those only what `keep` holds for), then the pointer moves: a crash before
        leaves the old version, and parts appended meanwhile stay behind the base."""
        _, old = self._pointer()
        folded = logs.latest(self._rows(old), self.key, self.order)
        folded = folded.where(keep) if keep is not None else folded
        part = f"{self.root}/base-{uuid.uuid4().hex}"
        folded.select(*self._rows([]).columns).write.parquet(part)
        # another compaction's base stands in place of parts folded here: then this one is dropped
        self.log.update(lambda e: {"parts": [part, *(p for p in e.get("parts", []) if p not in old)]} if set(old) <= set(e.get("parts", [])) else e)
