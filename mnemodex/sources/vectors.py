"""A log of vectors on disk as a Spark data source: bytes of a fixed record format, read and written in whole blocks.

A record is its length, the model's name, the width, a 16-byte id, the floats and a CRC-32 of all that; one of width 0 removes the id. Records lie
in segments of bounded size. A part is what one write made: its tasks' segments, and a list of those that count, written when all tasks have
committed, so that what failed or speculative tasks left is never read. Which parts count stands in a commit log.

Files are reached through pyarrow's file systems (local and shared folders, HDFS, object stores), by tasks as well as for the list.
"""

from __future__ import annotations

import json
import struct
import threading
import uuid
import weakref
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators import logs
from .commits import CommitLog

SCHEMA = "seq int, segment int, pos long, id string, model string, dim int, vector array<float>, skipped int, lost long"
SEGMENT_BYTES = 128 << 20
BLOCK_ROWS = 4096
#: What a record has besides its name and floats, without its length; the longest one that can be.
OVERHEAD = 2 + 2 + 16 + 4
LONGEST = OVERHEAD + 65535 + 4 * 65535


def encode(batch: pa.RecordBatch) -> bytes:
    """Records of a batch (id of 32 hex digits, model, vector), a block for each name and width; no vector, or an empty one, is a removal."""
    ids, models = batch.column(0).to_pylist(), [m or "" for m in batch.column(1).to_pylist()]
    lists = batch.column(2)
    floats = lists.values.to_numpy(zero_copy_only=False).astype("<f4")
    starts = lists.offsets.to_numpy()
    dims = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, np.diff(starts))
    groups: dict[tuple[str, int], list[int]] = {}
    for i, of in enumerate(zip(models, dims.tolist())):
        groups.setdefault(of, []).append(i)
    out = []
    for (model, dim), rows in groups.items():
        name = model.encode()
        if len(name) > 65535 or dim > 65535:
            raise ValueError("a name or a vector is too long for the log")
        size = OVERHEAD + len(name) + 4 * dim
        head = struct.pack("<IH", size, len(name)) + name + struct.pack("<H", dim)
        block = np.empty((len(rows), 4 + size), np.uint8)
        at = len(head)
        block[:, :at] = np.frombuffer(head, np.uint8)
        block[:, at : at + 16] = np.frombuffer(bytes.fromhex("".join(ids[i] for i in rows)), np.uint8).reshape(len(rows), 16)
        values = floats[starts[rows][:, None] + np.arange(dim)] if dim else np.empty((len(rows), 0), "<f4")
        block[:, at + 16 : -4] = np.ascontiguousarray(values).view(np.uint8).reshape(len(rows), 4 * dim)
        block[:, -4:] = np.array([zlib.crc32(r) for r in np.ascontiguousarray(block[:, 4:-4])], "<u4").view(np.uint8).reshape(-1, 4)
        out.append(block.tobytes())
    return b"".join(out)


def _head(raw: memoryview, at: int) -> tuple[int, int, int] | None:
    """(size, name's length, width) of a record that lies whole at this place, as far as its lengths say; -1 for those of a body that contradicts its size;
    None if the length cannot be true, so that nothing tells where the next record is."""
    if len(raw) - at < 4:
        return None
    size = struct.unpack_from("<I", raw, at)[0]
    if not 0 < size <= min(LONGEST, len(raw) - at - 4):
        return None
    if size >= OVERHEAD:
        name = struct.unpack_from("<H", raw, at + 4)[0]
        if OVERHEAD + name <= size:
            dim = struct.unpack_from("<H", raw, at + 6 + name)[0]
            if size == OVERHEAD + name + 4 * dim:
                return size, name, dim
    return size, -1, -1


def _opens(raw: memoryview, at: int, size: int, name: int) -> bool:
    if name < 0 or zlib.crc32(raw[at + 4 : at + size]) != struct.unpack_from("<I", raw, at + size)[0]:
        return False
    try:
        bytes(raw[at + 6 : at + 6 + name]).decode()
    except UnicodeDecodeError:
        return False
    return True


def holds_whole_record(raw: memoryview, start: int = 0, block: int = 1 << 20) -> bool:
    """Whether a record begins at any place from `start` on. Lengths of all places of a block are compared at once; only what they allow is opened."""
    data = np.frombuffer(raw, np.uint8)
    end = len(data)
    for lo in range(start, end - 3, block):
        at = np.arange(lo, min(lo + block, end - 3))
        size = sum(data[at + i].astype(np.int64) << 8 * i for i in range(4))
        at, size = (x[(size >= OVERHEAD) & (size <= np.minimum(LONGEST, end - at - 4))] for x in (at, size))
        name = data[at + 4].astype(np.int64) | data[at + 5].astype(np.int64) << 8
        at, size, name = (x[OVERHEAD + name <= size] for x in (at, size, name))
        dim = data[at + 6 + name].astype(np.int64) | data[at + 7 + name].astype(np.int64) << 8
        fits = size == OVERHEAD + name + 4 * dim
        if any(_opens(raw, *x) for x in zip(at[fits].tolist(), size[fits].tolist(), name[fits].tolist())):
            return True
    return False


@dataclass
class Block:
    """Records of one name and width that follow one another: ids (n, 16) bytes and floats (n, width)."""

    model: str
    ids: np.ndarray
    floats: np.ndarray


@dataclass
class Damage:
    """Records stepped over, and bytes behind a length that cannot be true."""

    skipped: int = 0
    lost: int = 0


def scan(blob: bytes | memoryview, delta: bool, damage: Damage) -> Iterator[Block]:
    """The records of a blob; what cannot be read is added to `damage`.

    A record of good length that does not open is stepped over. A length that cannot be true loses the rest. At the end of a
    delta either is what an interrupted append leaves, and no damage; for a bad length, unless a whole record lies behind it.
    """
    raw, at = memoryview(blob), 0
    data = np.frombuffer(raw, np.uint8)
    while at < len(raw):
        head = _head(raw, at)
        if head is None:
            if not delta or holds_whole_record(raw, at):
                damage.lost += len(raw) - at
            return
        size, name, dim = head
        step = 4 + size
        if not _opens(raw, at, size, name):
            damage.skipped += not delta or at + step < len(raw)
            at += step
            continue
        n = min((len(raw) - at) // step, BLOCK_ROWS)
        rows = data[at : at + n * step].reshape(n, step)
        fixed = 4 + 2 + name + 2
        alike = (rows[:, :fixed] == rows[0, :fixed]).all(axis=1)
        n = n if alike.all() else int(alike.argmin())
        sums = rows[:n, -4:].copy().view("<u4").ravel()
        n = next((i for i in range(n) if zlib.crc32(raw[at + i * step + 4 : at + i * step + size]) != sums[i]), n)
        rows = rows[:n]
        floats = rows[:, fixed + 16 : -4].copy().view("<f4").reshape(n, dim)
        yield Block(bytes(raw[at + 6 : at + 6 + name]).decode(), rows[:, fixed : fixed + 16], floats)
        at += n * step


_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.float32()), pa.int32(), pa.int64()]
_NAMES = ["seq", "segment", "pos", "id", "model", "dim", "vector", "skipped", "lost"]


def _batches(seq: int, segment: int, blob: bytes | memoryview, delta: bool, vectors: bool = True) -> Iterator[pa.RecordBatch]:
    """Rows of a segment in SCHEMA; if it is damaged, one more at place -1 counts that."""
    damage, pos = Damage(), 0
    for b in scan(blob, delta, damage):
        n, dim = b.floats.shape
        hexed = pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, 32 * n + 1, 32, dtype=np.int32)), pa.py_buffer(b.ids.tobytes().hex().encode()))
        listed = pa.ListArray.from_arrays(np.arange(0, n * dim + 1, dim, dtype=np.int32) if dim else np.zeros(n + 1, np.int32), pa.array(b.floats.ravel())) if vectors else pa.nulls(n, _TYPES[6])
        same = [pa.array(np.full(n, x, np.int32)) for x in (seq, segment)]
        yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(pos, pos + n)), hexed, pa.array([b.model] * n), pa.array(np.full(n, dim, np.int32)), listed, pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int64))], names=_NAMES)
        pos += n
    if damage.skipped or damage.lost:
        row = (seq, segment, -1, None, None, None, None, damage.skipped, damage.lost)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _TYPES)], names=_NAMES)


def read_vectors(blobs: DataFrame) -> DataFrame:
    """blobs(seq, segment, content, delta boolean) to rows of SCHEMA, for blobs that come as rows; a null content has no records."""

    def run(batches):
        for batch in batches:
            for seq, segment, blob, delta in zip(*(batch.column(i) for i in range(4))):
                if blob.is_valid:
                    yield from _batches(seq.as_py(), segment.as_py(), blob.as_buffer(), bool(delta.as_py()))

    return blobs.select(F.col("seq").cast("int"), F.col("segment").cast("int"), "content", "delta").mapInArrow(run, SCHEMA)


def pack_vectors(vectors: DataFrame) -> DataFrame:
    """vectors(ref, pos, id, model, vector) to one blob for each ref, its records by pos. A blob is a segment, of bounded size."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        one = table.sort_by("pos").select(["id", "model", "vector"]).combine_chunks()
        blob = b"".join(encode(one.slice(i, 1).to_batches()[0]) for i in range(len(one)))  # a record at a time keeps their order
        return pa.table({"ref": pa.array([key[0].as_py()], pa.int64()), "content": pa.array([blob], pa.binary())})

    return vectors.select(F.col("ref").cast("long"), "pos", "id", "model", F.col("vector").cast("array<float>")).groupBy("ref").applyInArrow(run, "ref long, content binary")


# ---- the data source


def _fs(path: str):
    from pyarrow import fs

    # Hadoop writes file:/x for file:///x
    return fs.FileSystem.from_uri(f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path)


@dataclass
class Segment(InputPartition):
    path: str
    seq: int
    number: int
    delta: bool

    def __post_init__(self):
        super().__init__(self.number)


@dataclass
class Written(WriterCommitMessage):
    """Segments (name, bytes, records) of a task."""

    segments: list[tuple[str, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.parts = json.loads(options["parts"])
        self.vectors = options.get("vectors", "true") == "true"

    def partitions(self):
        found = []
        for seq, part in enumerate(self.parts):
            files, root = _fs(part)
            with files.open_input_stream(f"{root}/_segments.json") as f:
                names = [s[0] for s in json.loads(f.read())]
            found += [Segment(f"{part}/{name}", seq, n, "/base-" not in part) for n, name in enumerate(names)]
        return found or [Segment("", 0, 0, False)]

    def read(self, partition):
        if partition.path:
            files, path = _fs(partition.path)
            with files.open_input_stream(path) as f:
                yield from _batches(partition.seq, partition.number, f.read(), partition.delta, self.vectors)


class _Writer(DataSourceArrowWriter):
    """A task's rows in segments of about `segment_bytes`; names are never used twice, so a task may run again."""

    def __init__(self, options):
        self.part, self.limit = options["path"], int(options.get("segment_bytes", SEGMENT_BYTES))

    def write(self, iterator):
        files, root = _fs(self.part)
        files.create_dir(root, recursive=True)
        made: list[tuple[str, int, int]] = []
        out, name, size, rows = None, "", 0, 0
        for batch in iterator:
            step = max(1, min(BLOCK_ROWS, self.limit // (4 * 1024)))
            for lo in range(0, batch.num_rows, step):
                piece = pa.Table.from_batches([batch.slice(lo, step)]).combine_chunks().to_batches()[0]
                data = encode(piece)
                if out is not None and size + len(data) > self.limit:
                    out.close()
                    made.append((name, size, rows))
                    out = None
                if out is None:
                    name, size, rows = f"{uuid.uuid4().hex}.vec", 0, 0
                    out = files.open_output_stream(f"{root}/{name}")
                out.write(data)
                size, rows = size + len(data), rows + piece.num_rows
        if out is not None:
            out.close()
            made.append((name, size, rows))
        return Written(made)

    def commit(self, messages):
        files, root = _fs(self.part)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/_segments.json") as f:
            f.write(json.dumps([s for m in messages if m for s in m.segments]).encode())

    def abort(self, messages):
        files, root = _fs(self.part)
        for m in messages:
            for name, *_ in m.segments if m else []:
                files.delete_file(f"{root}/{name}")


class VectorSource(DataSource):
    """Options: `parts`, a JSON list of folders in the order in which they were written, to read; `vectors`, false to leave them null; `path` and `segment_bytes` to write one part."""

    @classmethod
    def name(cls):
        return "mnemodex_vectors"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


_known: weakref.WeakSet = weakref.WeakSet()
_lock = threading.Lock()


def _source(spark: SparkSession) -> str:
    """The source's name, known to the session. It is registered once, as one that is registered anew is unknown for a moment; a thread of the
    caller's looks it up in the session that is active there, so that is set."""
    SparkSession._get_j_spark_session_class(spark._jvm).setActiveSession(spark._jsparkSession)
    with _lock:
        if spark not in _known:
            spark.dataSource.register(VectorSource)
            _known.add(spark)
    return VectorSource.name()


class Reading:
    """The log as it was at one commit; writers go on meanwhile."""

    def __init__(self, spark: SparkSession, parts: list[str]):
        self.spark, self.parts = spark, parts

    def rows(self, vectors: bool = True) -> DataFrame:
        return self.spark.read.format(_source(self.spark)).option("parts", json.dumps(self.parts)).option("vectors", str(vectors).lower()).load()

    def _last(self, vectors: bool) -> DataFrame:
        kept = ["model", "dim", "vector"] if vectors else ["model", "dim"]
        order = F.struct("seq", "segment", "pos")
        folded = self.rows(vectors).where("pos >= 0").groupBy("id").agg(F.max_by(F.struct(*kept), order).alias("s"))
        return folded.select("id", "s.*")

    def state(self, vectors: bool = True) -> DataFrame:
        """(id, model, dim, vector): the last record of each id, but for removed ones; without `vectors` none is read into a row."""
        return self._last(vectors).where("dim > 0")

    def removed(self) -> DataFrame:
        """(id) whose last record is a removal."""
        return self._last(False).where("dim = 0").select("id")

    def damage(self) -> Damage:
        none = lambda c: F.coalesce(F.sum(c), F.lit(0))
        got = self.rows(False).where("pos < 0").agg(none("skipped").alias("skipped"), none("lost").alias("lost")).first()
        return Damage(got.skipped, got.lost)


class VectorLog:
    """Vectors below `root`: appends, removals, compaction into a base, and whether a rebuild is owed since damage was met."""

    def __init__(self, spark: SparkSession, root: str, segment_bytes: int = SEGMENT_BYTES):
        self.spark, self.root, self.segment_bytes = spark, root.rstrip("/"), segment_bytes
        self.log = CommitLog(spark, self.root)

    def reading(self) -> Reading:
        return Reading(self.spark, self.log.newest()[1].get("parts", []))

    def _write(self, vectors: DataFrame, kind: str) -> str:
        part = f"{self.root}/{kind}-{uuid.uuid4().hex}"
        rows = vectors.select("id", F.coalesce("model", F.lit("")).alias("model"), F.col("vector").cast("array<float>").alias("vector"))
        rows.write.format(_source(self.spark)).option("path", part).option("segment_bytes", self.segment_bytes).mode("append").save()
        return part

    def append(self, vectors: DataFrame) -> None:
        """Add vectors(id, model, vector), each id once. Of writers at once all are kept, in the order of their commits."""
        part = self._write(vectors, "delta")
        self.log.update(lambda e: {**e, "parts": [*e.get("parts", []), part]})
        if logs.due_for_compaction(*self._sizes()):
            self.compact(removals=True)

    def remove(self, ids: DataFrame) -> None:
        """Withdraw ids(id); one that the log lacks stays unknown to `state`."""
        self.append(ids.select("id").distinct().select("id", F.lit("").alias("model"), F.array().cast("array<float>").alias("vector")))

    def _sizes(self, parts: list[str] | None = None) -> tuple[int, int]:
        """(delta's, base's) bytes by the lists of segments."""
        of = {"/base-": 0, "/delta-": 0}
        for part in self.reading().parts if parts is None else parts:
            files, root = _fs(part)
            with files.open_input_stream(f"{root}/_segments.json") as f:
                of["/base-" if "/base-" in part else "/delta-"] += sum(s[1] for s in json.loads(f.read()))
        return of["/delta-"], of["/base-"]

    def compact(self, removals: bool = False) -> Damage:
        """Fold all into a new base; what was added meanwhile stays behind it. Damage ends here: since nothing on disk shows it afterwards, that a rebuild
        is owed is committed before the base is. So do removals, unless they are to stay: a rebuild passes removed ids over, so neither a compaction that an
        append makes due nor one within a rebuild takes them off."""
        now = self.reading()
        damage = self.check(now)
        base, old = self._write(now._last(True) if removals else now.state(), "base"), set(now.parts)
        # another compaction's base stands in place of parts folded here: then this one is dropped
        self.log.update(lambda e: {**e, "parts": [base, *(p for p in e.get("parts", []) if p not in old)]} if old <= set(e.get("parts", [])) else e)
        return damage

    def check(self, reading: Reading | None = None) -> Damage:
        """The damage of a reading; if there is any, a rebuild is owed from now on."""
        damage = (reading or self.reading()).damage()
        if (damage.skipped or damage.lost) and not self.owed():
            self.owe()
        return damage

    def owed(self) -> bool:
        return self.log.newest()[1].get("owed", False)

    def owe(self) -> None:
        self.log.update(lambda e: {**e, "owed": True})

    def settle(self, reading: Reading) -> bool:
        """Whether nothing is owed any more: only if no write came since the reading that found nothing left to do."""
        made = self.log.update(lambda e: {**e, "owed": False} if e.get("parts", []) == reading.parts else e)
        return not made.get("owed", False)

    def stats(self) -> dict[str, int]:
        """version, base_bytes and delta_bytes now, bytes_written by all versions, compactions."""
        version = self.log.last()
        delta, base = self._sizes()
        ever = sorted({p for n in range(1, version + 1) for p in self.log.read(n).get("parts", [])})
        return {"version": version, "base_bytes": base, "delta_bytes": delta, "bytes_written": sum(self._sizes(ever)), "compactions": sum("/base-" in p for p in ever)}
