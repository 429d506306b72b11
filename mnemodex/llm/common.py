"""Shared helpers: Arrow text access, hashing of byte ranges, shared storage."""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a Python worker; a longer single text is one chunk.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which every executor can read."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = sc._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/mnemodex-{uuid.uuid4().hex}"


def parts_for(texts: DataFrame, column: str, per: int = 48 << 20) -> int:
    """A number of buckets that follows the text: at least the shuffle's partitions, and one for each `per` bytes.

    The planner's size of the source is taken where it is known (files); else the texts are measured.
    """
    least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(texts.select(column)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # the planner's mark of an unknown size
        size = texts.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]
    return max(least, -(-size // per))


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


try:
    _LIBC = ctypes.CDLL(None)
    _LIBC.malloc_trim
except (OSError, AttributeError, TypeError):  # another C library: nothing to do
    _LIBC = None


def trim() -> None:
    """Give freed memory back, as Python workers live on after a batch and share an executor with others."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    _, off, data = col.buffers()
    off = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most `limit` bytes, or of one row."""
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values in place (public splitmix64 constants)."""
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def byte_table(seed: int = 1) -> np.ndarray:
    """A 64-bit value per byte."""
    return mix(np.arange(256, dtype=_U) * _U(_BASE) + _U(seed * 0x632BE59BD9B4E019 % (1 << 64)))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 256), base, _U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= CHUNK_BYTES + 256:
            _POWERS[base] = have
    return have[:n]


class Ranges:
    """Polynomial hashes modulo 2**64 of any ranges of a value sequence, from one prefix sum.

    Different ranges can be made to collide (Thue-Morse words do), so equal hashes never decide that bytes are equal:
    they route, they filter, and bytes or `identities` decide.
    """

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(values * _powers(_BASE, n), out=self.sums[1:])
        self.inverse = _powers(_BASE_INV, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        h += (end - start).astype(_U) * _U(0xD6E8FEB86659FD93)
        return mix(h)


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces flat[start : start + size], one after another."""
    total = int(size.sum())
    if not total:
        return flat[:0]
    before = np.cumsum(size) - size
    return flat[np.repeat(start - before, size) + np.arange(total)]


def byte_pieces(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as a binary column; without a copy where each ends where the next one starts."""
    if len(start) and (start[1:] == end[:-1]).all():
        off, data = np.append(start, end[-1]) - start[0], np.ascontiguousarray(buf[start[0] : end[-1]])
    else:
        off, data = np.append(0, np.cumsum(end - start)), gather(buf, start, end - start)
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)])


def layout(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a large binary column without nulls."""
    if not len(pieces):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = pieces.buffers()
    off = np.frombuffer(off, np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], buf[off[0] : off[-1]]


def identities(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of each byte range, the distinct ranges): equal numbers are equal bytes, compared as such by the hash table."""
    e = byte_pieces(buf, start, end).dictionary_encode()
    return e.indices.to_numpy(zero_copy_only=False).astype(np.int64), e.dictionary


def digests(buf: np.ndarray, start: np.ndarray, end: np.ndarray, size: int = 16) -> np.ndarray:
    """BLAKE2b digests of byte ranges as rows of 64-bit numbers: names that hold across tasks and cannot be made to collide."""
    view, new = memoryview(np.ascontiguousarray(buf)), hashlib.blake2b
    raw = b"".join([new(view[a:b], digest_size=size).digest() for a, b in zip(start.tolist(), end.tolist())])
    return np.frombuffer(raw, "<u8").reshape(len(start), size // 8)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word: a run of bytes other than 0x20 and 0x09-0x0D inside one row."""
    if not len(buf):
        e = np.zeros(0, np.int64)
        return e, e, e
    word = ~_SPACE[buf]
    start = word.copy()
    start[1:] &= ~word[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    start[heads] = word[heads]
    end = word.copy()
    end[:-1] &= ~word[1:]
    tails = off[1:][off[:-1] < off[1:]] - 1
    end[tails] = word[tails]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1
