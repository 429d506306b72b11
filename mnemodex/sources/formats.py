"""Byte formats: frames, a catalog log of lines; readers count what they cannot read. Vector records are in `vectors`.

Parsers run in mapInArrow over `binaryFile` rows or any frame with a binary column, a blob at a time.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The frame layout
MAGIC, VERSION = b"Mn", 1
KIND_CODES = {"memory": 1, "session": 2, "chunk": 3}


def uvarint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_uvarint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("cut off or overlong length")
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def frame(kind: str, id_: bytes, sealed: bytes) -> bytes:
    """Length, magic, version, kind, 16-byte id, sealed body."""
    body = MAGIC + bytes([VERSION, KIND_CODES[kind]]) + id_ + sealed
    return uvarint(len(body)) + body


def frame_overhead(size: int) -> int:
    return len(uvarint(20 + size)) + 20


def frames(blob: bytes) -> tuple[list[tuple[str, bytes, bytes, int]], str]:
    """The frames of a blob (kind, id, sealed, offset) up to an error, and the error or ''."""
    names, out, at = {v: k for k, v in KIND_CODES.items()}, [], 0
    while at < len(blob):
        try:
            n, start = read_uvarint(blob, at)
        except ValueError as e:
            return out, str(e)
        body = blob[start : start + n]
        if n < 20 or len(body) < n:
            return out, "cut off frame"
        if body[:2] != MAGIC or body[2] != VERSION or body[3] not in names:
            return out, "not a frame"
        out.append((names[body[3]], body[4:20], body[20:], at))
        at = start + n
    return out, ""


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ref, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found, error = frames(blob or b"")
            rows = [(ref, i, k, d.hex(), s, o, "") for i, (k, d, s, o) in enumerate(found)]
            if error:
                rows.append((ref, len(found), None, None, None, None, error))
            if rows:
                kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["ref", "pos", "kind", "id", "sealed", "offset", "error"])


def split_frames(blobs: DataFrame) -> DataFrame:
    """blobs(ref string, content binary) to (ref, pos, kind, id, sealed, offset, error); a bad blob keeps its readable prefix."""
    return blobs.select(F.col("ref").cast("string"), "content").mapInArrow(_split, "ref string, pos int, kind string, id string, sealed binary, offset long, error string")


def pack_frames(records: DataFrame) -> DataFrame:
    """records(ref, pos, kind, id hex, sealed) to one blob for each ref, frames by pos. A blob is a slab, of bounded size."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        t = table.sort_by("pos")
        blob = b"".join(frame(k, bytes.fromhex(i), s) for k, i, s in zip(*(t[c].to_pylist() for c in ("kind", "id", "sealed"))))
        return pa.table({"ref": pa.array([key[0].as_py()], pa.string()), "content": pa.array([blob], pa.binary())})

    return records.groupBy("ref").applyInArrow(run, "ref string, content binary")


def catalog_line(entry: dict) -> str:
    return base64.b64encode(json.dumps(entry, separators=(",", ":")).encode()).decode()


CATALOG = "id string, kind string, type string, version long, cid string, object_ref string, slab_id string, bytes long, tags array<string>, written_at string, deleted boolean"


def read_catalog(lines: DataFrame) -> DataFrame:
    """lines(seq, value) of base64 JSON to entries; `bad` marks unreadable ones."""
    e = F.from_json(F.try_to_binary("value", F.lit("base64")).cast("string"), CATALOG, {"mode": "PERMISSIVE"})
    return lines.select("seq", e.alias("e")).select("seq", "e.*").withColumn("bad", F.col("id").isNull()).withColumn("deleted", F.coalesce("deleted", F.lit(False)))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Newline-delimited JSON under a fixed schema; lines that do not parse stay in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
