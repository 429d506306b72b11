"""Operator 9, WARC: a converter from legacy ARC archives.

`arc_archive` writes ARC bytes of either version (URL records with five or ten header fields behind a
version block that names them); `arc_records` parses them by the version's header line and declared
lengths; `to_warc` synthesises the equivalent WARC record: identifier, ISO timestamp, type, target,
payload digest. Each archive begins with a warcinfo record. A revisit names the response by its record id, target and
date, as the standard's profile asks; the page's number is an extension field of the WARC header, and the HTTP response
is as it was. `warc_records` reads WARC bytes by declared lengths. Archives are rows of a table of
binary contents in the shared folder, so any store that Spark writes can hold them.

Among records of equal payload the one with the smallest page_id is the response and the others revisit
it; a group's first page is a partially aggregated minimum, and decisions join by page, so a payload that
a third of all pages share loads no single task.

Defined cases: a null html is an empty payload, a null url an empty one (`-` in the archives); rows that repeat both page_id
and payload are records of the same type and id, that is one record written again; a null page_id is never the first of a
group unless alone in having none, and then has no first: such records are responses. Extra columns are left out. An
empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

READ = "page_id long, url string, warc_date string, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Bytes of payload in one archive.
ARCHIVE_BYTES = 4 << 20
#: The header fields of each ARC version.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def target(url: str | None) -> str:
    """A URL without blanks or control characters, as both formats hold it."""
    return quote(url or "-", safe="!#$%&'()*+,/:;=?@[]~")


def record_id(page: int | None, url: str, sha: str) -> str:
    """The identifier of a page's record: a revisit can name a response of another archive."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {sha} {url}')}>"


def arc_archive(name: str, version: int, date: str, rows: list[tuple[str | None, bytes]]) -> bytes:
    """ARC bytes: a version block, then a URL record of an HTTP response for each (url, payload)."""

    def line(url: str, kind: str, body: bytes, offset: int, sum_: str = "-") -> bytes:
        own = [url, "0.0.0.0", date, kind, *(["200", sum_, "-", str(offset), name] if version == 2 else []), str(len(body))]
        return " ".join(own).encode() + b"\n"

    about = f"{version} 0 mnemodex\n{FIELDS[version]}\n".encode()
    out = [line(f"filedesc://{name}", "text/plain", about, 0), about, b"\n"]
    at = sum(map(len, out))
    for url, payload in rows:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n%s" % (len(payload), payload)
        head = line(target(url), "text/html", body, at, digest(payload))
        out += [head, body, b"\n"]
        at += len(head) + len(body) + 1
    return b"".join(out)


def arc_records(data: bytes) -> Iterator[dict]:
    """The URL records of ARC bytes, by their version's header fields and declared lengths."""
    at, fields = 0, FIELDS[1].split(" ")
    while at < len(data):
        end = data.index(b"\n", at)
        head = data[at:end].decode().split(" ")
        size = int(head[-1])
        body = data[end + 1 : end + 1 + size]
        if len(body) < size:
            raise ValueError("the archive ends inside a record")
        if head[0].startswith("filedesc://"):
            named = body.decode().split("\n")
            version = int(named[0].split(" ")[0])
            if named[1] != FIELDS.get(version):
                raise ValueError(f"unknown ARC version: {named[:2]}")
            fields = named[1].split(" ")
        else:
            if len(head) != len(fields):
                raise ValueError(f"{len(head)} header fields instead of {len(fields)}")
            yield dict(zip(fields, head)) | {"at": at, "body": body}
        at = end + 1 + size + 1


def _warc(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.0\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def _iso(date: str) -> str:
    """The ISO form of an ARC date of 14 digits."""
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def warc_info(name: str, date: str) -> bytes:
    block = f"software: mnemodex\r\nformat: WARC File Format 1.0\r\nisPartOf: {name}\r\n".encode()
    return _warc([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", _iso(date)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def to_warc(rec: dict, page: int | None = None, first: tuple[int, str] | None = None) -> bytes:
    """The WARC record equivalent to an ARC record; with first, the response's (page, target), a revisit without payload."""
    cut = rec["body"].index(b"\r\n\r\n") + 4
    sha, date = digest(rec["body"][cut:]), _iso(rec["Archive-date"])
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(page, rec["URL"], sha)), ("WARC-Date", date), ("WARC-Target-URI", rec["URL"]), ("WARC-IP-Address", rec["IP-address"]),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha}"),
    ]
    if page is not None:
        fields.append(("X-Page-Id", str(page)))
    if first is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(*first, sha)), ("WARC-Refers-To-Target-URI", first[1]), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page", str(first[0]))]
    return _warc(fields, rec["body"] if first is None else rec["body"][:cut])


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of WARC bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        head = dict(x.split(": ", 1) for x in lines)
        size = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _convert(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            rows, size = [], 0
            last = batch.num_rows - 1
            for i in range(batch.num_rows):
                page, url, html, ref, there = (batch.column(c)[i].as_py() for c in range(5))
                payload = (html or "").encode()
                rows.append((page, url, payload, None if ref is None else (ref, target(there))))
                size += len(payload)
                if size < ARCHIVE_BYTES and i < last:
                    continue
                label = hashlib.sha1(repr([(x[0], x[1], digest(x[2])) for x in rows]).encode()).hexdigest()[:16]
                name, version = f"{label}.arc", 1 + number % 2
                arc = arc_archive(name, version, date, [x[1:3] for x in rows])
                warc = warc_info(f"{label}.warc", date) + b"".join(to_warc(rec, x[0], x[3]) for rec, x in zip(arc_records(arc), rows))
                yield pa.RecordBatch.from_arrays([pa.array([f"{label}.warc"]), pa.array([version], pa.int32()), pa.array([warc], pa.binary())], names=["archive", "arc_version", "content"])
                number, rows, size = number + 1, [], 0

    return run


def convert_pages(pages: DataFrame, date: str = "20240101000000", min_bytes: int = 0) -> DataFrame:
    """Archives (archive, arc_version, content): each page passes an ARC archive and becomes a WARC record."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = p.select("page_id", "url", F.unhex(F.sha1("html")).alias("sha"), F.octet_length("html").alias("size")).where(F.col("size") >= min_bytes)
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")
    firsts = keyed.groupBy("sha").agg(first, F.count("*").alias("n")).where("n > 1 and first is not null").select("sha", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("there"))
    again = keyed.select(F.col("page_id").alias("again_id"), "sha").distinct().join(firsts, "sha").where("again_id <> refers_to or again_id is null")
    full = p.withColumn("own", F.unhex(F.sha1("html")))
    out = full.join(again, full.page_id.eqNullSafe(F.col("again_id")) & (full.own == again.sha), "left")
    return out.select("page_id", "url", "html", "refers_to", "there").mapInArrow(_convert(date), "archive string, arc_version int, content binary")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for head, block in warc_records(content.as_py()):
                if head["WARC-Type"] == "warcinfo":
                    continue
                lines, payload = block.split(b"\r\n\r\n", 1)
                http = dict(x.split(": ", 1) for x in lines.decode().split("\r\n")[1:])
                kind, page, ref = head["WARC-Type"], head.get("X-Page-Id"), head.get("X-Refers-To-Page")
                if kind == "response":
                    size, check = len(payload), digest(payload)
                    if head["WARC-Payload-Digest"] != f"sha1:{check}":
                        raise ValueError("a payload does not match its digest")
                else:
                    size, check = int(http["Content-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Refers-To"] != record_id(int(ref), head["WARC-Refers-To-Target-URI"], check):
                        raise ValueError("a revisit does not name the response of its payload")
                rows.append((None if page is None else int(page), head["WARC-Target-URI"], head["WARC-Date"], head["WARC-Record-ID"], size, check, kind, None if ref is None else int(ref)))
            if not rows:
                continue
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split(" ")[0] for x in READ.split(", ")])


def read_warc(archives: DataFrame) -> DataFrame:
    """One row per WARC record of the archives' contents."""
    return archives.select("content").mapInArrow(_parse, READ)


def write_and_read(pages: DataFrame, **how) -> DataFrame:
    """Archives written to the shared folder and read back."""
    return read_warc(materialize(convert_pages(pages, **how)))
