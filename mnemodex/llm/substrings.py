"""Operator 4, suffix-array dedup: bytes covered by a long substring that also starts earlier.

1. Every window of `width` bytes has an anchor, the 36-byte gram of the smallest hash in it, which depends
   on the window's bytes alone. An anchor occurrence stands for a run of window starts and for their
   bytes, its context, named by a BLAKE2b digest of 128 bits. Copies of a whole context collapse into its first
   place, in a batch at once, so a text with many copies sends one of them.
2. Contexts meet by anchor, where copies of other batches collapse too. Where an anchor has several
   contexts, their windows may agree in part: their bytes are fetched.
3. Those are suffix-sorted, but for windows that a hash shows to be met once, which cannot repeat. In the suffix
   array windows with a common prefix of `width` bytes, compared as bytes, are neighbours; all but the first of
   a run are repeats. The sorter is `lyndon.suffix_array`: linear grouping construction.
4. Each document's repeated spans are united and cut out.

So the suffix order decides wherever texts agree in part, and digests where whole contexts are copies. Hashes
that could be made to collide only route and filter. All messages are packed by bucket, whose number follows the
text's size; a bucket's contexts are sorted a few megabytes of anchors at a time. Text is shuffled once.

A document is named by two numbers, its id and a hash of its text, in that order; of messages, `docs` holds
both, one after the other.

Defined cases: null texts are empty; texts shorter than the width lose nothing; rows that repeat an id
and its text are one document, also without an id; rows of one id with different texts are different documents,
ordered by the text's hash; a null id comes last; extra columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ranges, byte_table, chunks, digests, gather, identities, materialize, parts_for, trim, utf8
from .lyndon import suffix_array
from .near import _pieces

_U = np.uint64
_TABLE = byte_table(61)
GRAM = 36
BATCH_BYTES = 8 << 20
#: Bytes of contexts whose windows are sorted at once; an anchor's contexts stay together.
SORT_BYTES = 4 << 20
_ROWS = "bucket int, kind int, names binary, docs binary, starts binary, sizes binary"
_FIELDS = [x.split(" ")[0] for x in _ROWS.split(", ")]


def _pack(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    cols = [*zip(*found)] or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=_FIELDS)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (((h.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(33)) % _U(n)).astype(np.int32)


def _flat(col: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py() or b"", kind) for x in col] or [np.zeros(0, kind)])


def _docs(col: pa.ChunkedArray) -> np.ndarray:
    return _flat(col, np.int64).reshape(-1, 2)


def _home(doc: np.ndarray, n: int) -> np.ndarray:
    """Buckets of documents."""
    return _bucket(doc[:, 0] ^ doc[:, 1], n)


def _other(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, 0] != b[:, 0]) | (a[:, 1] != b[:, 1])


def anchors(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, context digest, row, first window start, number of window starts with the anchor's offset) of each occurrence.

    Starts count from the row's; the offset from the first start stands above bit 16.
    """
    n = len(buf)
    rows = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    span = width - GRAM + 1
    if n < width:
        e = np.zeros(0, np.int64)
        return e.astype(_U), np.zeros((0, 2), _U), e, e, e
    h = Ranges(_TABLE[buf])
    at = np.arange(n - GRAM + 1)
    gram = h(at, at + GRAM)
    # smallest hash in each run of `span` grams, leftmost of equals: 32 hash bits over the place
    key = (gram & _U(0xFFFFFFFF00000000)) | at.astype(_U)
    m = len(key)
    full = np.full(-(-m // span) * span, ~_U(0), _U)
    full[:m] = key
    grid = full.reshape(-1, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - width + 1
    best = np.minimum(behind[:starts], ahead[span - 1 : span - 1 + starts])
    inside = rows[:starts] == rows[width - 1 :]
    p = np.flatnonzero(inside)
    if not len(p):
        e = np.zeros(0, np.int64)
        return e.astype(_U), np.zeros((0, 2), _U), e, e, e
    a = (best[p] & _U(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (rows[p[1:]] != rows[p[:-1]])))
    s, e = p[head], p[np.append(head[1:] - 1, len(p) - 1)]
    row = rows[s].astype(np.int64)
    return gram[a[head]], digests(buf, s, e + width), row, s - off[row], (e - s + 1) | (a[head] - s) << 16


def _scan(width: int, n: int):
    """Kind 0: the first of each context in a batch, by anchor. Kind 1: spans already known as repeats, by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(batch.column(1))
            ids = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2)])
            for p, q in chunks(off, BATCH_BYTES):
                parts = []
                for a, b in chunks(off[p : q + 1]):
                    a, b = a + p, b + p
                    g, c, row, s, k = anchors(buf[off[a] : off[b]], off[a : b + 1] - off[a], width)
                    parts.append((g, c, ids[a:b][row], s, k))
                g, c, doc, s, k = map(np.concatenate, zip(*parts))
                o = np.lexsort((s, doc[:, 1], doc[:, 0], c[:, 1], c[:, 0]))
                g, c, doc, s, k = (x[o] for x in (g, c, doc, s, k))
                new = np.append(True, _other(c[1:], c[:-1]))[: len(c)]
                again = ~new
                again &= ~np.append(False, ~_other(doc[1:], doc[:-1]) & (s[1:] == s[:-1]))[: len(c)]  # the same row twice
                found = []
                for b, at in _pieces(_home(doc[again], n), n):
                    found.append((b, 1, b"", doc[again][at].tobytes(), s[again][at].astype(np.int32).tobytes(), (k[again][at] & 0xFFFF).astype(np.int32).tobytes()))
                g, c, doc, s, k = (x[new] for x in (g, c, doc, s, k))
                for b, at in _pieces(_bucket(g, n), n):
                    at = at[np.lexsort((doc[at, 1], doc[at, 0]))]
                    found.append((b, 0, g[at].tobytes() + c[at].tobytes(), doc[at].tobytes(), s[at].astype(np.int32).tobytes(), k[at].astype(np.uint32).tobytes()))
                if found:
                    yield _pack(found)
                del parts, g, c, doc, s, k, o, found
                trim()

    return run


def _meet(n: int):
    """Of one bucket of anchors. Kind 1: repeats of whole contexts, by document. Kind 2: contexts whose bytes are needed, by document."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        own = table.filter(pc.equal(table["kind"], 0))
        passing = table.filter(pc.equal(table["kind"], 1)).select(_FIELDS)
        if not own.num_rows:
            return passing
        names = [np.frombuffer(x.as_py(), _U) for x in own["names"]]
        g = np.concatenate([x[: len(x) // 3] for x in names])
        c = np.concatenate([x[len(x) // 3 :] for x in names]).reshape(-1, 2)
        doc, s, k = _docs(own["docs"]), _flat(own["starts"], np.int32).astype(np.int64), _flat(own["sizes"], np.int32)
        o = np.argsort(g, kind="stable")
        same = g[o][1:] == g[o][:-1]
        o = o[np.append(False, same) | np.append(same, False)]  # anchors met once need nothing
        if not len(o):
            return passing
        o = o[np.lexsort((s[o], doc[o, 1], doc[o, 0], c[o, 1], c[o, 0], g[o]))]
        g, c, doc, s, k = (x[o] for x in (g, c, doc, s, k))
        head = np.append(True, _other(c[1:], c[:-1]) | (g[1:] != g[:-1]))
        first = np.flatnonzero(head)[np.cumsum(head) - 1]
        again = ~head & (_other(doc, doc[first]) | (s != s[first]))
        found = [(b, 1, b"", doc[again][at].tobytes(), s[again][at].astype(np.int32).tobytes(), (k[again][at] & 0xFFFF).tobytes()) for b, at in _pieces(_home(doc[again], n), n)]
        g, doc, s, k = (x[head] for x in (g, doc, s, k))
        same = g[1:] == g[:-1]
        many = np.append(False, same) | np.append(same, False)
        g, doc, s, k = (x[many] for x in (g, doc, s, k))
        found += [(b, 2, g[at].tobytes(), doc[at].tobytes(), s[at].astype(np.int32).tobytes(), k[at].tobytes()) for b, at in _pieces(_home(doc, n), n)]
        out = pa.concat_tables([pa.Table.from_batches([_pack(found)]), passing]) if found else passing
        del found, own, names, table
        trim()
        return out

    return run


def _by_document(kind: int):
    """Of one bucket of documents: a row for each, its starts and sizes (and names), ordered."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        doc, s, k = _docs(table["docs"]), _flat(table["starts"], np.int32), _flat(table["sizes"], np.int32)
        g = _flat(table["names"], _U)
        o = np.lexsort((s, doc[:, 1], doc[:, 0]))
        doc, s, k = doc[o], s[o], k[o]
        g = g[o] if len(g) else g
        head = np.flatnonzero(np.append(True, _other(doc[1:], doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
        ends = np.append(head[1:], len(doc))
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(head.tolist(), ends.tolist())], pa.binary())
        return pa.table({"id": pa.array(doc[head, 0], pa.int64()), "row_": pa.array(doc[head, 1], pa.int64()), "names": cut(g), "starts": cut(s), "sizes": cut(k)})

    return run


_DOC_ROWS = "id long, row_ long, names binary, starts binary, sizes binary"


def _fetch(width: int, n: int):
    """Contexts with their bytes, by anchor: names, docs, starts, sizes, and the bytes one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(batch.column(2).is_valid())
            if not some.num_rows:
                continue
            buf, off = utf8(some.column(1))
            ids = np.column_stack([some.column(i).to_numpy(zero_copy_only=False) for i in (0, 5)])
            for a, b in chunks(off, BATCH_BYTES):
                g, s, k = (_flat(pa.chunked_array([some.column(i).slice(a, b - a)]), t) for i, t in ((2, _U), (3, np.int32), (4, np.int32)))
                count = np.array([len(x.as_py()) // 4 for x in some.column(3).slice(a, b - a)])
                row = np.repeat(np.arange(a, b), count)
                at, size = off[row] + s, (k & 0xFFFF).astype(np.int64) + width - 1
                found = []
                for x, i in _pieces(_bucket(g, n), n):
                    found.append((x, 3, g[i].tobytes(), ids[row[i]].tobytes(), s[i].tobytes(), k[i].tobytes(), gather(buf, at[i], size[i]).tobytes()))
                kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=[*_FIELDS, "bytes"])

    return run


def repeated_windows(doc: np.ndarray, s: np.ndarray, k: np.ndarray, data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, window start) of the windows of these contexts that also start earlier.

    Fragments with windows met twice, by hash, are candidates; equal fragments are sorted once, under their
    first place. The suffix array of the distinct fragments decides. In it the anchor's gram, which all
    windows of a fragment hold, is one symbol. data holds the contexts one after another.
    """
    lead, k = k >> 16, k & 0xFFFF
    size = k.astype(np.int64) + width - 1
    base = np.cumsum(size) - size
    at = np.repeat(base - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))  # all windows' places in data
    ctx = np.repeat(np.arange(len(k)), k)
    h = Ranges(_TABLE[data])
    _, inv, count = np.unique(h(at, at + width), return_inverse=True, return_counts=True)
    hit = count[inv] > 1
    at, ctx = at[hit], ctx[hit]
    if not len(at):
        return doc[:0], s[:0]
    head = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (ctx[1:] != ctx[:-1])))
    lo, n_win = at[head], np.diff(np.append(head, len(at)))
    owner = ctx[head]
    where = s[owner].astype(np.int64) + lo - base[owner]
    name = identities(data, lo, lo + n_win + width - 1)[0]
    o = np.lexsort((where, doc[owner, 1], doc[owner, 0], name))
    lo, n_win, owner, where, name = (x[o] for x in (lo, n_win, owner, where, name))
    new = np.append(True, name[1:] != name[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    # later places of an equal fragment are repeats in all their windows
    again = ~new & (_other(doc[owner], doc[owner[first]]) | (where != where[first]))
    out_doc, out_at = [np.repeat(doc[owner[again]], n_win[again], axis=0)], [gather(np.arange(int(where.max()) + int(n_win.max()) + 1), where[again], n_win[again])]
    lo, n_win, owner, where = (x[new] for x in (lo, n_win, owner, where))
    length = n_win + width - 1
    text = gather(data, lo, length).astype(np.int64)
    begin = np.cumsum(length) - length
    anchor = base[owner] + lead[owner]  # of each fragment, in data
    gram = begin + anchor - lo
    drop = np.zeros(len(text) + 1, np.int32)
    drop[gram + 1] += 1
    drop[gram + GRAM] -= 1
    text[gram] = 256 + identities(data, anchor, anchor + GRAM)[0]
    length = length - (GRAM - 1)
    order = suffix_array(text[np.cumsum(drop[:-1]) == 0], length)
    start = np.cumsum(length) - length
    frag = np.repeat(np.arange(len(length)), length)[order]
    off = order - start[frag]
    whole = off < n_win[frag]  # a window begins here, before the gram or with it
    off, frag = off[whole], frag[whole]
    d, w, at = doc[owner[frag]], where[frag] + off, lo[frag] + off
    # windows with a common prefix of `width` bytes are neighbours in the order
    view = np.lib.stride_tricks.sliding_window_view(data, width)
    same = np.zeros(len(at) - 1, bool)
    for i in range(0, len(same), 1 << 14):
        same[i : i + (1 << 14)] = (view[at[:-1][i : i + (1 << 14)]] == view[at[1:][i : i + (1 << 14)]]).all(1)
    group = np.cumsum(np.append(True, ~same))
    o = np.lexsort((w, d[:, 1], d[:, 0], group))
    d, w, group = d[o], w[o], group[o]
    head = np.append(True, group[1:] != group[:-1])
    f = np.flatnonzero(head)[np.cumsum(head) - 1]
    late = ~head & (_other(d, d[f]) | (w != w[f]))
    return np.concatenate([*out_doc, d[late]]), np.concatenate([*out_at, w[late]])


def _resolve(width: int, n: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        g, s, k, data = (_flat(table[c], t) for c, t in (("names", _U), ("starts", np.int32), ("sizes", np.int32), ("bytes", np.uint8)))
        doc = _docs(table["docs"])
        del table
        size = (k & 0xFFFF).astype(np.int64) + width - 1
        base = np.cumsum(size) - size
        o = np.argsort(g, kind="stable")
        ends = np.flatnonzero(np.append(g[o][1:] != g[o][:-1], True)) + 1 if len(o) else o
        total = np.append(0, np.cumsum(size[o]))
        found, a = [], 0
        while a < len(o):
            i = min(int(np.searchsorted(ends, np.searchsorted(total, total[a] + SORT_BYTES))), len(ends) - 1)
            some = o[a : ends[i]]
            found.append(repeated_windows(doc[some], s[some], k[some], gather(data, base[some], size[some]), width))
            a = int(ends[i])
        trim()
        d, w = (np.concatenate(x) for x in zip(*found)) if found else (doc, s)
        o = np.lexsort((w, d[:, 1], d[:, 0]))
        d, w = d[o], w[o]
        if not len(d):
            return pa.Table.from_batches([_pack([])])
        head = np.flatnonzero(np.append(True, (w[1:] > w[:-1] + 1) | _other(d[1:], d[:-1])))
        last = np.append(head[1:] - 1, len(d) - 1)
        d, a, k = d[head], w[head], w[last] - w[head] + 1
        return pa.Table.from_batches([_pack([(b, 1, b"", d[i].tobytes(), a[i].astype(np.int32).tobytes(), k[i].astype(np.int32).tobytes()) for b, i in _pieces(_home(d, n), n)])])

    return run


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(batch.column(1))
            out, size, done = [], 0, 0
            for i in range(batch.num_rows):
                text = buf[off[i] : off[i + 1]]
                if batch.column(2)[i].is_valid:
                    s, k = (np.frombuffer(batch.column(c)[i].as_py(), np.int32).astype(np.int64) for c in (2, 3))
                    step = np.zeros(len(text) + 1, np.int32)
                    np.add.at(step, np.minimum(s, len(text)), 1)
                    np.add.at(step, np.minimum(s + k + width - 1, len(text)), -1)
                    gone = np.cumsum(step[:-1]) > 0
                    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    kept = text[~gone].tobytes()
                else:
                    spans, kept = 0, text.tobytes()
                out.append((len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
                size += len(kept)
                if size > 4 << 20 or i == batch.num_rows - 1:
                    cols = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()])]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(out)), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
                    done, out, size = i + 1, [], 0

    return run


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    last = (1 << 63) - 1
    n = parts_for(docs, text_col)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    h = F.shiftrightunsigned(F.xxhash64("text"), 1)  # below 0 with an id, so that a null one is behind every other
    d = d.select(F.coalesce("doc_id", F.lit(last)).alias("doc_id"), "text", F.when(F.col("doc_id").isNull(), h).otherwise(-1 - h).alias("row"))
    met = materialize(d.mapInArrow(_scan(width, n), _ROWS).groupBy("bucket").applyInArrow(_meet(n), _ROWS))
    wanted = met.where("kind = 2").groupBy("bucket").applyInArrow(_by_document(2), _DOC_ROWS)
    # both joins keep all documents, so that their exchange of texts is one and the same
    asked = d.join(wanted, (d.doc_id == wanted.id) & (d.row == wanted.row_), "left").select("doc_id", "text", "names", "starts", "sizes", "row")
    parts = asked.mapInArrow(_fetch(width, n), _ROWS + ", bytes binary").groupBy("bucket").applyInArrow(_resolve(width, n), _ROWS)
    spans = met.where("kind = 1").union(parts).groupBy("bucket").applyInArrow(_by_document(1), _DOC_ROWS)
    full = d.join(spans, (d.doc_id == spans.id) & (d.row == spans.row_), "left").select(F.when(F.col("row") < 0, F.col("doc_id")).alias("doc_id"), "text", "starts", "sizes")
    return full.mapInArrow(_cut(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def dedup_substrings(docs: DataFrame, **how) -> DataFrame:
    """The digests of `cut_repeats`, without the bytes."""
    return cut_repeats(docs, **how).drop("kept")
