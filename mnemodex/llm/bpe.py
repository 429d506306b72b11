"""Operator 8, byte-level BPE: corpus-level merge replay, and decoding.

The distinct pre-tokens of up to 24 MB of texts are the words of a corpus, laid out as one line of
symbols with links to the neighbours. An inverted index holds, for each pair of symbols that joins to
a token, the places where it stands, by the token's rank. Ranks are replayed in ascending order; a
merge is applied at all its places at once, leftmost first where they overlap, and only the pairs with
the touched neighbours are indexed anew. A word that is a token itself is taken whole, as the public
tiktoken library does. If a merge ever makes a pair of a lower rank than its own, which no trained
vocabulary should, that word is encoded again on its own, so results equal the library's for any ranks.

Words are told apart by their bytes. Defined cases: null and empty texts give no ids; a repeated row is encoded again alike; extra columns
are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, gather, trim, utf8
from .pretokens import CORPUS_BYTES, PATTERN, Corpus

SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: base64 token, space, rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}


class Replay:
    """Encodes corpora of distinct words under one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, size = ranks, max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for t, r in ranks.items():
            self.tokens[r] = t
        self.length = np.array([*map(len, self.tokens)], np.int32)
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.start = np.cumsum(self.length, dtype=np.int64) - self.length
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        #: Every pair of tokens that joins to a token, and that token's rank.
        self.merged = {(a, b): r for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None}
        keys = np.array([a * size + b for a, b in self.merged] or [-1], np.int64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array([*self.merged.values()] or [-1], np.int64)[order]
        self.of_bytes = np.array([[self.merged.get((a, b), -1) for b in self.byte.tolist()] for a in self.byte.tolist()], np.int32)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of joined pairs, -1 where there is none or a side is no symbol."""
        key = a.astype(np.int64) * len(self.tokens) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.values[at], -1)

    def encode(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, ids per word) of words given as bytes and sizes."""
        n_words = len(size)
        start = np.cumsum(size) - size
        raw = flat.tobytes()
        get = self.ranks.get
        whole = np.fromiter((get(raw[a : a + s], -1) for a, s in zip(start.tolist(), size.tolist())), np.int64, n_words)
        todo = np.flatnonzero(whole < 0)
        count = np.ones(n_words, np.int64)
        if not len(todo):
            return whole.astype(np.uint32), count
        # one line of symbols, a -1 before each word and at the end
        own = size[todo]
        begin = np.cumsum(own + 1) - own
        n = int(begin[-1] + own[-1] + 1)
        line = np.full(n, -1, np.int32)
        raw_line = np.zeros(n, np.uint8)
        inside = np.ones(n, bool)
        inside[begin - 1] = False
        inside[n - 1] = False
        raw_line[inside] = gather(flat, start[todo], own)
        line[inside] = self.byte[raw_line[inside]]
        right = np.arange(1, n + 1, dtype=np.int32)
        left = np.arange(-1, n - 1, dtype=np.int32)
        both = np.flatnonzero(inside[:-1] & inside[1:])
        rank = self.of_bytes[raw_line[both], raw_line[both + 1]]
        both, rank = both[rank >= 0].astype(np.int32), rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        both, rank = both[order], rank[order]
        heads = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else np.zeros(0, np.int64)
        index: list[list[np.ndarray] | None] = [None] * len(self.tokens)
        for r, a, b in zip(rank[heads].tolist(), heads.tolist(), np.append(heads[1:], len(rank)).tolist()):
            index[r] = [both[a:b]]
        again: list[np.ndarray] = []
        none = both[:0]
        length, pair_ranks = self.length, self.pair_ranks
        for r, found in enumerate(index):
            if found is None:
                continue
            index[r] = None
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            j = right[at]
            a, b = line[at], line[np.minimum(j, n - 1)]
            # the bytes from a place never change, so equal length means that this token still stands there
            ok = (a >= 0) & (b >= 0)
            ok &= length[a] + length[b] == length[r]
            if not ok.all():
                at, j = at[ok], j[ok]
                if not len(at):
                    continue
            clash = at[1:] == j[:-1]
            if clash.any():  # of overlapping places every other one counts, from the left
                run = np.append(True, ~clash)
                heads = np.flatnonzero(run)
                even = (np.arange(len(at)) - heads[np.cumsum(run) - 1]) % 2 == 0
                at, j = at[even], j[even]
            k = right[j]
            if (side := np.flatnonzero(k[:-1] == at[1:])).size:  # side by side: the left one's new pair might come first
                x = pair_ranks(np.full(len(side), r, np.int32), line[k[side]])
                again.append(at[side[(x >= 0) & (x <= r)]])
            line[at] = r
            line[j] = -2
            right[at] = k
            left[k] = at
            h = left[at]
            place = np.concatenate([h, at])
            same = np.full(len(at), r, np.int32)
            x = pair_ranks(np.concatenate([line[h], same]), np.concatenate([same, line[k]]))
            ok = x >= 0
            if not ok.any():
                continue
            place, x = place[ok], x[ok]
            if (low := x <= r).any():
                again.append(place[low])
                place, x = place[~low], x[~low]
            if len(x) > 1:
                o = np.argsort(x, kind="stable")
                place, x = place[o], x[o]
                cuts = np.flatnonzero(x[1:] != x[:-1]) + 1
                lo = [0, *cuts.tolist()]
                for y, p, q in zip(x[lo].tolist(), lo, [*lo[1:], len(x)]):
                    if index[y] is None:
                        index[y] = [none, place[p:q]]
                    else:
                        index[y].append(place[p:q])
            elif len(x):
                y = int(x[0])
                if index[y] is None:
                    index[y] = [none, place]
                else:
                    index[y].append(place)
        stays = line >= 0
        places = np.cumsum(stays)
        count[todo] = places[begin + own - 1] - places[begin - 1]
        ids = np.empty(int(count.sum()), np.uint32)
        first = np.cumsum(count) - count
        done = np.flatnonzero(whole >= 0)
        ids[first[done]] = whole[done]
        ids[np.repeat(first[todo] - (np.cumsum(count[todo]) - count[todo]), count[todo]) + np.arange(int(count[todo].sum()))] = line[stays]
        if sum(map(len, again)):
            parts = np.split(ids, first[1:])
            for w in np.unique(todo[np.searchsorted(begin, np.concatenate(again), side="right") - 1]).tolist():
                parts[w] = np.array(self.alone(raw[start[w] : start[w] + size[w]]), np.uint32)
                count[w] = len(parts[w])
            ids = np.concatenate(parts)
        return ids, count

    def alone(self, word: bytes) -> list[int]:
        """One word with a heap of its own: lowest rank first, then leftmost."""
        line = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n, rank = len(line), self.merged.get
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, line[i], line[i + 1]) for i in range(n - 1) if (r := rank((line[i], line[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if line[i] != a or j >= n or line[j] != b:
                continue
            line[i], line[j] = r, -2
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (x := rank((r, line[k]))) is not None:
                    heapq.heappush(heap, (x, i, r, line[k]))
            h = left[i]
            if h >= 0 and (x := rank((line[h], r))) is not None:
                heapq.heappush(heap, (x, h, line[h], r))
        return [x for x in line if x >= 0]


class Codec:
    """Texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.replay, self.pattern = Replay(ranks), pattern

    def encode(self, buf: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each row."""
        for a, b in chunks(off, CORPUS_BYTES):
            c = Corpus(buf[off[a] : off[b]], off[a : b + 1] - off[a], self.pattern)
            ids, count = self.replay.encode(c.flat, c.size)
            first = np.cumsum(count) - count
            c.flat = None
            for p, q in chunks(np.append(0, np.cumsum(count[c.use]))[c.firsts], 1 << 20):  # bounds the gathered pieces
                use = c.use[c.firsts[p] : c.firsts[q]]
                size = count[use]
                got = gather(ids, first[use], size)
                ends = np.append(0, np.cumsum(size))[c.firsts[p : q + 1] - c.firsts[p]].tolist()
                for x, y in zip(ends, ends[1:]):
                    yield got[x:y]

    def decode(self, ids: np.ndarray) -> bytes:
        r = self.replay
        return b"".join(gather(r.flat, r.start[part], r.length[part]).tobytes() for a in range(0, len(ids), 1 << 18) if len(part := ids[a : a + (1 << 18)]))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(ranks: bytes, pattern: str = PATTERN) -> Codec:
    """The codec of a vocabulary, made once in a process."""
    key = (hashlib.sha256(ranks).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(read_ranks(ranks), pattern)
    return _CODECS[key]


def _run(ranks, pattern: str, digests: bool):
    names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value, pattern)
        for batch in batches:
            buf, off = utf8(batch.column(1))
            out, size, done = [], 0, 0

            def flush():
                got = [pa.array(x) for x in zip(*out)]
                return pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(out)), *got], names=names)

            for ids in own.encode(buf, off):
                coded, text = ids.tobytes(), own.decode(ids)
                out.append((len(ids), hashlib.sha256(coded).hexdigest(), hashlib.sha256(text).hexdigest()) if digests else (len(ids), coded, text))
                size += 200 if digests else len(coded) + len(text)
                if size > 4 << 20:
                    yield flush()
                    done, out, size = done + len(out), [], 0
            if out:
                yield flush()
            trim()

    return run


def bpe(docs: DataFrame, ranks: bytes, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode and decode each row's whole text.

    ranks: the content of a .tiktoken file (a vocabulary has a fixed size, so it is broadcast).
    Returns ids (little-endian unsigned 32-bit) and decoded bytes, or with digests their SHA-256.
    """
    spark: SparkSession = docs.sparkSession
    cols = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return cols.mapInArrow(_run(spark.sparkContext.broadcast(ranks), pattern, digests), DIGESTS if digests else SCHEMA)
