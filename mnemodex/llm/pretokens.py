"""Pre-tokens of many texts at once, and the distinct ones among them.

The public byte-level pattern is applied with array operations on code points; any other pattern goes
through the regex module. Tokens are told apart by their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex

from .common import byte_pieces, chunks, layout

#: Fixed value: the public byte-level pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_KINDS: list[np.ndarray] = []
#: Bytes of text whose distinct pre-tokens form one corpus.
CORPUS_BYTES = 24 << 20


def _kinds() -> np.ndarray:
    """1 letter, 2 number, 3 white space, 0 other, by code point."""
    if not _KINDS:
        every = np.arange(0x110000, dtype=np.uint32)
        every[0xD800:0xE000] = 0  # surrogates do not occur in UTF-8
        text = every.astype("<u4").tobytes().decode("utf-32-le")
        kind = np.zeros(0x110000, np.uint8)
        for k, p in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
            for m in regex.finditer(p, text):
                kind[m.start() : m.end()] = k
        kind[0xD800:0xE000] = 0
        _KINDS.append(kind)
    return _KINDS[0]


def split(buf: np.ndarray, off: np.ndarray, pattern: str = PATTERN) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all pre-tokens (each ends where the next starts, as the pattern leaves no gaps), and the first token of each row."""
    if pattern != PATTERN:
        starts, first = [np.zeros(0, np.int64)], [0]
        rx = regex.compile(pattern)
        for a, b in zip(off[:-1], off[1:]):
            sizes = [len(x.encode()) for x in rx.findall(bytes(buf[a:b]).decode())]
            if sum(sizes) != b - a:
                raise ValueError("the pattern leaves gaps")
            starts.append(a + np.cumsum([0, *sizes[:-1]]).astype(np.int64) if sizes else np.zeros(0, np.int64))
            first.append(first[-1] + len(sizes))
        return np.concatenate(starts), np.array(first)
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    cp = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    n = len(cp)
    kind = _kinds()[cp]
    head = np.zeros(n + 1, bool)
    head[np.searchsorted(at, off)] = True
    head[n] = True
    run = head[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(run)
    ends = np.append(runs[1:], n)
    space = kind[runs] == 3
    st = np.zeros(n + 1, bool)
    st[runs[space]] = True
    inner = ends[space]
    st[inner[~head[inner]] - 1] = True  # the last white space before other text stands alone or leads it
    solid = runs[~space]
    led = np.zeros(len(solid), bool)
    prior = solid > 0
    led[prior] = (cp[solid[prior] - 1] == 32) & ~head[solid[prior]]
    st[solid[~led]] = True
    # contractions: an apostrophe that starts a token, alone in its run, before a letter
    mark = solid[~led]
    mark = mark[cp[mark] == 39]
    mark = mark[(mark + 1 < n)]
    mark = mark[(kind[mark + 1] == 1) & ~head[mark + 1]]
    if len(mark):
        a = cp[mark + 1]
        two = mark + 2 < n
        b = np.where(two, cp[np.minimum(mark + 2, n - 1)], 0)
        b[two & head[np.minimum(mark + 2, n)]] = 0
        size = np.where(np.isin(a, [ord(x) for x in "stmd"]), 1, 0)
        for x, y in ("re", "ve", "ll"):
            size[(a == ord(x)) & (b == ord(y))] = 2
        mark, size = mark[size > 0], size[size > 0]
        st[mark + 1] = False
        st[mark + 1 + size] = True
    starts = at[np.flatnonzero(st[:n])]
    return starts, np.searchsorted(starts, off)


class Corpus:
    """Some whole texts: their distinct pre-tokens, and each text as indices of them."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, pattern: str = PATTERN):
        seen, uses, self.firsts = [pa.array([], pa.large_binary())], [], [0]
        for a, b in chunks(off):
            part, o = buf[off[a] : off[b]], off[a : b + 1] - off[a]
            starts, first = split(part, o, pattern)
            if len(starts):  # tokens leave no gaps
                e = byte_pieces(part, starts, np.append(starts[1:], len(part))).dictionary_encode()
                uses.append(e.indices.to_numpy(zero_copy_only=False).astype(np.int64) + sum(map(len, seen)))
                seen.append(e.dictionary)
            self.firsts.extend((self.firsts[-1] + first[1:]).tolist())
        e = pa.concat_arrays(seen).dictionary_encode()
        at, self.flat = layout(e.dictionary)
        self.size = np.diff(at)  # bytes of each distinct token
        back = e.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.use = back[np.concatenate(uses)] if uses else np.zeros(0, np.int64)
        self.firsts = np.array(self.firsts)  # of each text, in use
