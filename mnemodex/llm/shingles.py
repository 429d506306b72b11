"""Distinct word shingles of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import digests, identities, layout, mix, words

_U = np.uint64
WIDTH = 5
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = np.arange(97, 123)


def word_names(distinct: pa.Array) -> np.ndarray:
    """64-bit names: of up to seven bytes the word itself, mixed, so no two are alike; of longer ones a BLAKE2b digest."""
    start, data = layout(distinct)
    size = np.diff(start)
    out = np.empty(len(size), _U)
    short = np.flatnonzero(size <= 7)
    v, at = size[short].astype(_U) << _U(56), start[:-1][short]
    for j in range(7):
        has = size[short] > j
        v[has] |= data[at[has] + j].astype(_U) << _U(8 * j)
    out[short] = mix(v)
    long = np.flatnonzero(size > 7)
    out[long] = digests(data, start[:-1][long], start[1:][long], 8)[:, 0]
    return out


def _chain(w: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Names of word sequences: each word's name goes through a mixer of its own, so no sum of them can cancel."""
    h = np.full(len(start), width * 0x9E3779B97F4A7C15 % (1 << 64), _U)
    for j in range(width):
        h += w[start + j]
        mix(h)
    return h


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each row's distinct `width`-word shingles, ascending, A-Z lower-cased.

    A row with fewer words has one shingle, its whole sequence; a row without words has none.
    """
    rows = len(off) - 1
    s, e, row = words(buf, off)
    if not len(s):
        return np.zeros(0, _U), np.zeros(rows + 1, np.int64)
    number, distinct = identities(_FOLD[buf], s, e)
    w = word_names(distinct)[number]
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n) - n
    # windows that stay inside their row; short rows have one window of all their words
    a = np.flatnonzero(np.arange(len(w)) + width <= (first + n)[row])
    g, owner = [_chain(w, a, width)], [row[a]]
    for k in range(1, width):
        short = np.flatnonzero(n == k)
        g.append(_chain(w, first[short], k))
        owner.append(short)
    g, owner = np.concatenate(g), np.concatenate(owner)
    o = np.argsort(g)
    o = o[np.argsort(owner[o], kind="stable")]
    g, owner = g[o], owner[o]
    new = np.append(True, (g[1:] != g[:-1]) | (owner[1:] != owner[:-1]))
    g, owner = g[new], owner[new]
    return g, np.append(0, np.cumsum(np.bincount(owner, minlength=rows)))
