"""Operator 1, quality rules: repetition measured on a suffix array of each text's words.

The words of many texts are sorted together, one suffix array for a chunk of whole texts. A symbol is
a word's number (words are told apart by their bytes) beside its text's, and each text ends in a symbol of
its own, so a match never leaves its text. Prefix doubling refines only groups that are still tied; the ranks kept for
each power of two give the longest common prefix of neighbours by descending the powers. A
neighbouring pair with a prefix of at least `window` words belongs to a longest-common-prefix
interval, that is a maximal repeated substring; the spans of all of them are united.

Defined cases: a null or empty text has no words (n_words 0, base_failed true). Repeated rows, equal
ids and extra columns do not matter: each row is measured alone. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, identities, utf8, words

#: The symbols counted.
SYMBOLS = "#*$%&|<>"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "longest_repeat long, base_failed boolean, kept boolean"
)


def suffix_array(first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of a symbol sequence whose end symbols are unique, and the ranks for prefixes of 1, 2, 4... symbols."""
    n = len(first)
    order = np.argsort(first, kind="stable")
    s = first[order]
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = s[1:] != s[:-1]
    rank = np.empty(n, np.int64)
    head = np.flatnonzero(new)
    rank[order] = head[np.cumsum(new) - 1]  # a group's rank is the place of its first member
    ranks, k = [rank], 1
    packed = n < 1 << 21
    size = np.diff(np.append(head, n))
    tied = np.repeat(size > 1, size)
    while tied.any():
        at = np.flatnonzero(tied)
        who = order[at]
        g, nxt = rank[who], rank[np.minimum(who + k, n - 1)]
        if packed:  # 21 bits each: one radix-friendly integer sort
            key = np.sort((g << 42) | (nxt << 21) | who)
            who, key = key & ((1 << 21) - 1), key >> 21
            same = key[1:] == key[:-1]
        else:
            o = np.lexsort((who, nxt, g))
            who, g, nxt = who[o], g[o], nxt[o]
            same = (g[1:] == g[:-1]) & (nxt[1:] == nxt[:-1])
        order[at] = who
        head = np.flatnonzero(np.append(True, ~same))
        size = np.diff(np.append(head, len(at)))
        rank = rank.copy()
        rank[who] = np.repeat(at[head], size)
        ranks.append(rank)
        tied[at] = np.repeat(size > 1, size)
        k *= 2
    return order, ranks


def common_prefix(a: np.ndarray, b: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Longest common prefixes of suffix pairs, by descending the powers of two."""
    n, out = len(ranks[0]), np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        r = ranks[level]
        i, j = a + out, b + out
        ok = (i < n) & (j < n)
        ok[ok] = r[i[ok]] == r[j[ok]]
        out[ok] += 1 << level
    return out


def repeats(symbols: np.ndarray, row: np.ndarray, rows: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: words covered by repeated substrings of at least `window` words, and the longest repeat of any length."""
    covered, longest = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    if not len(symbols):
        return covered, longest
    # an end symbol of its own after each row's words
    last = np.flatnonzero(np.append(row[1:] != row[:-1], True))
    n = len(symbols) + len(last)
    place = np.arange(len(symbols)) + np.searchsorted(last, np.arange(len(symbols)), side="left")
    seq, every = np.empty(n, np.int64), int(symbols.max()) + 1
    seq[place] = symbols + row * every
    ends = last + np.arange(len(last)) + 1
    seq[ends] = rows * every + np.arange(len(last))
    owner = np.empty(n, np.int64)
    owner[place], owner[ends] = row, row[last]
    order, ranks = suffix_array(seq)
    a, b = order[:-1], order[1:]
    near = ranks[0][a] == ranks[0][b]
    a, b = a[near], b[near]
    lcp = common_prefix(a, b, ranks)
    np.maximum.at(longest, owner[a], lcp)
    big = lcp >= window
    step = np.zeros(n + 1, np.int64)
    for who in (a[big], b[big]):
        np.add.at(step, who, 1)
        np.add.at(step, who + lcp[big], -1)
    inside = np.cumsum(step[:-1]) > 0
    np.add.at(covered, owner[inside], 1)
    return covered, longest


def measure(buf: np.ndarray, off: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    """The base figures of each text of a chunk."""
    rows = len(off) - 1
    s, e, row = words(buf, off)
    lead = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
    out = {"n_words": np.bincount(row, minlength=rows).astype(np.int64)}
    out["word_chars"] = np.bincount(row, weights=lead[e] - lead[s], minlength=rows).astype(np.int64) if len(s) else np.zeros(rows, np.int64)
    marks = np.zeros(256, bool)
    marks[list(SYMBOLS.encode())] = True
    count = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(marks[buf], out=count[1:])
    out["n_symbols"] = count[off[1:]] - count[off[:-1]]
    # lines: cut at \n and at text ends; only those with a word can count
    dup = np.zeros(rows, np.int64)
    if len(s):
        cut = np.zeros(len(buf) + 1, bool)
        cut[off] = True
        cut[np.flatnonzero(buf == 10) + 1] = True
        begin = np.flatnonzero(cut[:-1])
        stop = np.append(begin[1:], len(buf))
        stop = np.where(buf[stop - 1] == 10, stop - 1, stop)
        used = np.unique(np.searchsorted(begin, s, side="right") - 1)
        lo, hi = begin[used], stop[used]
        mine = np.searchsorted(off, lo, side="right") - 1
        line = identities(buf, lo, hi)[0] * rows + mine
        _, first = np.unique(line, return_index=True)
        again = np.ones(len(line), bool)
        again[first] = False
        dup = np.bincount(mine[again], minlength=rows).astype(np.int64)
    out["n_dup_lines"] = dup
    out["n_repeat_words"], out["longest_repeat"] = repeats(identities(buf, s, e)[0], row, rows, window)
    return out


def _verdict(m: dict[str, np.ndarray], max_covered: float, max_longest: int) -> np.ndarray:
    """Adds base_failed to the figures; the verdict."""
    n, rep = m["n_words"], m["n_repeat_words"]
    m["base_failed"] = (n < 20) | (100 * rep > 30 * n)
    return ~m["base_failed"] & (rep <= max_covered * n) & (m["longest_repeat"] <= max_longest)


def _rules(window: int, max_covered: float, max_longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (buf, off) = batch.column(0), utf8(batch.column(1))
            for a, b in chunks(off):
                m = measure(buf[off[a] : off[b]], off[a : b + 1] - off[a], window)
                m["kept"] = _verdict(m, max_covered, max_longest)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *map(pa.array, m.values())], names=["doc_id", *m])

    return run


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8, max_covered: float = 0.3, max_longest: int = 100) -> DataFrame:
    """One row per input row: the base figures, the longest repeat in words, and the verdict.

    kept needs the base to pass, repeated spans to cover at most `max_covered` of the words, and no
    repeated substring longer than `max_longest` words.
    """
    cols = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return cols.mapInArrow(_rules(window, max_covered, max_longest), SCHEMA)


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8, max_covered: float = 0.3, max_longest: int = 100) -> DataFrame:
    """The rows that the rules keep, unchanged; each is judged where it is read, without a shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(batch.column(at))
            for a, b in chunks(off):
                m = measure(buf[off[a] : off[b]], off[a : b + 1] - off[a], window)
                yield batch.slice(a, b - a).filter(pa.array(_verdict(m, max_covered, max_longest)))

    return docs.mapInArrow(run, docs.schema)
