"""Suffix arrays by linear grouping construction (Baier's published method).

Phase 1 sorts suffixes into groups by their Lyndon prefixes: groups are processed in descending order,
and the previous smaller positions of a group's members move to a next higher group, those met more
often first. Phase 2 walks the suffix array in ascending order: before each suffix it places the ones
along the previous-smaller pointers at the next free place of their groups. No names are made and
nothing is sorted recursively.
"""

from __future__ import annotations

import numpy as np


def grouping_order(text: np.ndarray) -> list[int]:
    """The suffix array of an integer sequence that ends with a unique smallest symbol."""
    n = len(text)
    # a group is a range of the array, known by its first place; at first, one for each symbol
    order = np.argsort(text, kind="stable")
    s = text[order]
    head = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    size = np.diff(np.append(head, n))
    where, first = np.empty(n, np.int64), np.empty(n, np.int64)
    where[order] = np.arange(n)
    first[order] = np.repeat(head, size)
    last = np.zeros(n, np.int64)
    last[head] = head + size - 1
    sa, place, group, end = order.tolist(), where.tolist(), first.tolist(), last.tolist()
    prev = [-1] * n  # previous smaller positions of processed suffixes
    at = n - 1
    while at > 0:
        i = sa[at]
        g = group[i]
        if g == at:  # a group of one
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                old = group[p]
                e = end[old]
                if e != old:
                    q = place[p]
                    if q != e:
                        other = sa[e]
                        sa[e], sa[q] = p, other
                        place[p], place[other] = e, q
                    end[old] = e - 1
                    group[p] = end[e] = e
            at -= 1
            continue
        met: dict[int, int] = {}
        for i in sorted(sa[g : at + 1]):  # a member to the left has its pointer already
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                met[p] = met.get(p, 0) + 1
        times: dict[int, list[int]] = {}
        for p, m in met.items():
            times.setdefault(m, []).append(p)
        for m in sorted(times, reverse=True):
            parts: dict[int, list[int]] = {}
            for p in times[m]:
                parts.setdefault(group[p], []).append(p)
            for old, moved in parts.items():
                e = end[old]
                new = e - len(moved) + 1
                if new == old:
                    continue  # the whole group moves, that is stays
                q = e
                for p in moved:
                    o = place[p]
                    if o != q:
                        other = sa[q]
                        sa[q], sa[o] = p, other
                        place[p], place[other] = q, o
                    group[p] = new
                    q -= 1
                end[old] = new - 1
                end[new] = e
        at = g - 1
    free = group[:]  # at a group's first place: the next place to fill
    for g in set(group):
        free[g] = g
    out = [-1] * n
    out[0] = n - 1
    todo = [True] * n
    todo[n - 1] = False
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and todo[j]:
            g = group[j]
            q = free[g]
            free[g] = q + 1
            out[q] = j
            todo[j] = False
            j = prev[j]
    return out


def suffix_array(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The order of all suffixes of some sequences, given one after another; none runs beyond its sequence."""
    m = len(lengths)
    ends = np.cumsum(lengths) + np.arange(m)
    n = len(symbols) + m
    inside = np.ones(n, bool)
    inside[ends] = False
    text = np.empty(n, np.int64)
    text[inside] = symbols.astype(np.int64) + m
    text[ends] = np.arange(m - 1, -1, -1)  # end symbols of their own, the last one smallest
    order = np.array(grouping_order(text), np.int64)
    order = order[inside[order]]
    return np.cumsum(inside)[order] - 1
