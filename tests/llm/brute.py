"""Plain definitions that the operators are held against."""

import hashlib
import struct
from collections import Counter, defaultdict


def quality(text):
    t = text or ""
    w = t.encode().split()
    n, windows = len(w), Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(n - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in t.split("\n") if x.encode().split()]
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(ids, linked):
    """The smallest id reachable, for every id."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(texts):
    sets, index, links = {k: shingles(v) for k, v in texts.items()}, defaultdict(set), set()
    for k, s in sets.items():
        for g in s:
            links |= {(j, k) for j in index[g]}
            index[g].add(k)
    good = [(a, b) for a, b in links if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, groups(sets, good)


def substrings(texts, width=100):
    seen, out = set(), {}
    for k in sorted(texts):
        b = (texts[k] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if b[i : i + width] in seen:
                gone[i : i + width] = b"\1" * width
            else:
                seen.add(b[i : i + width])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[k] = len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()
    return out


def targets(sizes, share=1.5, most=2.0):
    """Water filling by repetition; sizes by source, null last."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, free = share * sum(sizes.values()), {}, set(names)
    while free:
        left, w = total - sum(out.values()), sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / w for s in free}
        out |= {s: most * sizes[s] for s in over}
        free -= over
    return out


def xx(*values):
    """Spark's xxhash64 of whole numbers (int or ("long", n)) and strings, nulls skipped; signed."""
    import xxhash

    h = 42
    for v in values:
        if v is None:
            continue
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v) if isinstance(v, int) else struct.pack("<q", v[1])
        h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


def permuted(x, n, key, rounds=16):
    long = lambda v: ("long", v)
    for r in range(rounds):
        other = (xx(long(key), r) % n - x) % n
        if xx(long(key), long(max(x, other)), r) & 1:
            x = other
    return x


def mixed(rows, block=64, seed=7):
    """Words taken of each of rows(doc_id, source, text), every slot in a plain loop; rows differ in id or text."""
    size = [len((t or "").encode().split()) for _, _, t in rows]
    of = defaultdict(int)
    for (_, s, _), n in zip(rows, size):
        of[s] += n
    target = targets(of)
    names = sorted([s for s in of if s is not None]) + ([None] if None in of else [])
    words = {s: max(1, min(block, int(min(of[s], target[s]) / 100))) for s in names}
    blocks = {s: -(-of[s] // words[s]) for s in names}
    exact = {s: target[s] * blocks[s] / of[s] if of[s] else 0 for s in names}
    quota = {s: int(exact[s] + 0.5) for s in names}
    line = [s for s in names for _ in range(quota[s])]
    drawn = defaultdict(list)
    for i in range(len(line)):
        drawn[line[xx(seed, ("long", i)) % len(line)]].append((xx(seed + 1, ("long", i)) % (1 << 64) >> 1, i))
    slots, spare = defaultdict(int), 0
    for s in names:
        slots[s] = min(len(drawn[s]), quota[s])
        spare += len(drawn[s]) - slots[s]
    assert spare == sum(quota[s] - slots[s] for s in names)
    out = [0] * len(rows)
    for s in names:
        mine = sorted((i for i, r in enumerate(rows) if r[1] == s), key=lambda i: (xx(("long", rows[i][0]), ("long", xx(rows[i][2]))) % (1 << 64) >> 1, rows[i][0]))
        owner = [i for i in mine for _ in range(size[i])]
        for j in range(quota[s]):
            turn, at = divmod(j, blocks[s])
            b = permuted(at, blocks[s], xx(seed, s, ("long", turn)))
            for i in owner[b * words[s] : (b + 1) * words[s]]:
                out[i] += 1
    return out


def token_counts(text, ranks, pattern):
    """(pre-tokens, tokens, score) by a plain dynamic program over every split of every pre-token, with its own scores."""
    import math

    import regex

    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    cost = {t: round(1000 * math.log(r + 1)) + round(1000 * total) for t, r in ranks.items()}
    out, longest = [0, 0, 0], max(map(len, cost))
    for word in regex.findall(pattern, text or ""):
        w = word.encode()
        best = [(0, 0)]
        for d in range(1, len(w) + 1):
            best.append(min((best[a][0] + cost[w[a:d]], best[a][1] + 1) for a in range(max(0, d - longest), d) if w[a:d] in cost))
        out = [out[0] + 1, out[1] + best[-1][1], out[2] - best[-1][0]]
    return tuple(out)


def boilerplate_free(rows, least=8):
    """Texts of rows(text, source) without lines on `least` sources or more; one left without a line of its own stays."""
    sites = defaultdict(set)
    for text, source in rows:
        for line in (text or "").split("\n"):
            if line.encode().split():
                sites[line].add(source)
    out = []
    for text, _ in rows:
        kept = [x for x in (text or "").split("\n") if len(sites[x]) < least]
        out.append("\n".join(kept) if text is not None and any(x.encode().split() for x in kept) else text)
    return out
