"""Operator 3, n-gram Jaccard join: a prefix tree over globally ordered shingle sets.

1. Texts with equal sets are one class, named by a BLAKE2b digest (64 bits) of the sorted set.
2. Shingles are counted over the classes. Tasks send hashes in buckets, packed; copies inside a batch
   are sent once, and a shingle that many classes of a batch hold goes to the count as one line while
   the classes keep it as "hot", so neither a hot text nor a hot shingle loads one task.
3. The global order is (count, hash), hot ones last. Shingles of a single class cannot be shared, so a
   class of too many is alone; of the rest, two that link share one of the first
   n - ceil(t n) + 1 shingles of each (prefix bound). Classes that share one are put together, as
   connected clusters, so that a set does not move for each of its prefix shingles. Two that link lie in one band of sizes or
   in neighbouring ones, so a cluster is joined band by band, and a band of many sets block by block: of a hot cluster a
   task sees some hundred sets, and sets of far sizes never meet.
4. In a cluster the ordered sets form a compressed prefix tree. Each set walks it with its overlap so
   far, computed once for all sets below a node, and leaves a subtree when even the remaining lengths
   cannot reach the needed overlap. Links leave a task as a spanning forest.

Only shared shingles move after step 2: an intersection has no others, so overlaps are exact.

Defined cases: null and empty texts, and those without words, have n_shingles 0 and stay alone; a text
of fewer words than the width has one shingle; ties and repeated rows form one class. A class is a node
by its name, never by an id: rows without an id take part like others, rows of one id with different
texts are different documents, and a component's id is its smallest non-null id (null if it has none).
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, digests, materialize, parts_for, trim, utf8
from .graph import components, forest
from .shingles import WIDTH, shingle_sets

_U = np.uint64
HOT = (1 << 31) - 1
#: Classes of one batch that make a shingle hot, and bytes of text in a batch.
HOT_IN_BATCH, BATCH_BYTES = 16, 8 << 20
#: Sets, and shingles, of a band of a cluster in one block.
BLOCK_SETS, BLOCK_SHINGLES = 384, 4 << 20
#: Parts in which a bucket's shingles are sorted.
PARTS = 8


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row numbers, hashes, sizes, class names) of bounded parts of a batch."""
    buf, off = utf8(batch.column(1))
    for p, q in chunks(off, BATCH_BYTES):
        parts, sizes = [], []
        for a, b in chunks(off[p : q + 1]):
            a, b = a + p, b + p
            g, o = shingle_sets(buf[off[a] : off[b]], off[a : b + 1] - off[a], width)
            parts.append(g)
            sizes.append(np.diff(o))
        g, n = np.concatenate(parts), np.concatenate(sizes)
        o = np.append(0, np.cumsum(n))
        sig = digests(g.view(np.uint8), 8 * o[:-1], 8 * o[1:], 8)[:, 0].astype(_U)
        yield np.arange(p, q), g, n, sig
        del parts, g, n, o, sig
        trim()


def _classes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, n, sig in _sets(batch, width):
                ids, texts = (batch.column(i).slice(rows[0], len(rows)) for i in (0, 2))
                yield pa.RecordBatch.from_arrays([ids, texts, pa.array(n), pa.array(sig.view(np.int64))], names=["doc_id", "row", "n_shingles", "sig"])

    return run


def _pieces(key: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places) for each key present; places keep their order."""
    o = np.argsort(key, kind="stable")
    cut = np.searchsorted(key[o], np.arange(n + 1))
    for k in range(n):
        if cut[k] < cut[k + 1]:
            yield k, o[cut[k] : cut[k + 1]]


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> _U(40)) % _U(n)).astype(np.int32)


_PACKED = "bucket int, kind int, hashes binary, sigs binary, counts binary"


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["bucket", "kind", "hashes", "sigs", "counts"])


def _spread(width: int, n: int):
    """Kind 0: shingles with the classes that hold them, by bucket of the shingle. Kind 1: hot shingles of
    this batch, likewise. Kind 2: classes with their hot shingles, by bucket of the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, g, size, sig in _sets(batch, width):
                _, once = np.unique(sig, return_index=True)
                use = np.zeros(len(sig), bool)
                use[once] = True
                owner = np.repeat(np.arange(len(sig), dtype=np.int32), size)
                keep = use[owner]
                g, owner = g[keep], owner[keep]
                if not len(g):
                    continue
                o = np.argsort(g)
                s = g[o]
                head = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
                count = np.diff(np.append(head, len(s)))
                hot = np.zeros(len(g), bool)
                hot[o] = np.repeat(count >= HOT_IN_BATCH, count)
                found = []
                names = s[head[count >= HOT_IN_BATCH]]
                for k, at in _pieces(_bucket(names, n), n):
                    found.append((k, 1, names[at].tobytes(), b"", b""))
                for k, at in _pieces(_bucket(sig[owner[hot]], n), n):
                    found.append((k, 2, g[hot][at].tobytes(), sig[owner[hot][at]].tobytes(), b""))
                g, owner = g[~hot], owner[~hot]
                for k, at in _pieces(_bucket(g, n), n):
                    own = owner[at]
                    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    found.append((k, 0, g[at].tobytes(), sig[own[first]].tobytes(), np.diff(np.append(first, len(own))).astype(np.uint32).tobytes()))
                if found:
                    yield _rows(found)

    return run


def _u64(col: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py() or b"", _U) for x in col] or [np.zeros(0, _U)])


def _u32(col: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py() or b"", np.uint32) for x in col] or [np.zeros(0, np.uint32)])


def _count(n: int):
    """Of one bucket of shingles: those held by two classes or more, with counts, to the classes' buckets."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        own, hot = table.filter(pc.equal(table["kind"], 0)), table.filter(pc.equal(table["kind"], 1))
        every, classes = _u64(own["hashes"]), np.repeat(_u64(own["sigs"]), _u32(own["counts"]))
        names = np.unique(_u64(hot["hashes"]))
        shared = []
        for part in range(PARTS):  # by hash, to bound what is sorted at once
            some = (every >> _U(36)) % _U(PARTS) == part
            h, sig = every[some], classes[some]
            if not len(h):
                continue
            o = np.lexsort((sig, h))
            h, sig = h[o], sig[o]
            new = np.append(True, (h[1:] != h[:-1]) | (sig[1:] != sig[:-1]))
            h, sig = h[new], sig[new]
            head = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            count = np.diff(np.append(head, len(h)))
            df = np.repeat(count, count)
            if len(names):
                at = np.minimum(np.searchsorted(names, h), len(names) - 1)
                df[names[at] == h] = HOT
            keep = df > 1
            shared.append((h[keep], sig[keep], df[keep].astype(np.uint32)))
        found = []
        if shared:
            h, sig, df = map(np.concatenate, zip(*shared))
            found = [(k, 3, h[at].tobytes(), sig[at].tobytes(), df[at].tobytes()) for k, at in _pieces(_bucket(sig, n), n)]
        passing = table.filter(pc.equal(table["kind"], 2)).select(["bucket", "kind", "hashes", "sigs", "counts"])
        out = pa.concat_tables([pa.Table.from_batches([_rows(found)]), passing]) if found else passing
        del found, shared, every, classes, table, own
        trim()
        return out

    return run


_ALIVE = "rep long, n int, lead int, hashes binary"


def need(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def _alive(percent: int):
    """Of one bucket of classes: those with enough shared shingles, their shared shingles in the global order."""

    def run(key: tuple, shared: pa.Table, reps: pa.Table) -> pa.Table:
        h, sig = _u64(shared["hashes"]), _u64(shared["sigs"])
        # kind 2 has no counts: its shingles are hot
        df = np.concatenate([np.frombuffer(c, np.uint32) if k == 3 else np.full(len(x) // 8, HOT, np.uint32) for k, c, x in zip(*(shared[c].to_pylist() for c in ("kind", "counts", "hashes")))] or [np.zeros(0, np.uint32)])
        names = reps["sig"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
        n = reps["n_shingles"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
        o = np.argsort(names)
        names, n = names[o], n[o]
        rep = names.view(np.int64)  # a class's node is its name: it is never null and no other's
        out: list[tuple] = []
        if len(h):
            o = np.lexsort((h, df, sig))
            h, df, sig = h[o], df[o], sig[o]
            new = np.append(True, (h[1:] != h[:-1]) | (sig[1:] != sig[:-1]))  # a class in several batches
            h, sig = h[new], sig[new]
            head = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            size = np.diff(np.append(head, len(sig)))
            at = np.searchsorted(names, sig[head])
            own = n[at]
            lead = own - need(own, percent) + 1 - (own - size)
            out = [(int(rep[at[i]]), int(own[i]), int(lead[i]), h[head[i] : head[i] + size[i]].tobytes()) for i in np.flatnonzero(lead > 0)]
        cols = [*zip(*out)] or [[], [], [], []]
        trim()
        return pa.table([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int32(), pa.int32(), pa.binary()])], names=["rep", "n", "lead", "hashes"])

    return run


def _stars(h: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges from all holders of a shingle to the smallest, and (shingle, smallest holder)."""
    o = np.lexsort((rep, h))
    h, rep = h[o], rep[o]
    head = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    low = np.repeat(rep[head], np.diff(np.append(head, len(h))))
    other = rep != low
    return rep[other], low[other], h[head], rep[head]


def _leads(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, lead = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            h = np.concatenate([np.frombuffer(x.as_py(), _U)[:k] for x, k in zip(batch.column(2), lead.tolist())] or [np.zeros(0, _U)])
            a, b, h, low = _stars(h, np.repeat(rep, lead))
            a, b = forest(a, b)
            found = [(k, 0, h[at].tobytes(), low[at].tobytes(), b"") for k, at in _pieces(_bucket(h, n), n)]
            if len(a):  # links inside this batch, already a forest
                found += [(k, 1, a[at].tobytes(), b[at].tobytes(), b"") for k, at in _pieces((a % n).astype(np.int32), n)]
            if found:
                yield _rows(found)

    return run


def _meet(key: tuple, table: pa.Table) -> pa.Table:
    import pyarrow.compute as pc

    own, links = table.filter(pc.equal(table["kind"], 0)), table.filter(pc.equal(table["kind"], 1))
    a, b, _, _ = _stars(_u64(own["hashes"]), _u64(own["sigs"]).view(np.int64))
    a, b = forest(np.append(a, _u64(links["hashes"]).view(np.int64)), np.append(b, _u64(links["sigs"]).view(np.int64)))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


class PrefixTree:
    """A compressed prefix tree over ordered sets, given as lists of ranks in the global order."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())  # big-endian ranks: bytes sort as the sequences do
        self.order = np.array(order)
        runs, parent, first, last, low, tall = [], [], [], [], [], []  # per node; low: smallest set below, tall: longest sequence below
        at: list[tuple[int, int]] = []  # open path: (node, depth at its end)
        self.node_of = np.zeros(len(sets), np.int64)
        pieces, flat = [], 0
        before = None
        for i in order:
            s = sets[i].astype(np.int64)
            k = 0
            if before is not None:
                m = min(len(before), len(s))
                d = np.flatnonzero(before[:m] != s[:m])
                k = int(d[0]) if len(d) else m
            while at and at[-1][1] > k:
                node, end = at.pop()
                start = at[-1][1] if at else 0
                if start < k:  # the path parts inside this node's run: its upper half becomes a node
                    up = len(parent)
                    parent.append(at[-1][0] if at else -1)
                    first.append(first[node])
                    last.append(first[node] + k - start)
                    first[node] = last[up]
                    parent[node] = up
                    at.append((up, k))
            if len(s) > k or not at:
                node = len(parent)
                parent.append(at[-1][0] if at else -1)
                pieces.append(s[k:])
                first.append(flat)
                flat += len(s) - k
                last.append(flat)
                at.append((node, len(s)))
            self.node_of[i] = at[-1][0]
            before = s
        n = len(parent)
        self.flat = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
        self.first, self.last, self.parent = np.array(first), np.array(last), np.array(parent)
        self.low, self.tall = np.full(n, 1 << 40), np.zeros(n, np.int64)
        lengths = np.array([*map(len, sets)])
        np.minimum.at(self.low, self.node_of, sizes)
        np.maximum.at(self.tall, self.node_of, lengths)
        self.depth = np.zeros(n, np.int64)
        kids: list[list[int]] = [[] for _ in range(n + 1)]
        for v, p in enumerate(parent):
            kids[p].append(v)
        level, walk = kids[n], []
        while level:
            walk.append(level)
            level = [c for v in level for c in kids[v]]
        for v in (v for lev in walk for v in lev):
            self.depth[v] = self.last[v] - self.first[v] + (self.depth[parent[v]] if parent[v] >= 0 else 0)
        for v in (v for lev in reversed(walk) for v in lev):
            if parent[v] >= 0:
                self.low[parent[v]] = min(self.low[parent[v]], self.low[v])
                self.tall[parent[v]] = max(self.tall[parent[v]], self.tall[v])
        self.roots = np.array(kids[n], np.int64)
        self.kid_first = np.cumsum([0, *map(len, kids[:n])])
        self.kids = np.array([c for k in kids[:n] for c in k], np.int64)
        ends = np.argsort(self.node_of, kind="stable")
        self.ends, self.end_first = ends, np.searchsorted(self.node_of[ends], np.arange(n + 1))

    def search(self, has: np.ndarray, size: int, shared: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(sets, overlaps) with the overlap needed; has: membership by rank of a set of `size`, `shared` of it in ranks."""
        nodes, over = self.roots, np.zeros(len(self.roots), np.int64)
        hits, counts = [], []
        while len(nodes):
            length = self.last[nodes] - self.first[nodes]
            start = np.cumsum(length) - length
            where = np.repeat(self.first[nodes] - start, length) + np.arange(int(length.sum()))
            got = np.append(0, np.cumsum(has[self.flat[where]]))
            over = over + got[start + length] - got[start]
            # what can still come: the rest of the longest set below, the rest of the query
            best = over + np.minimum(self.tall[nodes] - self.depth[nodes], shared - over)
            ok = best * (100 + percent) >= percent * (size + self.low[nodes])
            nodes, over = nodes[ok], over[ok]
            for first, table, out in ((self.end_first, self.ends, hits), (self.kid_first, self.kids, None)):
                n = first[nodes + 1] - first[nodes]
                at = np.repeat(first[nodes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                if out is not None:
                    hits.append(table[at])
                    counts.append(np.repeat(over, n))
                else:
                    nodes, over = table[at], np.repeat(over, n)
        return (np.concatenate(hits), np.concatenate(counts)) if hits else (np.zeros(0, np.int64), np.zeros(0, np.int64))


NEXT_TREE, NEXT_ASK = -1, -2


def _blocks(alive: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """(component, band, i, j, next, block, rep): which sets meet in which task, without the sets."""
    ratio = F.log(F.lit(100 / percent)) if percent < 100 else None
    band = F.floor(F.log("n") / ratio + 1e-9).cast("int") if ratio is not None else F.col("n")
    c = alive.select("rep", "n", (F.octet_length("hashes") / 8).alias("size"))
    c = c.join(clusters, c.rep == clusters.id).select("rep", "size", "component", band.alias("band"))
    t = c.groupBy("component", "band").agg(F.count("*").alias("sets"), F.sum("size").alias("size"))
    t = t.withColumn("blocks", F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int"))
    w = Window.partitionBy("component").orderBy("band")
    beside = lambda f, by: F.when(f("band").over(w) == F.col("band") + by, f("blocks").over(w)).otherwise(F.lit(0))
    t = t.select("component", "band", "sets", "blocks", beside(F.lead, 1).alias("up"), beside(F.lag, -1).alias("down"))
    c = c.drop("size").join(t, ["component", "band"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda x: x < n)
    same = F.transform(upto(F.when(F.col("sets") > 1, F.col("blocks")).otherwise(0)), lambda x: F.struct(F.col("band").alias("band"), F.least("own", x).alias("i"), F.greatest("own", x).alias("j"), F.lit(False).alias("next"), F.col("own").alias("block")))
    tree = F.transform(upto(F.col("up")), lambda x: F.struct(F.col("band").alias("band"), F.col("own").alias("i"), x.alias("j"), F.lit(True).alias("next"), F.lit(NEXT_TREE).alias("block")))
    ask = F.transform(upto(F.col("down")), lambda x: F.struct((F.col("band") - 1).alias("band"), x.alias("i"), F.col("own").alias("j"), F.lit(True).alias("next"), F.lit(NEXT_ASK).alias("block")))
    return c.select("rep", "component", F.explode(F.concat(same, tree, ask)).alias("m")).select("component", "m.*", "rep")


def _join(percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = int(key[2].as_py()), int(key[3].as_py())
        rep, n, side = (table[c].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rep", "n", "block"))
        raw = [np.frombuffer(x.as_py(), _U) for x in table["hashes"]]
        length = np.array([*map(len, raw)], np.int64)
        # ranks in an order all sets agree on: by first places in the ordered sets is not global, so by (count here, hash)
        names, inv, count = np.unique(np.concatenate(raw), return_inverse=True, return_counts=True)
        rank = np.empty(len(names), np.int64)
        rank[np.lexsort((names, count))] = np.arange(len(names))
        ranks = np.split(rank[inv], np.cumsum(length)[:-1])
        sets = [np.sort(x).astype(">u4") for x in ranks]
        # a band with itself: blocks i and j; with the next one: that one's sets ask the tree
        tree_rows, query_rows = (np.flatnonzero(side == x) for x in ((NEXT_TREE, NEXT_ASK) if (side < 0).any() else (j, i)))
        if not len(tree_rows) or not len(query_rows):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        tree = PrefixTree([sets[x] for x in tree_rows], n[tree_rows])
        has = np.zeros(len(names), bool)
        a, b = [], []
        for q in query_rows.tolist():
            own = ranks[q]
            has[own] = True
            at, over = tree.search(has, int(n[q]), int(length[q]), percent)
            has[own] = False
            other = tree_rows[at]
            ok = (over * (100 + percent) >= percent * (n[q] + n[other])) & (other != q)
            a.append(np.full(int(ok.sum()), rep[q]))
            b.append(rep[other[ok]])
            if len(a) > 4096:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                a, b = [x], [y]
        a, b = forest(np.concatenate(a), np.concatenate(b)) if a else (rep[:0], rep[:0])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, best). rows: doc_id, row (the text's hash), n_shingles, sig. classes: sig, n_shingles, component
    (its smallest sig). best: component, best (the document of the smallest id, ids before null: no_id, doc_id, row)."""
    n = parts_for(docs, text_col)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = materialize(d.withColumn("row", F.xxhash64("text")).mapInArrow(_classes(width), "doc_id long, row long, n_shingles long, sig long"))
    filled = own.where("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best")
    reps = materialize(filled.groupBy("sig").agg(first, F.max("n_shingles").alias("n_shingles")))
    # the same bucket as _bucket gives in Python
    bucket = F.pmod(F.shiftrightunsigned("sig", 40), F.lit(n)).cast("int")
    counted = d.mapInArrow(_spread(width, n), _PACKED).groupBy("bucket").applyInArrow(_count(n), _PACKED)
    left, right = counted.groupBy("bucket"), reps.select("sig", "n_shingles", bucket.alias("bucket")).groupBy("bucket")
    alive = materialize(left.cogroup(right).applyInArrow(_alive(percent), _ALIVE))
    links = materialize(alive.select("rep", "lead", "hashes").mapInArrow(_leads(n), _PACKED).groupBy("bucket").applyInArrow(_meet, "a long, b long"))
    clusters = components(links)
    # sets join their blocks by name, so a hot cluster's sets never gather
    c = _blocks(alive, clusters, percent).join(alive.select("rep", "n", "hashes"), "rep")
    found = c.groupBy("component", "band", "i", "j", "next").applyInArrow(_join(percent), "a long, b long")
    labels = components(found)
    classes = reps.join(labels, reps.sig == labels.id, "left").select("sig", "n_shingles", "best", F.coalesce("component", "sig").alias("component"))
    best = materialize(classes.groupBy("component").agg(F.min("best").alias("best")))
    return own, classes.drop("best"), best


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = 75) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    own, classes, best = _grouped(docs, id_col, text_col, width, percent)
    named = classes.join(best, "component").select(F.col("sig").alias("name"), F.col("n_shingles").alias("size"), F.col("best.doc_id").alias("component_id"))
    out = own.join(named, (own.sig == named.name) & (own.n_shingles == named["size"]), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = 75) -> DataFrame:
    """The rows to keep: one of each group, that of the smallest id, and texts without words, which are no one's copies.

    Rows that repeat an id and its text are one document; rows without an id and without words are kept each.
    """
    own, _, best = _grouped(docs, id_col, text_col, width, percent)
    alone = own.where("n_shingles = 0 and doc_id is not null").select("doc_id", "row").distinct()
    wanted = best.select("best.doc_id", "best.row").union(alone)
    # a document's key has no null, so that rows of a key meet in the join and stay together for their count; the row is one
    # column, so that no name of its own can clash
    key = lambda i, t: [F.coalesce(i, F.lit(0)).alias("k"), F.xxhash64(t, i.isNull()).alias("t")]
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("r")
    d = docs.select(row, docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col].cast("string")).alias("h"), docs[text_col].cast("string").alias("s"))
    d = d.select("r", "id", "s", *key(F.col("id"), F.col("h")))
    kept = d.join(wanted.select(*key(F.col("doc_id"), F.col("row"))), ["k", "t"], "left_semi")
    order = [F.col("r")[c] for c in docs.columns if c not in (id_col, text_col)] or [F.col("id")]
    kept = kept.withColumn("n", F.row_number().over(Window.partitionBy("k", "t").orderBy(*order))).where("n = 1").select("r")
    solid = F.translate(F.coalesce("s", F.lit("")), " \t\n\x0b\x0c\r", "") != ""
    out = kept.union(d.where(F.col("id").isNull() & ~solid).select("r"))
    return out.select(*[F.col("r")[c].alias(c) for c in docs.columns])
