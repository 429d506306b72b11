"""Operator 5, embedding near-dedup: sorted projection passes.

1. Equal vectors are one class with a count. Each pass hashes a class by the signs of its own random
   projections, concatenated; classes are sorted by that key, which puts near vectors side by side.
2. Each row is compared with the next `window` ones, also across partition borders. A sign sketch that goes along
   tells rows that may have a near one among them from the rest; only those ask for their vectors, in runs of the
   sorted order, and are verified there by their cosine in double precision. Verified pairs leave a task as a
   spanning forest, and are united across passes. Nothing is united that was not verified.
3. Windows are bounded, so of a large component they see few of its pairs: its links are counted in blocks of its
   vectors, whose pairs stay inside a task. A component of two vectors is counted already.

The number of passes follows the number of vectors and the limit: a pair at the limit agrees in a sign with
probability q = 1 - acos(limit) / pi and needs about log2(n / window) agreeing ones, so a pass finds it with
probability p = q**that, and ln(MISS) / ln(1 - p) passes are made; MISS is the probability that an isolated
pair at the limit is not found. How far sketches may differ follows the limit likewise.

Defined cases: null vectors, zero vectors and those with null or non-finite components link with
nothing, nor do vectors of different lengths; equal vectors link with each other; a repeated vec_id
counts as another vector, and so does each row without a vec_id. A class is a node by the digest of its vector, never by
an id; a component's id is its smallest non-null vec_id (null if it has none), and one row of a component is
kept, of that id. Extra columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digests, materialize
from .graph import components, forest

_U = np.uint64
WINDOW, BITS, SKETCH_WORDS, MISS = 64, 60, 4, 0.001
#: Vectors of a component in a block, and rows of a run that are verified together.
BLOCK, RUN = 512, 2048


def agreement(limit: float) -> float:
    """The probability that two vectors of this cosine have the same sign in a random projection."""
    return 1 - math.acos(min(1.0, max(-1.0, limit))) / math.pi


def passes_for(n: int, limit: float, window: int = WINDOW) -> int:
    """Passes after which an isolated pair at the limit, among n vectors, is missed with probability MISS at most."""
    p = agreement(limit) ** min(BITS, max(0.0, math.log2(max(n, 1) / window)))
    return 12 if p >= 1 else max(12, math.ceil(math.log(MISS) / math.log1p(-p)))


def sketch_limit(limit: float) -> int:
    """Differing sketch signs up to which a pair is compared: five standard deviations above the mean at the limit."""
    n, q = SKETCH_WORDS * 64, 1 - agreement(limit)
    return min(n, math.ceil(n * q + 5 * math.sqrt(n * q * (1 - q))))


def unit(col: pa.Array) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """(usable, unit vectors in double precision)."""
    out: list[np.ndarray | None] = []
    for x in col:
        v = None
        if x.is_valid and x.values is not None and len(x.values) and not x.values.null_count:
            v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            top = np.abs(v).max() if np.isfinite(v).all() else 0.0
            v = None if not top else v / top
            if v is not None:
                v = v / math.sqrt(float(v @ v))
        out.append(v)
    return np.array([v is not None for v in out], bool), out


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes: vec_id, sig (null if the vector cannot link), and the vector."""
    for batch in batches:
        ok, vecs = unit(batch.column(1))
        raw = [x.values.to_numpy(zero_copy_only=False).astype(np.float64).tobytes() if o else b"" for x, o in zip(batch.column(1), ok)]
        off = np.append(0, np.cumsum([*map(len, raw)]))
        h = digests(np.frombuffer(b"".join(raw), np.uint8), off[:-1], off[1:], 8)[:, 0]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h.view(np.int64), mask=~ok), batch.column(1)], names=["vec_id", "sig", "vector"])


_PLANES: dict[tuple[int, int], np.ndarray] = {}


def _planes(dim: int, n: int) -> np.ndarray:
    if (dim, n) not in _PLANES:
        _PLANES[dim, n] = np.random.Generator(np.random.PCG64(20240 + dim)).standard_normal((dim, n))
    return _PLANES[dim, n]


_SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]


def _keys(passes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SKETCH_WORDS * 64
        for batch in batches:
            ok, vecs = unit(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for dim in sorted({len(v) for v in vecs if v is not None}):
                at = np.array([i for i, v in enumerate(vecs) if v is not None and len(v) == dim])
                for a in range(0, len(at), 1024):
                    part = at[a : a + 1024]
                    signs = np.array([vecs[i] for i in part]) @ _planes(dim, own + passes * BITS) > 0
                    words = lambda s: (s.astype(_U) << np.arange(s.shape[1] - 1, -1, -1).astype(_U)).sum(1, dtype=_U).view(np.int64)
                    sketch = [words(signs[:, 64 * k : 64 * k + 64]) for k in range(SKETCH_WORDS)]
                    for p in range(passes):
                        key = words(signs[:, own + p * BITS : own + (p + 1) * BITS])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), dim * 100_000 + p)), pa.array(key), pa.array(ids[part]), *map(pa.array, sketch)], names=["pass", "key", "id", *_SKETCH])

    return run


def _runs(group: np.ndarray, sketch: list[np.ndarray], window: int, most: int) -> np.ndarray:
    """Of sorted rows, the number of the run that each is in, -1 for none: runs are rows that pairs up to `window` apart, of
    one pass and with near sketches, hold together."""
    n = len(group)
    inside = np.zeros(n + 1, np.int64)
    for w in range(1, min(window, n - 1) + 1):
        far = sum(np.bitwise_count(s[w:] ^ s[:-w]).astype(np.int64) for s in sketch)
        at = np.flatnonzero((far <= most) & (group[w:] == group[:-w]))
        inside[at] += 1
        inside[at + w] -= 1
    joined = np.cumsum(inside[:-1]) > 0  # a row and the next one
    member = joined.copy()
    member[1:] |= joined[:-1]
    start = member.copy()
    start[1:] &= ~joined[:-1]
    return np.where(member, np.cumsum(start) - 1, -1)


_MEMBERS = "run long, place long, pass long, id long"


def _windows(window: int, most: int):
    """Members of runs, by their places in the sorted order; the rows beside a partition's borders are runs of their own."""

    def emit(run, place, group, ids) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(x, len(ids)).astype(np.int64)) for x in (run, place, group, ids)], names=["run", "place", "pass", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, before, total, count = TaskContext.get().partitionId(), None, 0, 0
        heads: list[tuple] = []
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, *range(3, 3 + SKETCH_WORDS))]
            if total < window:
                heads.append((cols[0][: window - total], cols[1][: window - total]))
            total += batch.num_rows
            if before is not None:
                cols = [np.append(x, y) for x, y in zip(before, cols)]
            runs = _runs(cols[0], cols[2:], window, most)
            at = np.flatnonzero(runs >= 0)
            if len(at):
                # long runs are cut, with a window's rows in both pieces
                begin = np.searchsorted(runs[at], np.arange(runs.max() + 1))
                offset = np.arange(len(at)) - begin[runs[at]]
                piece = offset // RUN
                key = runs[at] * (1 << 20) + piece
                cut = np.unique(key, return_inverse=True)[1]
                again = np.flatnonzero((offset % RUN < window) & (piece > 0))
                twin = np.searchsorted(key[:], key[again] - 1)
                name = lambda c: ((number << 40) | (count + c)) * 2
                yield emit(name(cut), at, cols[0][at], cols[1][at])
                if len(again):
                    yield emit(name(cut[twin]), at[again], cols[0][at[again]], cols[1][at[again]])
                count += int(cut.max()) + 1
            before = [c[-window:] for c in cols]
        if total:
            first = [np.concatenate(x) for x in zip(*heads)]
            yield emit(number * 2 + 1, np.arange(len(first[0])), *first)
            yield emit(number * 2 + 3, np.arange(-len(before[0]), 0), before[0], before[1])

    return run


def _verify(limit: float, window: int):
    """Verified pairs of runs that share a bin, as a spanning forest."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        runs, place, group, ids = (table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("run", "place", "pass", "id"))
        o = np.lexsort((place, runs))
        runs, group, ids = runs[o], group[o], ids[o]
        _, vecs = unit(table["vector"].combine_chunks())
        dims, a, b = np.array([*map(len, vecs)]), [], []
        flat = np.concatenate(vecs)
        begin = (np.cumsum(dims) - dims)[o]
        dims = dims[o]
        for w in range(1, min(window, len(ids) - 1) + 1):
            at = np.flatnonzero((runs[w:] == runs[:-w]) & (group[w:] == group[:-w]))
            for d in np.unique(dims[at]).tolist():
                some = at[dims[at] == d]
                for i in range(0, len(some), 1 << 14):
                    part = some[i : i + (1 << 14)]
                    x, y = (flat[begin[p][:, None] + np.arange(d)] for p in (part, part + w))
                    hit = part[np.einsum("ij,ij->i", x, y) >= limit]
                    a.append(ids[hit])
                    b.append(ids[hit + w])
        x, y = forest(np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    return run


def _count(limit: float):
    """(a, b): members and how many vectors they link with, of all pairs of two blocks of a component; small components share a bin."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = int(key[1].as_py()), int(key[2].as_py())
        comp, ids, times, block = (table[c].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("component", "rep", "times", "block"))
        _, vecs = unit(table["vector"].combine_chunks())
        out_a, out_b = [], []
        o = np.argsort(comp, kind="stable")
        for some in np.split(o, np.flatnonzero(comp[o][1:] != comp[o][:-1]) + 1):
            p, q = some[block[some] == i], some[block[some] == j]
            m, n = (np.array([vecs[x] for x in y]) for y in (p, q))
            if not len(p) or not len(q):
                continue
            hit = m @ n.T >= limit
            if i == j:
                hit[p[:, None] == q[None, :]] = False
            out_a.append(ids[p])
            out_b.append(hit @ times[q])
            if i != j:
                out_a.append(ids[q])
                out_b.append(times[p] @ hit)
        a, b = (np.concatenate(x) if x else ids[:0] for x in (out_a, out_b))
        return pa.table({"a": pa.array(a[b > 0], pa.int64()), "b": pa.array(b[b > 0], pa.int64())})

    return run


def verified_links(reps: DataFrame, n: int, limit: float, window: int, passes: int) -> DataFrame:
    """(a, b): a spanning forest of the verified pairs of reps(sig, vector) of each task."""
    spark = reps.sparkSession
    keyed = reps.mapInArrow(_keys(passes), "pass long, key long, id long, " + ", ".join(f"{x} long" for x in _SKETCH))
    # a partition holds some windows at least, so that a border joins two of them
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n * passes // (4 * window)))
    ranged = keyed.repartitionByRange(parts, "pass", "key", "id").sortWithinPartitions("pass", "key", "id")
    members = materialize(ranged.mapInArrow(_windows(window, sketch_limit(limit)), _MEMBERS))
    full = members.join(reps.select(F.col("sig").alias("id"), "vector"), "id")
    # runs of one bin are verified by one call; a long run's pieces are apart
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, -(-n * passes // 50_000))
    return full.withColumn("bin", F.pmod(F.xxhash64("run"), F.lit(bins))).groupBy("bin").applyInArrow(_verify(limit, window), "a long, b long")


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", limit: float = 0.9, window: int = WINDOW, passes: int | None = None) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    named = v.mapInArrow(_names, "vec_id long, sig long, vector array<double>")
    own = materialize(named.select("vec_id", "sig", F.monotonically_increasing_id().alias("number")))
    filled = own.where("sig is not null")
    first = F.min(F.struct(F.col("vec_id").isNull().alias("no_id"), "vec_id", "sig", "number")).alias("best")
    classes = materialize(filled.groupBy("sig").agg(first, F.count("*").alias("times")))
    n = classes.count()
    if passes is None:
        passes = passes_for(n, limit, window)
    # the vectors of a class are equal, so any is its own
    reps = materialize(named.where("sig is not null").groupBy("sig").agg(F.first("vector").alias("vector")))
    labels = components(verified_links(reps, n, limit, window, passes))
    labels = materialize(labels.join(classes.select(F.col("sig").alias("id"), "times"), "id").select("id", "component", "times"))
    size = labels.groupBy("component").agg(F.count("*").alias("size"), F.sum("times").alias("all"))
    pairs = labels.join(size.where("size = 2"), "component").select(F.col("id").alias("a"), (F.col("all") - F.col("times")).alias("b"))
    blocks = size.where("size > 2").select("component", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    c = labels.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    c = c.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bins = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    c = c.select(F.when(F.col("blocks") > 1, F.col("component")).otherwise(F.pmod("component", F.lit(bins))).alias("bin"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "component", "block", F.col("id").alias("rep"), "times")
    c = c.join(reps, c.rep == reps.sig).select("bin", "i", "j", "component", "block", "rep", "times", "vector")
    links = pairs.union(c.groupBy("bin", "i", "j").applyInArrow(_count(limit), "a long, b long")).groupBy("a").agg(F.sum("b").alias("n"))
    labelled = classes.join(labels.select("id", "component"), classes.sig == labels.id, "left").select("sig", "times", "best", F.coalesce("component", "sig").alias("component"))
    best = materialize(labelled.groupBy("component").agg(F.min("best").alias("top")))
    named = labelled.join(best, "component").join(links, F.col("sig") == links.a, "left")
    named = named.select(F.col("sig").alias("name"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.col("top.vec_id").alias("component_id"), F.col("top.number").alias("top"))
    out = own.join(named, own.sig == named.name, "left")
    kept = F.coalesce(F.col("number") == F.col("top"), F.lit(True))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), kept.alias("kept"))
