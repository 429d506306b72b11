"""Operators 11 to 13 against plain definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("mnemodex.llm")
from mnemodex.llm import fim, resample, sharding  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, words=200):
    r = random.Random(seed)
    return " ".join(r.choice(["Alpha", "beta", "naïve", "Straße", "7th", "x"]) + str(r.randrange(words)) for _ in range(n))


def awkward():
    """(doc_id, text): nulls, empty, ties, repeated rows and ids, long texts, marks, odd characters."""
    texts = [(i, prose(i, 10 + 7 * i)) for i in range(20)]
    texts += [(20, None), (21, ""), (22, " \n\t"), (None, prose(1, 30)), (None, prose(2, 25)), (None, None), (3, prose(3, 31)), (3, prose(40, 40)), (3, prose(40, 40))]
    texts += [(30, "İSTANBUL Ünï 中文字 😀😀 ÀÉ " * 10), (31, "a" * 300_000), (32, "7!" * 150_000), (33, prose(9, 60_000)), (34, "some <P> mark " * 9), (35, "<S>"), (36, "cut < here S> <M " * 8), (37, "é"), (38, "ab"), (39, "-")]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(awkward())]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("number", "pos", "word", "feature", "bucket", "gain", "weight", "place", "row_", "output", "n", "shard", "Slot", "number_", "size_")}).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def features(text, first, last):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in range(first, last + 1) for i in range(len(w) - k + 1)]


def resampled(rows, target, first=1, last=1, buckets=10_000, percent=10):
    """Counter of (doc_id, n_features, weight, score, rank); rows that tie in all may change places."""
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    mine = [(i, *features(t, first, last)) for i, t in rows]
    s = Counter(bucket(x) for _, _, f in mine for x in f)
    t = Counter(bucket(x) for text in target for x in features(text, first, last)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    scored = []
    for i, n, f in mine:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        scored.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in scored if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = fit[: percent * len(fit) // 100]
    out = Counter((r[0], *r[2:], k + 1) for k, r in enumerate(drawn))
    out.update((r[0], *r[2:], None) for r in [*fit[len(drawn) :], *(r for r in scored if r[1] < 20)])
    return out


@pytest.mark.parametrize("first,last,buckets,percent", [(1, 1, 10_000, 10), (1, 3, 997, 50), (2, 2, 64, 100)])
def test_resampling(spark, docs, first, last, buckets, percent):
    target = [prose(5, 80), None, "", prose(50, 30).upper()]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    got = resample.resample(docs, t, first=first, last=last, buckets=buckets, percent=percent)
    assert Counter(tuple(r) for r in got.drop("n_words").collect()) == resampled(awkward(), target, first, last, buckets, percent)


def test_resampling_of_no_rows(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(empty(spark), none).count() == 0
    assert Counter(tuple(r) for r in resample.resample(docs, none).drop("n_words").collect()) == resampled(awkward(), [])


def test_copies_draw_apart(spark):
    """A third of all rows are one text: ranks follow their ids' numbers, none is lost."""
    rows = [(i, prose(1, 25)) for i in range(400)] + [(i, prose(i, 30)) for i in range(400, 1200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    target = [prose(1, 25)]
    got = resample.resample(d, spark.createDataFrame([(t,) for t in target], "text string"))
    assert Counter(tuple(r) for r in got.drop("n_words").collect()) == resampled(rows, target)


def test_fisher_yates_is_uniform():
    assert sharding.fisher_yates(0, 1, 1).tolist() == [] and sharding.fisher_yates(1, 1, 1).tolist() == [0]
    seen = Counter(tuple(sharding.fisher_yates(4, 3, b)) for b in range(24_000))
    assert len(seen) == 24 and all(800 < n < 1200 for n in seen.values())
    assert (sharding.fisher_yates(50, 3, 7) == sharding.fisher_yates(50, 3, 7)).all()
    for n in (5, 33):  # the plain loop, from the last place down
        order, draw = list(range(n)), np.random.Generator(np.random.PCG64([9, 2])).integers(0, np.arange(n, 1, -1))
        for i in range(n - 1, 0, -1):
            j = int(draw[n - 1 - i])
            order[i], order[j] = order[j], order[i]
        assert sharding.fisher_yates(n, 9, 2).tolist() == order


@pytest.mark.parametrize("shards,buckets", [(16, None), (3, 7), (64, 2)])
def test_sharding(docs, shards, buckets):
    out = sharding.write_shards(docs, shards, buckets=buckets)
    assert sorted(out.columns) == sorted([*(c for c in docs.columns if c not in ("shard", "Slot")), "slot", "shard"])
    rows = sharding.digest(out).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in awkward())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    counts = Counter(r.shard for r in rows)
    sizes = [counts.get(k, 0) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(awkward())
    for k, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(n))
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(awkward())
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_sharding_places(spark):
    """Every place, from the numbers and hashes of the rows, in plain loops."""
    rows, buckets, seed = 500, 9, 4
    d = spark.range(0, rows, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    numbered = d.select("doc_id", F.monotonically_increasing_id().alias("number")).withColumn("b", F.pmod(F.xxhash64(F.lit(seed), "number"), F.lit(buckets)))
    found = sorted((r.b, r.number, r.doc_id) for r in numbered.collect())
    order = []
    for b in range(buckets):
        mine = [x[2] for x in found if x[0] == b]
        order += [mine[k] for k in sharding.fisher_yates(len(mine), seed, b)]
    shards = 6
    firsts = [*sharding.starts(rows, shards), rows]
    want = {x: (s, p - firsts[s]) for s in range(shards) for p in range(firsts[s], firsts[s + 1]) for x in [order[p]]}
    got = sharding.write_shards(d, shards, seed=seed, buckets=buckets)
    assert {r.doc_id: (r.shard, r.slot) for r in got.collect()} == want
    again = sharding.write_shards(d, shards, seed=seed, buckets=buckets)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, got.collect()))


def test_sharding_of_few_rows(spark):
    assert sharding.digest(sharding.write_shards(empty(spark))).collect() == []
    one = sharding.write_shards(spark.createDataFrame([(5, None)], "doc_id long, text string"))
    assert [(r["size"], r.text_crc32, r.slot) for r in sharding.digest(one).collect()] == [(1, 0, 0)]


def test_copies_spread_over_shards(spark):
    d = spark.range(0, 3000, 1, 3).select(F.lit(1).cast("long").alias("doc_id"), F.lit("copy").alias("text"))
    shards = sharding.write_shards(d, 8)
    assert sorted(r["count"] for r in shards.groupBy("shard").count().collect()) == [375] * 8


def middle(doc_id, text):
    t = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(k in t for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(u), "plain", None, None, t
    if h[3] % 100 < 20:
        return doc_id, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(docs):
    got = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(middle(i, t) for i, t in awkward())
    assert Counter((r.doc_id, r.back) for r in got) == Counter((i, t or "") for i, t in awkward())
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_random_texts(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice("aZ9 é中😀<>PSM\n") for _ in range(r.randrange(40)))) for i in range(600)]
    got = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {r.doc_id: tuple(r) for r in got.collect()} == {i: middle(i, t) for i, t in rows}
    assert fim.fill_in_middle(empty(spark)).count() == 0


def test_runs_and_cuts():
    r = random.Random(1)
    for _ in range(60):
        texts = ["".join(r.choice("ab-é😀") for _ in range(r.randrange(8))) for _ in range(r.randrange(1, 6))]
        raw = [t.encode() for t in texts]
        runs = fim.Runs(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])))
        units = [re.findall(r"[A-Za-z]+|[^A-Za-z]", t) for t in texts]
        assert runs.counts().tolist() == [len(u) for u in units]
        base = 0
        for k, u in enumerate(units):
            cuts = runs.cut(np.full(len(u) + 1, k), np.arange(len(u) + 1))
            assert cuts.tolist() == [base + len("".join(u[:c])) for c in range(len(u) + 1)]
            base += len(texts[k])
