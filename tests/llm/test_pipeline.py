import pytest

pytest.importorskip("mnemodex.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf, tmp_path):
    from . import brute

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        rows = after.collect()
        if i < 4:
            assert after.columns == corpus_pipeline.COLUMNS
        if i == 0:
            kept = {k for k, r in before.items() if not brute.quality(r.text)[-1]}
            assert {r.doc_id for r in rows} <= kept and len(rows) > 0.8 * len(kept)
        if i == 1:
            assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
        if i == 2:
            comp = brute.near({r.doc_id: r.text for r in docs.collect()})[1]
            assert {r.doc_id for r in rows} == set(comp.values())
        docs = after
    assert docs.count() == len(rows) > 0 and set(docs.columns) >= {"doc_id", "n_tokens", "ids"}


def test_run_matches_stages(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_short_pages_lose_boilerplate(spark, sf):
    mark = "Subscribe to our newsletter today, and never miss a story again"
    rows = [(i, f"own {i}\n{mark}", "en", f"s{i}", 0) for i in range(10)] + [(20, mark, "en", "s1", 0), (21, f"{mark}\n \n{mark}", "en", "s2", 0)]
    out = corpus_pipeline.lines_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), sf)
    assert {r.doc_id: r.text for r in out.collect()} == {i: f"own {i}" for i in range(10)} | {20: mark, 21: f"{mark}\n \n{mark}"}


def awkward(spark):
    """Nulls in any column, empty and long texts, repeated rows, ids with several texts, a line on many sources, columns of clashing names."""
    import random

    from pyspark.sql import functions as F

    r = random.Random(11)
    prose = lambda n: " ".join(f"w{r.randint(0, 5000)}" for _ in range(n))
    mark, base, long = "Sign up for our letter now", prose(90), prose(60_000)
    rows = [(i, f"{prose(40)}\n{mark}", "en", f"s{i}", 1) for i in range(10)]
    rows += [(20, base, "en", "s1", 1)] * 3 + [(21, base + " more", "en", None, None), (20, prose(50), None, "s2", 1), (None, base + " end", None, None, None), (None, prose(45), "en", "s3", 2)]
    rows += [(30, None, "en", "s1", 0), (31, "", "en", "s1", 0), (32, " \n\t", None, None, None), (None, None, None, None, None), (33, long, "en", "s4", 3), (34, mark, "en", "s5", 1), (None, "", "en", "s1", 0)]
    names = ["n_lines", "r", "k", "t", "n", "h", "number", "own", "block", "pass", "spans_", "row", "sig", "id", "size", "start"]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return rows, d.withColumns({n: F.lit(7) for n in names}).repartition(4)


def test_stages_on_awkward_rows(spark, sf, tmp_path):
    import numpy as np
    import tiktoken

    from mnemodex.llm import bpe, pretokens, queries

    from . import brute

    rows, docs = awkward(spark)
    stages = dict(corpus_pipeline.STAGES)
    as_rows = lambda df: sorted((tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in df.select(*corpus_pipeline.COLUMNS).collect()), key=repr)
    quality = stages["quality rules"](spark, docs, sf)
    assert quality.columns == corpus_pipeline.COLUMNS
    assert as_rows(quality) == sorted((r for r in rows if not brute.quality(r[1])[-1]), key=repr)
    lined = stages["line dedup"](spark, docs, sf)
    free = brute.boilerplate_free([(r[1], r[3]) for r in rows])
    assert as_rows(lined) == sorted(((r[0], t, r[2], r[3], None if t is None else len(t)) for r, t in zip(rows, free)), key=repr)
    # near duplicates: documents are rows that differ in id or text
    near = as_rows(stages["n-gram Jaccard join"](spark, docs, sf))
    keys = list(dict.fromkeys((r[0], r[1]) for r in rows))
    order = sorted(range(len(keys)), key=lambda i: (keys[i][0] is None, keys[i][0] or 0))
    comp = brute.near({n: keys[i][1] for n, i in enumerate(order)})[1]
    want = {keys[order[c]] for c in set(comp.values())}
    none = [r for r in rows if r[0] is None and not (r[1] or "").split()]
    assert {(r[0], r[1]) for r in near} == want and len(near) == len(want) - len({(r[0], r[1]) for r in none}) + len(none)
    mixed = as_rows(stages["mixing sources to target weights"](spark, docs, sf))
    words = {}
    for r in rows:
        key = (r[0], r[3], r[2])
        words[key] = words.get(key, 0) + len((r[1] or "").split())
    taken = {}
    for r in mixed:
        taken[r[0], r[3], r[2]] = taken.get((r[0], r[3], r[2]), 0) + len(r[1].split())
    assert all(n <= 2 * words[k] for k, n in taken.items())
    total = {}
    for r in rows:
        total[r[3]] = total.get(r[3], 0) + len((r[1] or "").split())
    for s, t in brute.targets(total).items():
        assert abs(sum(len(r[1].split()) for r in mixed if r[3] == s) - t) <= 64
    enc = tiktoken.Encoding("own", pat_str=pretokens.PATTERN, mergeable_ranks=bpe.read_ranks(queries.vocabulary()), special_tokens={})
    coded = stages["byte-level BPE"](spark, docs, sf).collect()
    got = sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in coded), key=repr)
    assert got == sorted(((r[0], enc.encode_ordinary(r[1] or "")) for r in rows), key=repr)


def test_stages_on_an_empty_table(spark, sf):
    docs = awkward(spark)[1].where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
