"""The stored lexical index against scores from the texts, and two writers at once."""

import random

import pytest
from pyspark.sql import functions as F

from mnemodex.functions import text as T
from mnemodex.operators import retrieval
from mnemodex.sources import lexical
from mnemodex.sources.commits import CommitLog
from mnemodex.sources.lexical import LexicalIndex
from mnemodex.sources.versions import Versioned

WORDS = "apple pear plum grape melon fig the and kiwi quince a é".split()


def texts(seed, ids):
    r = random.Random(seed)
    return {i: " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 25))) for i in ids}


def frame(spark, d):
    return spark.createDataFrame(list(d.items()), "id long, text string").repartition(3)


def scores(df):
    return {r.id: round(r.score, 9) for r in df.collect()}


@pytest.mark.parametrize("merged", [True, False])
def test_scores_after_upserts_and_deletes(spark, tmp_path, merged):
    index, live = LexicalIndex(spark, f"{tmp_path}/i"), texts(1, range(200))
    live |= {200: None, 201: "", 202: "the and"}
    index.merge()  # nothing to merge yet
    assert index.count() == 0 and index.scores(["apple"]).count() == 0
    if not merged:
        index.merge = lambda: None
    index.put(frame(spark, live))
    for step in range(3):
        new = texts(10 + step, random.Random(step).sample(range(230), 25)) | {5 + step: "the"}
        index.put(frame(spark, new))
        live |= new
        gone = random.Random(50 + step).sample(range(220), 9) + [999]
        index.forget(spark.createDataFrame([(g,) for g in gone], "id long"))
        live = {k: v for k, v in live.items() if k not in gone}
    plain = frame(spark, live)
    assert index.count() == len([v for v in live.values() if T.analyze(v or "")])
    for query in (["apple"], ["apple", "pear", "apple", "absent"], ["kiwi", "fig"], ["absent"], []):
        assert scores(index.scores(query)) == scores(retrieval.bm25_scores(plain, query))
    segments = index.log.newest()[1]["segments"]
    assert (len(segments) < 7) == merged
    LexicalIndex.merge(index)
    assert len(index.log.newest()[1]["segments"]) == 1 and scores(index.scores(["apple", "plum"])) == scores(retrieval.bm25_scores(plain, ["apple", "plum"]))


def test_the_last_row_of_an_id_counts(spark, tmp_path):
    index = LexicalIndex(spark, f"{tmp_path}/i", "string")
    index.put(spark.createDataFrame([("a", "apple", 1), ("a", "pear", 2), ("b", "apple apple", 1)], "id string, text string, seq long"), order="seq")
    assert set(scores(index.scores(["apple"]))) == {"b"} and set(scores(index.scores(["pear"]))) == {"a"}


def test_a_search_reads_its_terms_alone(spark, tmp_path):
    index = LexicalIndex(spark, f"{tmp_path}/i")
    index.put(frame(spark, texts(3, range(300))))
    plan = index.scores(["apple", "pear"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(term, [apple,pear])" in plan and "split(" not in plan


def test_recall_over_an_index(spark, tmp_path):
    t = frame(spark, texts(4, range(80)))
    v = spark.createDataFrame([(i, [1.0 - i / 100, (i * 7 % 11) / 50.0]) for i in range(80)], "id long, vector array<float>")
    m = spark.createDataFrame([(i, "session" if i % 3 == 0 else "memory", "fact", ["x"], None) for i in range(80)], "id long, kind string, type string, tags array<string>, supersedes long")
    index = LexicalIndex(spark, f"{tmp_path}/i")
    index.put(t)
    for how in ({}, {"kinds": ["session"]}):
        req = retrieval.Request([1.0, 0.2], "apple and kiwi", limit=20, **how)
        assert [tuple(r) for r in retrieval.recall(v, index, m, req).collect()] == [tuple(r) for r in retrieval.recall(v, t, m, req).collect()]


def test_two_writers(spark, tmp_path):
    log = CommitLog(spark, f"{tmp_path}/log")
    assert log.newest() == (0, {}) and log.commit(1, {"a": 1}) and not log.commit(1, {"a": 2}) and log.newest() == (1, {"a": 1})
    index, other = LexicalIndex(spark, f"{tmp_path}/i"), LexicalIndex(spark, f"{tmp_path}/i")
    index.put(frame(spark, {1: "apple", 2: "pear"}))
    commit, came = index.log.commit, []

    def late(number, entry):  # another writer comes between reading and committing
        if not came:
            came.append(other.put(frame(spark, {2: "apple plum fig", 3: "apple"})))
        return commit(number, entry)

    index.log.commit = late
    index.put(frame(spark, {3: "pear pear", 4: "apple"}))
    live = frame(spark, {1: "apple", 2: "apple plum fig", 3: "pear pear", 4: "apple"})
    for query in (["apple"], ["pear", "fig"]):
        assert scores(other.scores(query)) == scores(retrieval.bm25_scores(live, query))
    a, b = (Versioned(spark, f"{tmp_path}/v", "id long, seq long") for _ in range(2))
    a.append(spark.range(3).select("id", F.lit(1).cast("long").alias("seq")))
    keep, met = a.log.commit, []

    def again(number, entry):
        if not met:
            met.append(b.append(spark.range(3, 5).select("id", F.lit(2).cast("long").alias("seq"))))
        return keep(number, entry)

    a.log.commit = again
    a.append(spark.range(5, 6).select("id", F.lit(3).cast("long").alias("seq")))
    assert sorted(r.id for r in a.read().collect()) == [0, 1, 2, 3, 4, 5]
    met.clear()
    a.compact()
    assert sorted(r.id for r in b.state().collect()) == [0, 1, 2, 3, 4, 5] and len(b.log.newest()[1]["parts"]) == 2


def test_cursors_of_full_pages():
    assert retrieval.next_cursor("q", 10, 5, 4) == "" and retrieval.decode_rank_cursor(retrieval.next_cursor("q", 10, 5, 5), "q") == 15


def test_tasks_that_write_follow_the_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "TASK_BYTES", 500)
    monkeypatch.setattr(lexical, "TASK_ROWS", 100)
    index, live = LexicalIndex(spark, f"{tmp_path}/i"), texts(7, range(300))
    index.put(frame(spark, live))
    size = sum(len(t.encode()) for t in live.values())
    staged, segment = next(tmp_path.glob("i/staged-*")), next(tmp_path.glob("i/seg-*"))
    tasks = lambda d, p: {f.name.split("-")[1] for f in d.glob(p)}
    assert len(tasks(staged, "*.parquet")) > size // 1000 > 4
    assert len(tasks(segment, "postings/*/*.parquet")) > 8
    assert scores(index.scores(["apple", "plum"])) == scores(retrieval.bm25_scores(frame(spark, live), ["apple", "plum"]))
