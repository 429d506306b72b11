"""Rules of transcripts, storage and logs on awkward inputs."""

import json

import pytest
from pyspark.sql import functions as F

from mnemodex.operators import logs, storage, transcripts


def test_tool_pairs_by_first_appearance(spark):
    rows = [(1, 0, "tool_result", "a", None, "early"), (1, 1, "tool_call", "a", "late", None), (1, 2, "tool_call", "b", "first", None), (1, 3, "tool_call", "b", "second", None), (1, 4, "tool_result", "b", None, "r1"), (1, 5, "tool_result", "b", None, None), (1, 6, "tool_call", "c", None, None), (1, 7, "text", "d", "x", "y")]
    got = {r.call_id: r for r in transcripts.tool_pairs(spark.createDataFrame(rows, "session long, pos long, kind string, call_id string, name string, text string")).collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].name, got["a"].called, got["a"].result, got["a"].orphan) == (None, None, "early", True)
    assert (got["b"].name, got["b"].called, got["b"].answered, got["b"].orphan) == ("first", 2, 5, False)
    assert (got["c"].called, got["c"].answered, got["c"].orphan) == (6, None, False)


def test_nested_parts_are_walked_depth_first(spark):
    parts = [{"type": "text", "text": "x"}, {"type": "tool_result", "call_id": "k", "content": [{"type": "text", "text": "in"}, {"type": "tool_call", "call_id": "n", "content": [{"type": "text", "text": "deep"}]}]}, {"type": "text", "text": "z"}]
    m = spark.createDataFrame([(1, 0, "m0", json.dumps(parts)), (1, 1, "m1", None), (1, 2, "m2", "[]")], "session long, pos long, id string, parts string")
    got = sorted(transcripts.walk_parts(m).collect(), key=lambda r: r["at"])
    assert [(r["at"], list(r.path), r.type, r.text) for r in got] == [(0, [0], "text", "x"), (1, [1], "tool_result", None), (2, [1, 0], "text", "in"), (3, [1, 1], "tool_call", None), (4, [1, 1, 0], "text", "deep"), (5, [2], "text", "z")]


def test_page_tells_the_next_start_and_refuses_unknown_ones(spark):
    t = spark.createDataFrame([(1, i, f"m{i}") for i in range(5)] + [(2, 0, "m9")], "session long, pos long, id string")
    got = transcripts.page(t, 1, "m1", 2).collect()
    assert [(r.id, r.more, r.next) for r in got] == [("m1", True, "m3"), ("m2", True, "m3")]
    assert [(r.id, r.more, r.next) for r in transcripts.page(t, 1, "m3", 2).collect()] == [("m3", False, None), ("m4", False, None)]
    with pytest.raises(Exception, match="holds no message"):
        transcripts.page(t, 1, "m9", 2).collect()


@pytest.mark.parametrize(
    "objects, slabs, catalogued, pinned, every, refused",
    [(3, 2, 10, 5, False, True), (10, 2, 10, 5, False, False), (0, 0, 0, 0, False, False), (0, 0, 0, 5, False, True), (0, 0, 0, 5, True, False), (0, 2, 1, 5, True, True), (1, 0, 1, 5, False, True), (1, 1, -1, 0, True, True)],
)
def test_keep_set_guard(spark, objects, slabs, catalogued, pinned, every, refused):
    k = spark.createDataFrame([(objects, slabs, catalogued, pinned)], "objects long, slabs long, catalogued long, pinned long")
    assert (storage.check_keep_set(k, release_all=every).first().refusal is not None) == refused


def test_compare_and_set_outcomes(spark):
    rows = [("a", 0, 0, False), ("a", 1, 0, False), ("a", 2, 1, False), ("a", 3, 1, True), ("a", 4, 2, True), ("a", 5, 2, True), ("a", 6, 2, False), ("a", 7, 0, False), ("b", 0, 3, False), ("b", 1, 0, None)]
    d = spark.createDataFrame(rows, "id string, seq long, expect long, gone boolean")
    got = {(r.id, r.seq): (r.outcome, r.version) for r in logs.head_cas(d, "id", "seq", "expect", "gone").collect()}
    want = ["accepted", "stale", "accepted", "stale", "accepted", "absent", "not_found", "accepted"]
    assert [got["a", i][0] for i in range(8)] == want and got["a", 7][1] == 1
    assert got["b", 0] == ("not_found", 0) and got["b", 1] == ("accepted", 1)


def test_numbering_and_batches(spark):
    d = spark.createDataFrame([(i * i % 1009, f"r{i}") for i in range(500)], "seq long, id string").dropDuplicates(["seq"]).repartition(7)
    got = {r.seq: r.number for r in logs.number_rows(d, "seq").collect()}
    assert got == {s: i for i, s in enumerate(sorted(got))}
    b = storage.delete_batches(d, size=64).groupBy("batch").agg(F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi")).orderBy("batch").collect()
    assert all(r.n == 64 for r in b[:-1]) and all(x.hi < y.lo for x, y in zip(b, b[1:]))
    assert logs.number_rows(d.where("seq < 0"), "seq").count() == 0


def test_repack_without_moves_releases_nothing(spark):
    held = spark.createDataFrame([(1, 1, "r1", "s1"), (2, 2, "r2", "")], "id long, cid long, ref string, slab string")
    none = spark.createDataFrame([], "cid long, ref string, slab string, bytes long")
    owed = spark.createDataFrame([], "slab string")
    assert storage.repack_release(held, held.select("ref"), none, owed).count() == 0
    assert storage.repack_report(held, held.select("ref"), none).first().asDict() == {"moved": 0, "gone": 2, "before": 1, "after": 1, "peak": 1}
    with pytest.raises(Exception, match="not written"):
        storage.repack_moves(held, held.select("ref").limit(0), none).collect()


def test_removal_and_object_marker(spark):
    log = spark.createDataFrame([("a", 1, "memory", False, "o1", "s1", 5), ("b", 2, "memory", True, "o2", "s2", 6)], "id string, seq long, kind string, deleted boolean, object_ref string, slab_id string, bytes long")
    f = logs.latest(log, "id", "seq")
    gone = logs.remove(f, spark.createDataFrame([("a", 9), ("zz", 9)], "id string, seq long"), "id", "seq")
    assert [(r.id, r.seq, r.deleted, r.object_ref) for r in gone.collect()] == [("a", 9, True, "o1")]
    assert [r.id for r in logs.unknown_keys(f, spark.createDataFrame([("a",), ("zz",)], "id string"), "id").collect()] == ["zz"]
    asked = spark.createDataFrame([("a", "o1", 9), ("b", "other", 9), ("b", "o2", 9), ("b", "", 9)], "id string, object_ref string, seq long")
    out = logs.object_deleted(f, asked, "id", "seq").collect()
    assert [(r.id, r.object_ref, r.slab_id, r.deleted) for r in out] == [("b", "", "", True)]
