import random

import pytest
from pyspark.sql import functions as F

from mnemodex.operators import stored, transcripts
from mnemodex.plans.copies import STEPS
from mnemodex.sources import migrations, paged
from mnemodex.sources.versions import Versioned


def test_versions_compact_themselves(spark, tmp_path):
    schema = "id long, seq long, word string"
    v = Versioned(spark, str(tmp_path / "log"), schema)
    assert v.stats() == dict.fromkeys(("version", "base_bytes", "delta_bytes", "bytes_written", "compactions"), 0)
    rng = random.Random(1)
    v.append(spark.createDataFrame([(1, 1, "small")], schema))
    small = v.stats()
    assert small["compactions"] == 0 and small["delta_bytes"] == small["bytes_written"] > 0 and small["base_bytes"] == 0
    v.append(spark.createDataFrame([(i, i + 2, f"{rng.getrandbits(256):x}") for i in range(4000)], schema))
    big = v.stats()
    assert big["compactions"] == 1 and big["delta_bytes"] == 0 and big["base_bytes"] > 0 and big["bytes_written"] > big["base_bytes"]
    assert v.read().count() == 4000
    v.append(spark.createDataFrame([(1, 9999, "late")], schema))
    assert v.stats()["compactions"] == 1 and v.state().where("id = 1").first().word == "late"


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 35])
def test_paged_source(spark, n):
    got = paged.read_paged(spark, f"numbers_{n}", "id long", lambda offset, limit: [(i,) for i in range(n)][offset : offset + limit], size=10)
    assert sorted(r.id for r in got.collect()) == list(range(n))


def test_list_pages(spark):
    ids = random.Random(2).sample(range(10**6), 57)
    got = {r.k: r.page for r in stored.list_pages(spark.createDataFrame([(i,) for i in ids], "k long"), "k", 10).collect()}
    assert got == {k: i // 10 for i, k in enumerate(sorted(ids))}
    assert stored.list_pages(spark.createDataFrame([], "k long"), "k", 10).count() == 0


def test_read_range(spark):
    d = spark.createDataFrame([("a", bytearray(b"0123456789")), ("b", bytearray(b"")), ("c", None)], "ref string, content binary")
    got = {r.ref: r.content for r in stored.read_range(d, 3, 4).collect()}
    assert bytes(got["a"]) == b"3456" and bytes(got["b"]) == b"" and got["c"] is None
    assert [bytes(r.content) for r in stored.read_range(d.where("ref = 'a'"), F.lit(8), F.lit(9)).collect()] == [b"89"]


def test_migrations(spark):
    t = spark.createDataFrame([(1, "en", "web")], "id long, lang string, source string")
    up = migrations.migrate(t, 0, 2, STEPS)
    assert up.columns == ["id", "archived", "title"] and migrations.migrate(up, 2, 0, STEPS).collect() == t.collect()
    assert migrations.migrate(t, 1, 1, STEPS) is t
    for have, want in ((0, 3), (3, 0), (-1, 0)):
        with pytest.raises(ValueError):
            migrations.migrate(t, have, want, STEPS)


def test_undated_heads_need_every_condition(spark):
    heads = [(i, 4, 10, 10, [f"{i}a", f"{i}b"]) for i in range(6)] + [(6, 4, 10, 11, ["6a"]), (7, 4, None, None, ["7a"]), (8, 4, 10, 10, []), (9, 4, 10, 10, None)]
    names = [c for h in heads for c in h[4] or []]
    entries = [(c, "p" if c == "1a" else "h") for c in names if c != "2b"]
    d = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = stored.undated_heads(
        d(heads, "id long, version long, created long, updated long, chunks array<string>"), d(entries, "id string, slab_id string"), d([("h", "hydrated"), ("p", "pinned")], "slab_id string, origin string"),
        d([("3a",)], "id string"), d([(c, c == "4b") for c in names if c != "5a"], "id string, dated boolean"),
    )
    assert [(r.id, r.version, r.created, r.updated) for r in got.collect()] == [(0, 5, None, None)]


def test_save_sessions(spark):
    heads = spark.createDataFrame([("a", 2, 3, 10), ("b", 1, 1, 1), ("z", 5, 5, 5)], "id string, version long, chunks long, messages long")
    saves = spark.createDataFrame([("a", 2), ("b", 7), ("c", 0), ("d", 1), ("e", 0)], "id string, expect long")
    turns = spark.createDataFrame([(s, i, f"{s}{i}", 40) for s in "abcd" for i in range(3)], "session string, pos int, id string, bytes long")
    h, c = transcripts.save_sessions(heads, saves, turns, target=100)
    assert {tuple(r) for r in h.collect()} == {("a", 3, 5, 13, "accepted"), ("b", 1, 1, 1, "stale"), ("z", 5, 5, 5, None), ("c", 1, 2, 3, "accepted"), ("e", 1, 0, 0, "accepted")}
    got = {(r.session, r.seq): (r["first"], r["last"], r.n, r.bytes, r.withdrawn) for r in c.collect()}
    assert got[("a", 3)] == ("a0", "a1", 2, 80, False) and got[("a", 4)] == ("a2", "a2", 1, 40, False)
    assert {k for k, v in got.items() if v[-1]} == {("b", 1), ("b", 2), ("d", 0), ("d", 1)} and len(got) == 8
