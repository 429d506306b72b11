"""The vector log: its bytes, damage, two writers, compaction."""

import threading
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemodex.sources import vectors
from mnemodex.sources.vectors import Damage, VectorLog

VEC = "id string, model string, vector array<float>"


def id_(n):
    return f"{n:032x}"


def records(*rows):
    return [vectors.encode(pa.RecordBatch.from_pylist([{"id": id_(n), "model": m, "vector": v}], pa.schema([("id", pa.string()), ("model", pa.string()), ("vector", pa.list_(pa.float32()))]))) for n, m, v in rows]


def read(blob, delta=False):
    damage = Damage()
    found = [(int(bytes(i).hex(), 16), b.model, f.tolist()) for b in vectors.scan(blob, delta, damage) for i, f in zip(b.ids, b.floats)]
    return found, damage.skipped, damage.lost


A, B, C = (1, "m", [1.0, 0.5]), (2, "m", [2.0, 0.5]), (3, "longer", [3.0])


def test_round_trip():
    rows = [A, B, C, (4, "", []), (5, "m", [float("inf"), 0.0])]
    assert read(b"".join(records(*rows))) == (rows, 0, 0)
    assert read(b"") == ([], 0, 0)
    many = [(n, "m" if n % 5 else "mm", [float(n)] * (n % 3)) for n in range(9000)]
    assert read(b"".join(records(*many)))[0] == many


def test_a_record_that_does_not_open():
    a, b, c = records(A, B, C)
    for at in (4, 6, 12, len(b) - 1):  # the name's length, the name, the id, the sum
        broken = b[:at] + bytes([b[at] ^ 0x41]) + b[at + 1 :]
        assert read(a + broken + c) == ([A, C], 1, 0)
        assert read(a + broken + c, True) == ([A, C], 1, 0)
        assert read(a + broken, True) == ([A], 0, 0)  # an append that was cut off
        assert read(a + broken) == ([A], 1, 0)


def test_a_length_that_cannot_be_true():
    a, b, c = records(A, B, C)
    for length in (b"\xff\xff\xff\xff", b"\x00\x00\x00\x00", b"\xff\xff\x00\x00"):
        broken = length + b[4:]
        assert read(a + broken + c) == ([A], 0, len(broken + c))
        assert read(a + broken + c, True) == ([A], 0, len(broken + c))  # a whole record lies behind it
        assert read(a + broken, True) == ([A], 0, 0)
    for cut in (1, 3, 5, len(c) - 1):
        assert read(a + c[:cut], True) == ([A], 0, 0)
        assert read(a + c[:cut]) == ([A], 0, cut)


def test_search_for_a_whole_record():
    a = records(A)[0]
    noise = bytes(range(256)) * 40
    assert vectors.holds_whole_record(memoryview(noise + a + noise), 0, 1000)
    assert not vectors.holds_whole_record(memoryview(noise + a[:-1]), 0, 1000)
    assert not vectors.holds_whole_record(memoryview(b""))


def test_too_long():
    with pytest.raises(ValueError):
        records((1, "x" * 65536, []))
    with pytest.raises(ValueError):
        records((1, "m", [0.0] * 65536))


def test_blobs_as_rows(spark):
    a, b = records(A, B)
    blobs = spark.createDataFrame([(1, 0, bytearray(a + b"\xff"), False), (2, 0, None, True), (3, 0, bytearray(b), True)], "seq int, segment int, content binary, delta boolean")
    got = vectors.read_vectors(blobs).orderBy("seq", "pos").collect()
    assert [(r.seq, r.pos, r.skipped, r.lost) for r in got] == [(1, -1, 0, 1), (1, 0, 0, 0), (3, 0, 0, 0)]


def log_of(spark, tmp_path, rows, **how):
    log = VectorLog(spark, str(tmp_path / "log"), **how)
    log.append(spark.createDataFrame([(id_(n), m, v) for n, m, v in rows], VEC))
    return log


def state(log):
    return sorted((int(r.id, 16), r.model, list(r.vector)) for r in log.reading().state().collect())


def test_append_remove_compact(spark, tmp_path):
    log = log_of(spark, tmp_path, [A, B, C])
    before = log.reading()
    log.append(spark.createDataFrame([(id_(2), "n", [9.0])], VEC))
    log.remove(spark.createDataFrame([(id_(3),), (id_(7),)], "id string"))
    expected = [A, (2, "n", [9.0])]
    assert state(log) == expected and before.state().count() == 3
    assert sorted(int(r.id, 16) for r in log.reading().removed().collect()) == [3, 7]
    assert log.reading().state(vectors=False).columns == ["id", "model", "dim"]
    assert log.compact() == Damage(0, 0) and state(log) == expected and log.reading().removed().count() == 0
    stats = log.stats()
    assert stats["compactions"] == 1 and stats["delta_bytes"] == 0 < stats["base_bytes"] < stats["bytes_written"] and not log.owed()


def test_a_compaction_that_an_append_makes_due_keeps_removals(spark, tmp_path):
    log = VectorLog(spark, str(tmp_path / "log"))
    ids = spark.range(2500).select(F.lpad(F.lower(F.hex("id")), 32, "0").alias("id"))
    log.append(ids.select("id", F.lit("m").alias("model"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector")))
    log.remove(ids)
    assert log.stats()["compactions"] == 2 and log.stats()["delta_bytes"] == 0
    assert log.reading().state().count() == 0 and log.reading().removed().count() == 2500
    log.append(ids.limit(1).select("id", F.lit("m").alias("model"), F.array(F.lit(3.0)).alias("vector")))
    assert log.reading().state().count() == 1 and log.reading().removed().count() == 2499
    log.compact()
    assert log.reading().state().count() == 1 and log.reading().removed().count() == 0


def test_empty(spark, tmp_path):
    log = VectorLog(spark, str(tmp_path / "none"))
    assert state(log) == [] and log.reading().damage() == Damage(0, 0)
    log.append(spark.createDataFrame([], VEC))
    log.compact()
    assert state(log) == []


def test_segments_are_bounded_and_unlisted_files_do_not_count(spark, tmp_path):
    rows = [(n, "m", [float(n)] * 50) for n in range(400)]
    log = log_of(spark, tmp_path, rows, segment_bytes=8192)
    part = Path(log.reading().parts[0])
    segments = list(part.glob("*.vec"))
    assert len(segments) > 8 and max(s.stat().st_size for s in segments) <= 8192
    (part / "0.vec").write_bytes(b"left by a task that failed")
    assert state(log) == rows


def test_two_writers_and_a_compaction_at_once(spark, tmp_path):
    log = log_of(spark, tmp_path, [A])
    frames = [spark.createDataFrame([(id_(n), "m", [float(n)])], VEC) for n in range(10, 14)]
    jobs = [threading.Thread(target=VectorLog(spark, log.root).append, args=(f,)) for f in frames] + [threading.Thread(target=log.compact)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    assert [s[0] for s in state(log)] == [1, 10, 11, 12, 13]


def test_damage_owes_a_rebuild(spark, tmp_path):
    log = log_of(spark, tmp_path, [A, B, C])
    segment = next(s for s in Path(log.reading().parts[0]).glob("*.vec") if s.stat().st_size)
    log.append(spark.createDataFrame([(id_(4), "m", [4.0])], VEC))
    segment.write_bytes(b"\x05\x00\x00\x00hello" + segment.read_bytes())
    assert log.reading().damage() == Damage(1, 0) and not log.owed()
    assert log.compact() == Damage(1, 0) and log.owed() and log.reading().damage() == Damage(0, 0)
    assert [s[0] for s in state(log)] == [1, 2, 3, 4]
    stale = log.reading()
    log.append(spark.createDataFrame([(id_(5), "m", [4.0])], VEC))
    assert not log.settle(stale) and log.owed()
    assert log.settle(log.reading()) and not log.owed()
    assert log.reading().state().where(F.col("id") == id_(5)).count() == 1
