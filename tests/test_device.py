"""Restoring a device from stored objects, and rebuilding its index after damage."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mnemodex.sources import formats
from mnemodex.sources.device import Device

MODEL = "m"


def id_(n):
    return f"{n:032x}"


def sealed(body):
    return b"S" + (body if isinstance(body, str) else json.dumps(body)).encode()


def opened(c):
    """What begins with S is this vault's."""
    return F.when(F.substring(c, 1, 1).cast("string") == "S", F.substring(c, 2, 1 << 30).cast("string"))


def embed(texts):
    """The length of a text; `mute` has no vector."""
    return texts.select("id", F.when(F.col("text") != "mute", F.array(F.length("text").cast("float"), F.lit(1.0).cast("float"))).alias("vector"))


def memory(n, said, named=None):
    return formats.frame("memory", bytes.fromhex(id_(n)), sealed({"id": id_(named or n), "type": "fact", "version": 2, "tags": ["a"], "updated_at": n, "statement": said}))


def chunk(n, session, seq, texts):
    said = [{"id": f"{seq}-{i}", "role": "user", "parts": [{"type": "text", "text": t}], "created": 10 * seq + i} for i, t in enumerate(texts)]
    return formats.frame("chunk", bytes.fromhex(id_(n)), sealed({"id": id_(n), "session": id_(session), "seq": seq, "messages": said}))


def objects(spark):
    rows = [
        ("a", "s1", memory(1, "one") + memory(2, "two words")), ("b", "s1", memory(3, "mute") + formats.frame("memory", bytes(16), b"X other")), ("c", "s2", memory(4, "four", named=9)),
        ("d", "s3", memory(5, "five")), ("e", "s2", chunk(6, 60, 1, ["later"]) + chunk(7, 60, 0, ["hello there", "b"])), ("f", "s4", memory(8, "eight")[:-1]), ("g", "s2", None),
    ]
    return spark.createDataFrame([(r, s, 7, None if c is None else bytearray(c)) for r, s, c in rows], "ref string, slab string, updated_at long, content binary")


def live_vectors(device):
    return {int(r.id, 16): list(r.vector) for r in device.vectors.reading().state().collect()}


@pytest.fixture(scope="module")
def restored(spark, tmp_path_factory):
    d = Device(spark, str(tmp_path_factory.mktemp("device")), MODEL)
    d._append(d.catalog, spark.createDataFrame([(id_(5), "memory", True)], "id string, kind string, deleted boolean").selectExpr("*", "'' type", "1L version", "array('') tags", "'d' object_ref", "'s3' slab_id", "1L bytes", "1L written_at"))
    d._append(d.ledger, spark.createDataFrame([("s2", "pinned", 0, 0)], "slab_id string, origin string, records long, bytes long"))
    return d, d.restore(objects(spark), opened, "index", embed)


def test_counters(restored):
    _, report = restored
    want = {"objects": 7, "frames": 8, "foreign": 1, "forgotten": 1, "records": 5, "slabs": 2, "bodies": 5, "damaged": 1, "problems": 1, "heads": 1, "embedded": 3, "unembeddable": 1}
    assert {k: report[k] for k in want} == want


def test_tables(restored):
    d, _ = restored
    assert sorted(int(r.id, 16) for r in d.catalog.state().where("not deleted").collect()) == [1, 2, 3, 6, 7]
    assert {r.slab_id: (r.origin, r.records) for r in d.ledger.state().collect()} == {"s1": ("hydrated", 3), "s2": ("pinned", 2)}
    head = d.heads.state().first()
    assert (int(head.id, 16), head.title, head.messages, head.chunks, head.created, head.updated) == (0x3C, "hello there", 3, 2, 0, 10)
    assert live_vectors(d) == {1: [3.0, 1.0], 2: [9.0, 1.0], 60: [11.0, 1.0]}


def test_again(restored, spark):
    d, first = restored
    ledger = {(r.slab_id, r.records, r.bytes, r.origin) for r in d.ledger.state().collect()}
    again = d.restore(objects(spark), opened, "index", embed)
    assert {**again, "embedded": 3} == first and again["embedded"] == 0
    assert {(r.slab_id, r.records, r.bytes, r.origin) for r in d.ledger.state().collect()} == ledger


def test_depths(spark, tmp_path):
    d = Device(spark, str(tmp_path), MODEL)
    report = d.restore(objects(spark), opened, "catalog")
    assert report["records"] == 6 and report["bodies"] == 0 and d.bodies.read().count() == 0
    with pytest.raises(ValueError):
        d.restore(objects(spark), opened, "all")
    with pytest.raises(ValueError):
        d.restore(objects(spark), opened, "index")
    none = d.restore(objects(spark).limit(0), opened, "metadata")
    assert none["objects"] == 0 and none["heads"] == 0


def test_rebuild(restored, spark):
    d, _ = restored
    assert d.repair_index(embed)["ran"] is False
    # a vector of what is not held, a removal of a record that is held, and a damaged record
    d.vectors.append(spark.createDataFrame([(id_(77), "m", [1.0])], "id string, model string, vector array<float>"))
    d.vectors.remove(spark.createDataFrame([(id_(2),)], "id string"))
    part = next(p for p in d.vectors.reading().parts if any(s.stat().st_size for s in Path(p).glob("*.vec")))
    for s in Path(part).glob("*.vec"):
        s.write_bytes(bytes([b ^ 0xFF if i == 6 else b for i, b in enumerate(s.read_bytes())]) + b"\x01\x00\x00\x00z" + memory(1, "x"))
    report = d.repair_index(embed)
    assert report["ran"] and report["dropped"] == 1 and report["rounds"] <= 2 and not report["unfinished"] and report["skipped"] + report["lost"] > 0
    assert live_vectors(d) == {1: [3.0, 1.0], 60: [11.0, 1.0]} and report["failed"] == 1
    assert not d.vectors.owed() and d.repair_index(embed)["ran"] is False


def test_a_record_forgotten_while_it_is_embedded(spark, tmp_path):
    d = Device(spark, str(tmp_path), MODEL)
    d.restore(objects(spark), opened, "metadata")
    d.vectors.owe()

    def forgetful(texts):
        made = embed(texts)
        made.count()
        # a forget takes the ranking row; here it is another kind's, which is the same to a reader
        d._append(d.ranking, spark.createDataFrame([(id_(1), "chunk")], "id string, kind string").selectExpr("*", "'' type", "1L version", "array('') tags", "1L written_at"))
        return made

    report = d.repair_index(forgetful)
    assert 1 not in live_vectors(d) and 2 in live_vectors(d) and report["embedded"] == 3
