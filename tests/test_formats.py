import pytest
from pyspark.sql import functions as F

from mnemodex.sources import formats
from mnemodex.sources.versions import Versioned


def test_frames(spark):
    ids = [bytes([i] * 16) for i in range(3)]
    blob = b"".join(formats.frame(k, i, b"x" * n) for k, i, n in zip(("memory", "session", "chunk"), ids, (0, 200, 5)))
    assert len(blob) == sum(formats.frame_overhead(n) + n for n in (0, 200, 5))
    df = spark.createDataFrame([("good", bytearray(blob)), ("cut", bytearray(blob[:-2])), ("bad", bytearray(b"\x20" + b"z" * 32)), ("empty", None)], "ref string, content binary")
    got = formats.split_frames(df).collect()
    assert [r.kind for r in got if r.ref == "good"] == ["memory", "session", "chunk"]
    assert [r.error for r in got if r.ref == "cut"] == ["", "", "cut off frame"]
    assert [r.error for r in got if r.ref == "bad"] == ["not a frame"]
    back = formats.pack_frames(formats.split_frames(df.where("ref = 'good'")))
    assert bytes(back.first().content) == blob


def test_catalog_lines(spark):
    rows = [(1, formats.catalog_line({"id": "a", "version": 2, "tags": ["x"]})), (2, "%%%"), (3, formats.catalog_line({"id": "a", "deleted": True, "unknown": 1}))]
    got = formats.read_catalog(spark.createDataFrame(rows, "seq long, value string")).orderBy("seq").collect()
    assert [r.bad for r in got] == [False, True, False] and got[0].tags == ["x"] and got[2].deleted


def test_jsonl_and_tsv(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "a"}\nnot json\n')
    got = formats.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string").cache()
    assert got.where("_corrupt_record is not null").count() == 1
    formats.write_tsv(spark.range(3), str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).count() == 3
    assert formats.to_json_rows(spark.range(1)).first().json == '{"id":0}'


def test_versions(spark, tmp_path):
    v = Versioned(spark, str(tmp_path / "log"), "id long, seq long, dim int")
    assert v.read().count() == 0
    v.append(spark.createDataFrame([(1, 1, 4), (2, 2, 4)], "id long, seq long, dim int"))
    old = v.read()
    v.append(spark.createDataFrame([(1, 3, 0), (3, 4, 4)], "id long, seq long, dim int"))
    assert old.count() == 2 and v.read().count() == 4
    before = {(r.id, r.seq) for r in v.state().where("dim > 0").collect()}
    v.compact(F.col("dim") > 0)
    assert {(r.id, r.seq) for r in v.read().collect()} == before


def test_overlong_length():
    with pytest.raises(ValueError):
        formats.read_uvarint(b"\xff" * 12, 0)
    assert all(formats.read_uvarint(formats.uvarint(n), 0) == (n, len(formats.uvarint(n))) for n in (0, 1, 127, 128, 300, 1 << 40))
