import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from mnemodex.operators import logs, storage
from mnemodex.sources.slabs import SlabStore
from mnemodex.streaming import flush

SCHEMA = "record_id string, seq long, key string, queued_at timestamp, payload string, bytes long"


def queue(spark, tmp_path):
    rows = [(f"r{i % 7}", i, f"k{i % 2}", f"p{i}", 10) for i in range(30)]
    df = spark.createDataFrame(rows, "record_id string, seq long, key string, payload string, bytes long").withColumn("queued_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") * 100 + F.floor(F.col("seq") / 10) * 5000))
    df = df.select("record_id", "seq", "key", "queued_at", "payload", "bytes")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))


def test_flush_equals_the_batch_fold(spark, tmp_path):
    df, stream = queue(spark, tmp_path)
    flush.flush_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("record_id", "seq", "payload")
    want = logs.latest(df, "record_id", "seq").select("record_id", "seq", "payload")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    flush.batch_writer(str(tmp_path / "out"))(df, 0)  # a replayed batch
    assert spark.read.parquet(str(tmp_path / "out")).count() == want.count()


def test_idle_windows(spark, tmp_path):
    df, _ = queue(spark, tmp_path)
    assert sorted(r.records for r in flush.idle_windows(df).collect()) == [5] * 6


def test_idle_windows_stream_with_watermark(spark, tmp_path):
    _, stream = queue(spark, tmp_path)
    q = flush.idle_windows(stream).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.records for r in spark.table("idle").collect()} <= {5}


def test_policy_flushes_at_its_record_limit(spark, tmp_path):
    _, stream = queue(spark, tmp_path)
    out = flush.flush_decisions(stream.select("key", "bytes"), max_records=6)
    q = out.writeStream.format("memory").queryName("due").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    for _ in range(120):  # a stream with timers by the clock goes on as long as one is set
        if spark.table("due").count() >= 3 or q.awaitTermination(1):
            break
    q.stop()
    assert sorted((r.key, r.reason, r.records) for r in spark.table("due").collect()) == [("k0", "records", 6)] * 2 + [("k1", "records", 6)] * 2


def test_feed_dedup(spark, tmp_path):
    _, stream = queue(spark, tmp_path)
    q = flush.dedup_feed(stream, "record_id", "queued_at", "10 hours").writeStream.format("memory").queryName("dedup").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("dedup").count() == 7


def plain_flushes(rows, max_records, max_bytes, max_age, idle):
    """(key, reason, records, bytes, at) of rows(key, second, bytes), asking `due` of the queue at each second that could be one."""
    out = []
    for key in {k for k, _, _ in rows}:
        held = []
        for at, n in sorted((t, n) for k, t, n in rows if k == key):
            while held and min(held[0][0] + max_age, held[-1][0] + idle) <= at:
                moment = min(held[0][0] + max_age, held[-1][0] + idle)
                out.append((key, "age" if held[0][0] + max_age <= moment else "idle", len(held), sum(x for _, x in held), moment))
                held = []
            held.append((at, n))
            if len(held) >= max_records or sum(x for _, x in held) >= max_bytes:
                out.append((key, "records" if len(held) >= max_records else "bytes", len(held), sum(x for _, x in held), at))
                held = []
        if held:
            out.append((key, None, len(held), sum(x for _, x in held), None))  # due only when time goes on
    return out


def test_streamed_decisions_are_those_of_the_rule(spark, tmp_path):
    r, limits = random.Random(5), {"max_records": 6, "max_bytes": 500, "max_age": 900, "idle": 300}
    rows, t = [], 1_700_000_000
    for _ in range(260):
        t += r.choice([0, 1, 5, 40, 40, 40, 150, 299, 300, 301])
        rows.append((f"k{r.randrange(3)}", t, r.choice([10, 60, 200])))
    end = ("end", t + 100_000, 1)  # moves the watermark past every timer
    for i in range(0, 260, 52):
        part = rows[i : i + 52] + ([end] if i == 208 else [])
        spark.createDataFrame(part, "key string, s long, bytes long").select("key", F.timestamp_seconds("s").alias("queued_at"), "bytes").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, queued_at timestamp, bytes long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = flush.flush_decisions(stream, "queued_at", **limits).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    got = sorted((x.key, x.at // 1000, x.reason, x.records, x.bytes) for x in spark.table("decided").collect() if x.key != "end")
    want = [(k, at, why, n, size) for k, why, n, size, at in plain_flushes(rows, **limits) if why]
    last = [(k, n, size) for k, why, n, size, _ in plain_flushes(rows, **limits) if why is None]
    assert {why for _, _, why, _, _ in got} == {"records", "bytes", "age", "idle"}
    assert [g for g in got if g in want] == sorted(want) and sorted((g[0], *g[3:]) for g in got if g not in want) == sorted(last)
    # the batch rule agrees on each: asked at that moment it names the reason, and a second before it does not
    for k, at, why, n, size in got:
        mine = [x for x in rows if x[0] == k]
        held = [x for x in mine if x[1] <= at][-n:] if why in ("records", "bytes") else [x for x in mine if x[1] < at][-n:]
        assert sum(x[2] for x in held) == size
        if why in ("age", "idle"):
            state = spark.createDataFrame([(n, size, held[0][1], held[-1][1])], "n long, bytes long, o long, w long").select("n", "bytes", F.timestamp_seconds("o").alias("oldest"), F.timestamp_seconds("w").alias("newest"))
            if why == "idle" and at % 7 == 0 or why == "age":  # some of the many
                ask = lambda when: storage.due(state, datetime.datetime.fromtimestamp(when, datetime.timezone.utc), **limits).first().reason
                assert ask(at) == why and ask(at - 1) == "none"


class Killed(Exception):
    pass


def test_a_stream_into_slabs_survives_kills(spark, tmp_path):
    r, want = random.Random(9), {}
    for k in range(2):
        some = [(hashlib.md5(str(i).encode()).hexdigest(), 100 * k + i, "memory", r.randbytes(r.randrange(1, 300))) for i in range(12 * k, 12 * k + 20)]
        want |= {i: p for i, _, _, p in some}
        spark.createDataFrame(some, "record_id string, seq long, kind string, payload binary").withColumn("cid", F.sha2("payload", 256)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = SlabStore(spark, f"{tmp_path}/store", slab_bytes=2000)
    order, kills = [], ["upload", "slabs", "catalog"]

    def step(name):
        order.append(name)
        if kills and name == kills[0]:
            kills.pop(0)
            raise Killed(name)

    def run():
        stream = spark.readStream.schema("record_id string, seq long, kind string, payload binary, cid string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(flush.slab_sink(store, step)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(200)

    while kills:
        with pytest.raises(Exception, match="Killed|STREAM|foreachBatch"):
            run()
    run()
    live = store.live().select("id", F.col("object_ref").alias("ref"), "slab_id")
    assert {x.id: bytes(x.payload) for x in live.join(store.read(live), "ref").collect()} == want
    whole = ["upload", "ledger", "slabs", "objects", "catalog", "committed"]
    assert order[-6:] == whole and order[:1] == ["upload"] and order.count("committed") == 2
    assert {x.slab for x in store.ledger.state().where("state = 'pinned'").collect()} == {x.slab_id for x in live.collect()}
    before = len(order)
    flush.slab_sink(store, step)(spark.createDataFrame([], "record_id string, seq long, kind string, payload binary, cid string"), 1)
    assert len(order) == before  # a committed batch does nothing
