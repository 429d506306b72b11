"""The change feed: its fold against a plain walk, and as a stream that is stopped in the middle of a page."""

import random

from pyspark.sql import functions as F

from mnemodex.operators import logs, stored
from mnemodex.sources import feed

EVENTS = "at long, key string, deleted boolean, readable boolean"


def events(n, seed=1):
    r = random.Random(seed)
    return sorted((r.randrange(n // 3), f"k{r.randrange(n // 4)}-{i}" if r.random() < 0.1 else f"k{i % (n // 4)}", r.random() < 0.2, r.random() < 0.9) for i in range(n))


def walked(rows):
    """A plain walk, event by event."""
    live, order, stats = {}, [], {"events": 0, "unreadable": 0, "deleted": 0, "superseded": 0}
    for at, key, deleted, readable in rows:
        stats["events"] += 1
        if key in order:
            stats["superseded"] += 1
        else:
            order.append(key)
        live.pop(key, None)
        if deleted:
            stats["deleted"] += 1
        elif not readable:
            stats["unreadable"] += 1
        else:
            live[key] = at
    return [(k, live[k]) for k in order if k in live], stats


def folded(df):
    d = df.withColumn("seq", F.struct("at", "key"))
    return d, [(r.key, r["at"]) for r in stored.feed_live(d, "key", "seq", F.col("deleted"), F.col("readable")).collect()]


def test_the_fold_is_the_walk(spark):
    rows = list({(a, k): (a, k, d, r) for a, k, d, r in events(300)}.values())
    d, live = folded(spark.createDataFrame(rows, EVENTS).repartition(3))
    want, stats = walked(sorted(rows))
    assert live == want
    got = logs.feed_counters(d, "key", "seq", F.col("deleted"), F.col("readable"), 50).first().asDict()
    assert got == {**stats, "live": len(want), "pages": -(-len(rows) // 50)}
    none = logs.feed_counters(d.where("at < 0"), "key", "seq", F.col("deleted"), F.col("readable"), 50).first().asDict()
    assert set(none.values()) == {0}


def test_stretches():
    rows = [(i // 2, f"k{i}") for i in range(25)]
    fetch = lambda cursor, n: [r for r in rows if cursor is None or r > tuple(cursor)][:n]
    for size in (1, 4, 25, 100):
        for a in (None, rows[0], rows[7], rows[-1]):
            for b in (None, rows[7], rows[11], rows[-1]):
                assert list(feed.stretch(fetch, a, b, size)) == [r for r in rows if b and r <= b and (a is None or r > a)]


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = sorted({(a, k): (a, k, d, r) for a, k, d, r in events(240, 2)}.values())
    fetch = lambda cursor, n: [r for r in rows if cursor is None or r[:2] > tuple(cursor)][:n]

    def run(upto):
        stream = feed.stream_feed(spark, f"feed{upto}", EVENTS, fetch, lambda: rows[upto - 1][:2] if upto else None, size=50)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()

    for upto in (0, 83, 120, len(rows), len(rows)):  # ends within pages; the last run finds nothing new
        run(upto)
        got = spark.read.schema(EVENTS).parquet(str(tmp_path / "out")) if upto else None
        if upto:
            assert sorted(map(tuple, got.collect())) == rows[:upto]
    assert folded(got)[1] == walked(rows)[0]
