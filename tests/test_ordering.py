"""Global places by ranges of equal depth."""

from pyspark.sql import functions as F

from mnemodex.operators.evaluation import percentile_lower
from mnemodex.operators.ordering import in_ranges, number_rows


def test_places_of_skewed_rows(spark):
    # a third are one key, one value lies far out, and there are nulls
    d = spark.range(0, 30_000, 1, 6).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") == 1, 1 << 50).when(F.col("id") % 50 == 2, None).otherwise(F.col("id") * 37 % 1009).cast("long").alias("v"))
    got = number_rows(d, F.col("v").desc_nulls_last(), "id", name="place").orderBy("place").collect()
    want = sorted(d.collect(), key=lambda r: (r.v is None, -(r.v or 0), r.id))
    assert [r.place for r in got] == list(range(30_000))
    assert [(r.id, r.v) for r in got] == [(r.id, r.v) for r in want]


def test_equal_rows_are_split(spark):
    d = spark.range(0, 20_000, 1, 4).select(F.lit(1).alias("v"))
    got = number_rows(d, "v", parts=8)
    assert sorted(r.number for r in got.collect()) == list(range(20_000))
    sizes = [r["count"] for r in in_ranges(d, "v", parts=8).groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8


def test_places_of_no_rows_and_clashing_names(spark):
    assert number_rows(spark.range(0), "id").collect() == []
    d = spark.createDataFrame([(2, "a"), (1, "b")], "part_ long, number string")
    assert sorted(map(tuple, number_rows(d, "part_").collect())) == [(1, 0), (2, 1)]


def test_percentiles_of_skewed_keys(spark):
    import random

    r = random.Random(3)
    rows = [(r.choice(["hot"] * 6 + ["a", "b", None]), r.choice([1, 1, 2, r.randrange(1000), None])) for _ in range(4000)] + [("one", 5), ("none", None)]
    d = spark.createDataFrame(rows, "k string, v long").repartition(5)
    for p in (0.0, 0.5, 0.95, 1.0):
        want = {}
        for k in {k for k, _ in rows}:
            v = sorted(v for j, v in rows if j == k and v is not None)
            if v:
                want[k] = v[int(p * (len(v) - 1))]
        assert {x.k: x.value for x in percentile_lower(d, "v", "k", p).collect()} == want
    plan = percentile_lower(d, "v", "k", 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == plan.count("Window [sum(n#") == 2  # over the counts of keys in ranges
