"""Top-k, records, samples."""

import datetime as dt

from pyspark.sql import functions as F

from tidewell.functions import columns as C
from tidewell.operators.topk import Extreme, extremes, hash_sample, top_rows
from tidewell.operators.windows import sample_per_group, top_categories, top_per_group


def test_top_per_group_tie_break(spark):
    df = spark.createDataFrame([("d1", 5, "b"), ("d1", 5, "a"), ("d1", 3, "c"), ("d2", 1, "z")],
                               "day string, v int, site string")
    out = top_per_group(df, ["day"], [F.desc("v"), F.asc("site")]).orderBy("day").collect()
    assert [(r.day, r.site) for r in out] == [("d1", "a"), ("d2", "z")]


def test_top_categories(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "c"), (2, "x"), (2, None)],
                               "cell int, cat string")
    out = top_categories(df, ["cell"], "cat", k=2).orderBy("cell", "rank").collect()
    assert [(r.cell, r.cat, r.n, r.rank) for r in out] == [(1, "a", 2, 1), (1, "b", 1, 2), (2, "x", 1, 1)]


def test_hash_sample_small_input_and_repeatable(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    assert hash_sample(df, 1000, "k").count() == 50
    a = [r.k for r in hash_sample(df, 10, "k").collect()]
    b = [r.k for r in hash_sample(df.repartition(7), 10, "k").collect()]
    assert a == b and len(a) == 10
    per = sample_per_group(df.withColumn("cell", F.col("k") % 3), ["cell"], "k", k=2)
    assert per.count() == 6


def test_extremes(spark):
    d = lambda i: dt.date(2020, 1, i)
    df = spark.createDataFrame([(d(1), 50.0, None), (d(2), 80.0, None), (d(3), 80.0, None),
                                (d(4), -5.0, None)], "obs_date date, t double, s double")
    specs = [Extreme(1, "Hottest", "t", True, lambda v: C.display_int(v, " °F")),
             Extreme(2, "Coldest", "t", False, lambda v: C.display_int(v, " °F")),
             Extreme(3, "Snowiest", "s", True, lambda v: C.display_round(v, 1, " in"))]
    out = [tuple(r) for r in extremes(df, "obs_date", specs).orderBy("sort_order").collect()]
    assert out == [(1, "Hottest", d(2), "80 °F"), (2, "Coldest", d(4), "-5 °F")]


def test_top_rows(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 7.0)], "k int, v double")
    assert [r.k for r in top_rows(df, [F.desc("v"), F.asc("k")], 2).collect()] == [2, 3]


def test_hash_sample_equals_brute_force(spark):
    import hashlib
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("g"))
    for n in (1, 37, 300, 4999, 5000, 6000):
        got = [r.k for r in hash_sample(df, n, "k", seed="s").collect()]
        want = sorted(range(5000), key=lambda k: (hashlib.md5(f"{k}s".encode()).hexdigest(), k))[:n]
        assert got == want, n
    rows = [r.g for r in hash_sample(df.select("g"), 3, None).collect()]
    assert len(rows) == 3


def test_top_rows_with_cutoff_equals_plain(spark):
    import datetime as dt
    rows = [(i, dt.date(2020, 1, 1 + (i * 7) % 28) if i % 5 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, d date")
    order = [F.desc("d"), F.asc("k")]
    for n in (1, 10, 57, 320, 400, 500):
        a = [tuple(r) for r in top_rows(df, order, n).collect()]
        b = [tuple(r) for r in top_rows(df, order, n, cutoff_key="d").collect()]
        assert a == b, n
