"""Trailing-window month refresh: full == incremental == incremental twice."""

import datetime as dt

from pyspark.sql import functions as F

from tidewell.operators import aggregates as A
from tidewell.operators.refresh import full_build, read_table, refresh
from tidewell.session import shared_dir


def rollup(df):
    return A.month_rollup(df, "ts", "m", {"n": F.count(F.lit(1)), "total": F.sum("v")})


def rows(spark, path):
    return sorted(tuple(r) for r in read_table(spark, path, "m").select("m", "n", "total").collect())


def test_refresh_idempotent_and_window(spark):
    ts = lambda y, m, d: dt.datetime(y, m, d, 12)
    base = [(ts(2024, 1, 5), 1), (ts(2024, 2, 5), 2), (ts(2024, 3, 5), 3)]
    src0 = spark.createDataFrame(base, "ts timestamp, v int")
    path = shared_dir(spark, "test_refresh", fresh=True)
    full_build(src0, rollup, path, "m")
    # late rows: one inside the window (February), one outside (January), one new month
    late = base + [(ts(2024, 2, 20), 10), (ts(2024, 1, 20), 100), (ts(2024, 4, 1), 4)]
    src1 = spark.createDataFrame(late, "ts timestamp, v int")
    info = refresh(spark, src1, "ts", rollup, path, "m")
    assert info["cutoff"] == dt.date(2024, 2, 1)
    once = rows(spark, path)
    refresh(spark, src1, "ts", rollup, path, "m")
    twice = rows(spark, path)
    assert once == twice
    # January is outside the window and keeps its old value until a full build
    jan = [r for r in twice if r[0] == dt.date(2024, 1, 1)]
    assert jan == [(dt.date(2024, 1, 1), 1, 1)]
    full = shared_dir(spark, "test_refresh_full", fresh=True)
    full_build(src1, rollup, full, "m")
    expect = rows(spark, full)
    assert [r for r in twice if r[0] >= dt.date(2024, 3, 1)] == \
           [r for r in expect if r[0] >= dt.date(2024, 3, 1)]
    # a second refresh only touches its window, so repeating it changes nothing
    refresh(spark, src1, "ts", rollup, path, "m")
    assert rows(spark, path) == twice


def test_refresh_of_empty_target_is_full_build(spark):
    src = spark.createDataFrame([(dt.datetime(2024, 5, 2), 7)], "ts timestamp, v int")
    path = shared_dir(spark, "test_refresh_empty", fresh=True)
    assert refresh(spark, src, "ts", rollup, path, "m")["mode"] == "full"
    assert rows(spark, path) == [(dt.date(2024, 5, 1), 1, 7)]
