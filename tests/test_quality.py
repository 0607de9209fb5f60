"""Data-quality report and freshness."""

import datetime as dt

import pytest

from tidewell.operators.quality import (Check, Freshness, freshness_report, quality_report,
                                        raise_on_error)


def test_report(spark):
    child = spark.createDataFrame(
        [(1, "a", 5.0, 1), (1, "b", 50.0, 1), (2, None, None, 9), (None, "a", 1.0, None)],
        "k int, v string, x double, p int")
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    checks = [
        Check("child", "not_null", ("k",)),
        Check("child", "unique", ("k",), severity="warn"),
        Check("child", "accepted_values", ("v",), values=("a",)),
        Check("child", "accepted_range", ("x",), min_value=0, max_value=10),
        Check("child", "unique_combination", ("k", "v")),
        Check("child", "relationships", ("p",), parent="parent", parent_column="id"),
        Check("parent", "unique", ("id",)),
    ]
    rep = quality_report(spark, {"child": child, "parent": parent}, checks)
    got = {(r.table_name, r.check_name, r.column_name): (r.failures, r.status) for r in rep.collect()}
    assert got[("child", "not_null", "k")] == (1, "error")
    assert got[("child", "unique", "k")] == (1, "warn")
    assert got[("child", "accepted_values", "v")] == (1, "error")
    assert got[("child", "accepted_range", "x")] == (1, "error")
    assert got[("child", "unique_combination", "k,v")] == (0, "pass")
    assert got[("child", "relationships", "p")] == (1, "error")
    assert got[("parent", "unique", "id")] == (0, "pass")
    with pytest.raises(AssertionError, match="data-quality errors"):
        raise_on_error(rep)


def test_freshness(spark):
    t = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 2, 1),)], "d date")
    e = spark.createDataFrame([], "d date")
    out = freshness_report({"t": t, "e": e},
                           [Freshness("t", "d", 10, 20), Freshness("e", "d", 1, 2)],
                           "2024-02-15").collect()
    assert [(r.feed, r.age_days, r.status) for r in out] == [("t", 14, "warn"), ("e", None, "error")]
