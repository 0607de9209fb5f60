"""Answers in one pass: distinct counts, a table's checks, footers, bucketed joins."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tidewell.operators import aggregates as A
from tidewell.operators.bucketed import bucketed_orphans, open_bucketed, write_bucketed
from tidewell.operators.quality import Check, quality_report
from tidewell.operators.topk import top_rows
from tidewell.sources.footers import V1_SOURCES, read_for_footers


def plan(spark, df) -> str:
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_distincts_of_every_kind(spark):
    day = dt.date(1969, 12, 30)
    rows = [(i % 5 - 2, None if i % 7 == 0 else (i % 11) * 64 - 320, day + dt.timedelta(i % 9), f"t{i % 3}" if i % 2 else None,
             [0.0, -0.0, 1.5, float("nan")][i % 4], i % 3 == 0, dt.datetime(1960, 1, 1 + i % 13), "ab"[i % 2])
            for i in range(400)] + [(None,) * 7 + ("c",)]
    df = spark.createDataFrame(rows, "a int, b bigint, d date, t string, x double, f boolean, ts timestamp, g string")
    cols = ["a", "b", "d", "t", "x", "f", "ts"]
    for by in ([], ["g"]):
        got = A.distinct_row(df, {c: c for c in cols}, {"n": F.lit(1), "s": F.col("a")}, by)
        want = df.groupBy(*by).agg(*[F.count_distinct(c).alias(c) for c in cols], F.count(F.lit(1)).alias("n"),
                                   F.sum("a").alias("s"))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    extremes = spark.createDataFrame([(2 ** 63 - 1,), (-2 ** 63,), (-1,), (0,), (63,), (64,), (-64,), (-65,)], "v bigint")
    assert A.distinct_row(extremes.union(extremes), {"v": "v"}).first()["v"] == 8
    none = A.distinct_row(df.limit(0), {"a": "a"}, {"n": F.lit(1)}).collect()
    assert [(r["a"], r["n"]) for r in none] == [(0, None)]


def test_distincts_read_once_without_expand(spark, sf_small):
    for name in ("summary_row", "distincts_by_group"):
        text = plan(spark, E.queries()[name](spark, sf_small))
        assert "Expand" not in text and text.count("Scan parquet") == 2, name       # tree and detail
        assert "bit_or" in text


def test_checks_of_a_table_read_it_once(spark, tmp_path):
    rows = [(i, i % 10, None if i % 4 == 0 else i % 3, i * 1.0) for i in range(100)] + [(5, 5, 1, 999.0), (None, None, None, None)]
    spark.createDataFrame(rows, "k int, a int, b int, x double").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    checks = [Check("t", "unique", ("k",)), Check("t", "unique", ("a",)), Check("t", "unique_combination", ("a", "b")),
              Check("t", "not_null", ("b",)), Check("t", "accepted_range", ("x",), max_value=500.0),
              Check("t", "accepted_values", ("b",), values=(0, 1)), Check("t", "accepted_range", ("k",), min_value=0)]
    report = quality_report(spark, {"t": t}, checks)
    assert plan(spark, report).count("Scan parquet") == 2
    dups = t.groupBy("a", "b").count().where("count > 1").count()
    got = [(r.check_name, r.column_name, r.failures) for r in report.collect()]
    assert sorted(got) == sorted([
        ("unique", "k", 1), ("unique", "a", 10), ("unique_combination", "a,b", dups), ("not_null", "b", 26),
        ("accepted_range", "x", 1), ("accepted_values", "b", t.where("b = 2").count()), ("accepted_range", "k", 0)])


def test_footers_answer_without_columns(spark, sf_small, tmp_path):
    text = plan(spark, E.queries()["footer_ranges"](spark, sf_small))
    assert text.count("PushedAggregation: [COUNT(*)") == 4
    assert not re.search(r"ReadSchema: struct<[a-z]_", text)
    df = spark.createDataFrame([(1, dt.date(2024, 5, 6), "a"), (None, None, "b")], "k int, d date, t string")
    df.write.parquet(str(tmp_path / "t"))
    before = spark.conf.get(V1_SOURCES)
    r = read_for_footers(spark, str(tmp_path / "t"))
    assert spark.conf.get(V1_SOURCES) == before
    assert "PushedAggregation: [MAX(d)" in plan(spark, r.agg(F.max("d")))
    assert tuple(r.agg(F.count(F.lit(1)), F.max("d"), F.min("k"), F.max("t")).first()) == (2, dt.date(2024, 5, 6), 1, "b")


def test_bucketed_tables_join_without_exchange(spark, sf_small, tmp_path):
    text = plan(spark, E.queries()["orphans_bucketed"](spark, sf_small))
    assert "Exchange" not in text and "SortMergeJoin" in text and "LeftAnti" in text
    child = spark.createDataFrame([(1,), (1,), (9,), (9,), (9,), (None,)], "k int")
    write_bucketed(child, "tw_test_child", str(tmp_path / "c"), "k", 3, one_file=False)
    write_bucketed(spark.range(5).selectExpr("int(id) as k"), "tw_test_parent", str(tmp_path / "p"), "k", 3)
    try:
        assert [tuple(r) for r in bucketed_orphans(spark.table("tw_test_child"), spark.table("tw_test_parent"), "k").collect()] \
            == [(9, 3)]
        again = open_bucketed(spark, "tw_test_again", str(tmp_path / "p"), "k int", "k", 3)
        got = bucketed_orphans(spark.table("tw_test_child"), again, "k")
        assert "Exchange" not in plan(spark, got) and [tuple(r) for r in got.collect()] == [(9, 3)]
    finally:
        for t in ("tw_test_child", "tw_test_parent", "tw_test_again"):
            spark.sql(f"drop table if exists {t}")


@pytest.mark.parametrize("n", [1, 5, 37, 200])
def test_top_rows_by_a_key_of_any_size(spark, n):
    df = spark.range(100).selectExpr("id", "if(id % 9 = 0, null, id * 37 % 101) as k")
    want = [r["id"] for r in df.orderBy(F.desc_nulls_last("k"), "id").limit(n).collect()]
    got = top_rows(df, [F.desc_nulls_last("k"), F.asc("id")], n, cutoff_key="k")
    assert [r["id"] for r in got.collect()] == want
