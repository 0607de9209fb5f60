"""Row counts and ranges from Parquet footers (AGG15, BLD1).

Every Parquet row group stores its row count and the least and largest value of each
column.  Read through Spark's second-generation source, ``count``, ``min`` and ``max``
without a filter are answered from there: the plan shows ``PushedAggregation`` and no
column is read, so the cost is one footer per file.  Spark takes this way for whole
numbers, floating point, booleans and dates; for the other types (texts, times) and
for a table with partition folders the same query reads just the columns asked for.

A load keeps the first and last time of what it staged in its ledger
(``ledger.staged_span``), which answers freshness without the table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

V1_SOURCES = "spark.sql.sources.useV1SourceList"


def read_for_footers(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose unfiltered count, min and max come from its footers."""
    first = spark.conf.get(V1_SOURCES)
    # the list is looked up while the table is opened; other reads keep theirs
    spark.conf.set(V1_SOURCES, ",".join(s for s in first.split(",") if s.strip() != "parquet"))
    try:
        spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        return spark.read.format("parquet").load(path)
    finally:
        spark.conf.set(V1_SOURCES, first)


def table_ranges(spark: SparkSession, tables: Mapping[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """table_name, column_name, row_count, least, largest (as text) of the named columns."""
    parts = []
    for name, (path, columns) in tables.items():
        df = read_for_footers(spark, path)
        one = df.agg(F.count(F.lit(1)).alias("n"),
                     *[f(c).alias(f"{at}{i}") for i, c in enumerate(columns) for f, at in ((F.min, "a"), (F.max, "b"))])

        def text(c: str) -> Column:
            return F.col(c).cast("string")
        parts.append(one.select(F.inline(F.array(*[
            F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.col("n").alias("row_count"),
                     text(f"a{i}").alias("least"), text(f"b{i}").alias("largest")) for i, c in enumerate(columns)]))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
