"""Data-quality checks and feed freshness as one report table.

Checks are declared as data (``Check``) and evaluated as Spark jobs:

* a table is read once for all of its own checks.  A row gives one entry per unique or
  unique-combination check (the check and the key) and one per row-level check
  (not_null, accepted_values, accepted_range) that it fails; entries are counted by
  (check, key), with a partial aggregate, and a check's failures are its keys
  counted more than once, or its failing rows;
* relationships (child -> parent) first reduce the child keys to distinct
  values, then run a ``left_anti`` join, so a hot child key costs one row.

The report has one row per check: table, check, column, failures, severity
and status (pass / warn / error).  ``raise_on_error`` fails a build.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

ROW_CHECKS = ("not_null", "accepted_values", "accepted_range")
OWN_CHECKS = (*ROW_CHECKS, "unique", "unique_combination")


@dataclass(frozen=True)
class Check:
    table: str
    kind: str                      # not_null | unique | accepted_values |
                                   # accepted_range | unique_combination | relationships
    columns: tuple[str, ...]
    severity: str = "error"        # error | warn
    values: tuple = ()             # accepted_values
    min_value: object = None       # accepted_range (inclusive)
    max_value: object = None
    parent: str | None = None      # relationships: parent table and column
    parent_column: str | None = None
    name: str = field(default="")

    @property
    def label(self) -> str:
        return self.name or self.kind


def _row_fails(chk: Check):
    """Whether a row fails a row-level check; NULL passes all but not_null."""
    c = F.col(chk.columns[0])
    if chk.kind == "not_null":
        return c.isNull()
    if chk.kind == "accepted_values":
        return c.isNotNull() & ~c.isin(*chk.values)
    limits = [c < F.lit(chk.min_value)] * (chk.min_value is not None) \
        + [c > F.lit(chk.max_value)] * (chk.max_value is not None)
    return F.coalesce(F.array_contains(F.array(F.lit(False), *limits), True), F.lit(False))


def _own_failures(df: DataFrame, checks: Sequence[tuple[int, Check]]) -> DataFrame:
    """(number, failures) of a table's own checks, in one pass; checks without any
    entry are left out."""
    entries = []
    for number, chk in checks:
        if chk.kind in ROW_CHECKS:
            key, there = F.lit(None).cast("array<string>"), _row_fails(chk)
        else:
            key = F.array(*[F.col(c).cast("string") for c in chk.columns])
            there = F.lit(True) if chk.kind == "unique_combination" else F.col(chk.columns[0]).isNotNull()
        entries.append(F.when(there, F.struct(F.lit(number).alias("number"), key.alias("key"))))
    keyed = F.col("number").isin([n for n, c in checks if c.kind not in ROW_CHECKS])
    return df.select(F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull()))) \
        .groupBy("number", "key").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("number").agg(F.sum(F.when(~keyed, F.col("n")).when(F.col("n") > 1, 1).otherwise(0)).alias("failures"))


def _orphans(tables: Mapping[str, DataFrame], chk: Check) -> DataFrame:
    """Rows whose key the parent lacks; child keys are counted before the join, so a hot
    key is one row."""
    child = F.col(chk.columns[0])
    parent = tables[chk.parent].select(F.col(chk.parent_column).alias("__k")) \
                               .filter(F.col("__k").isNotNull()).distinct()
    keys = (tables[chk.table].filter(child.isNotNull()).groupBy(child.alias("__k"))
                             .agg(F.count(F.lit(1)).alias("__rows")))
    return keys.join(parent, "__k", "left_anti") \
        .agg(F.coalesce(F.sum("__rows"), F.lit(0)).alias("failures"))


def quality_report(spark: SparkSession, tables: Mapping[str, DataFrame],
                   checks: Sequence[Check]) -> DataFrame:
    """Evaluate ``checks`` over ``tables``; one row per check with status."""
    if not checks:
        raise ValueError("no checks given")
    own: dict[str, list[tuple[int, Check]]] = {}
    parts: list[DataFrame] = []
    for number, chk in enumerate(checks):
        if chk.table not in tables:
            raise KeyError(f"check on unknown table {chk.table!r}")
        if chk.kind in OWN_CHECKS:
            own.setdefault(chk.table, []).append((number, chk))
        elif chk.kind == "relationships":
            parts.append(_orphans(tables, chk).select(F.lit(number).alias("number"), "failures"))
        else:
            raise ValueError(f"unknown check kind {chk.kind!r}")
    parts += [_own_failures(tables[name], some) for name, some in own.items()]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    listed = spark.createDataFrame([(n, c.table, c.label, ",".join(c.columns), c.severity)
                                    for n, c in enumerate(checks)],
                                   "number int, table_name string, check_name string, column_name string, "
                                   "severity string")
    # one row a check on both sides
    out = listed.join(found, "number", "left").select(
        "table_name", "check_name", "column_name",
        F.coalesce("failures", F.lit(0)).cast("bigint").alias("failures"), "severity")
    return out.withColumn(
        "status", F.when(F.col("failures") == 0, F.lit("pass")).otherwise(F.col("severity")))


def raise_on_error(report: DataFrame) -> DataFrame:
    """Fail when any error-severity check failed (warnings only report).

    Only the failing check rows (bounded by the number of checks) reach the
    driver.
    """
    bad = report.filter(F.col("status") == "error").collect()
    if bad:
        names = ", ".join(f"{r.table_name}.{r.column_name}:{r.check_name}={r.failures}" for r in bad)
        raise AssertionError(f"data-quality errors: {names}")
    return report


@dataclass(frozen=True)
class Freshness:
    feed: str
    ts_column: str
    warn_days: int
    error_days: int


def freshness_report(tables: Mapping[str, DataFrame], rules: Sequence[Freshness],
                     as_of: str) -> DataFrame:
    """Age of each feed's newest row against warn/error limits (FRS1).

    Limits are elapsed time: 30 days and 5 hours are more than 30 days.
    ``as_of`` is a fixed date or time so a report repeats; one ``max`` aggregate
    per feed; ``age_days`` are whole elapsed days.
    """
    newest = [tables[r.feed].agg(F.max(F.col(r.ts_column).cast("timestamp")).alias("newest")) for r in rules]
    return freshness_of(newest, rules, as_of)


def freshness_of(newest: Sequence[DataFrame], rules: Sequence[Freshness], as_of: str) -> DataFrame:
    """Status rows of feeds whose newest time is known, a one-row frame with ``newest``
    each, e.g. from a feed's ledger (``ledger.staged_span``) instead of its rows."""
    parts = []
    for one, r in zip(newest, rules, strict=True):
        age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("newest")) / F.lit(86_400_000_000)
        parts.append(one.select(
            F.lit(r.feed).alias("feed"), F.to_date("newest").alias("newest_date"),
            F.floor(age).cast("int").alias("age_days"),
            F.when(F.col("newest").isNull() | (age > r.error_days), F.lit("error"))
             .when(age > r.warn_days, F.lit("warn")).otherwise(F.lit("pass")).alias("status")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parse_failures(df: DataFrame, columns: Mapping[str, str], table: str = "") -> DataFrame:
    """Per text column, how many non-blank values the lenient cast to
    ``kind`` (double | int | bigint | timestamp | date | compact_date) turned
    into NULL.  Lenient typing never fails a load, so this count is what
    keeps bad text from going unnoticed.  One aggregate for all columns.
    """
    from tidewell.functions import columns as C
    casts = {"double": C.lenient_double, "int": C.lenient_int, "bigint": C.lenient_bigint,
             "timestamp": C.text_to_timestamp, "date": C.text_to_date,
             "compact_date": C.compact_date}
    aggs = []
    for i, (col, kind) in enumerate(columns.items()):
        text = F.col(col).cast("string")
        aggs += [F.count_if(F.nullif(F.trim(text), F.lit("")).isNotNull()).alias(f"n{i}"),
                 F.count_if(C.unparsed(text, casts[kind](text))).alias(f"f{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(table).alias("table_name"), F.lit(col).alias("column_name"),
                 F.lit(kind).alias("parsed_as"), F.col(f"n{i}").cast("bigint").alias("non_blank"),
                 F.col(f"f{i}").cast("bigint").alias("unparsed"))
        for i, (col, kind) in enumerate(columns.items())])
    return one.select(F.inline(rows))
