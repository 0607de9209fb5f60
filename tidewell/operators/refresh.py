"""Month-partitioned summary tables: full build and trailing-window refresh.

A summary table lives as Parquet partitioned by its month column, in the current
copy of a versioned table.  A full build (INC2) writes a new copy that readers see
when it is whole.  A refresh (INC1) reads the newest month
already in the table, steps back ``lookback_months``, re-aggregates only the
source rows at or after that cutoff and replaces exactly those months with a
dynamic partition overwrite.  Running a refresh twice gives the same table;
months older than the window are left as they are until the next full build.

The cutoff is materialised (one scalar) before the write, so a plan never
reads and overwrites the same path.  Spark's dynamic overwrite stages the new
files and moves each month in at job commit; a failed job leaves the old
months untouched and a lost executor only re-runs its tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.operators import versions

Rollup = Callable[[DataFrame], DataFrame]


def _replace_months(df: DataFrame, path: str, month_col: str) -> None:
    # cluster rows by month (few files per month folder) while letting AQE
    # split a month that is much larger than the others
    (df.hint("rebalance", month_col)
       .write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic")
       .partitionBy(month_col)
       .parquet(versions.current_path(df.sparkSession, path)))


def read_table(spark: SparkSession, path: str, month_col: str) -> DataFrame:
    """Read a month-partitioned table back with the month as DATE; a plain folder
    without copies (as the stream keeps it) is read as it is."""
    df = spark.read.parquet(versions.current_path(spark, path) if versions.exists(spark, path) else path)
    return df.withColumn(month_col, F.col(month_col).cast("date"))


def full_build(source: DataFrame, rollup: Rollup, path: str, month_col: str) -> None:
    """INC2: rebuild every month from the whole source."""
    versions.replace_table(rollup(source), path, [month_col])


def refresh_cutoff(spark: SparkSession, path: str, month_col: str,
                   lookback_months: int = 1):
    """First day of the oldest month to rebuild, or None for an empty table."""
    try:
        target = read_table(spark, path, month_col)
    except AnalysisException as exc:
        # only a missing folder or one without data files is an empty table
        if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    last = target.agg(F.max(month_col)).first()[0]
    if last is None:
        return None
    return shift_month(last, -lookback_months)


def shift_month(d, k: int):
    """First day of the month ``k`` months after the month of ``d``."""
    years, month0 = divmod(d.month - 1 + k, 12)
    return d.replace(year=d.year + years, month=month0 + 1, day=1)


def window_rows(source: DataFrame, ts_col: str, cutoff, partition_col: str | None = None) -> DataFrame:
    """Source rows at or after ``cutoff``.  The cutoff is compared in the
    column's own type so the filter reaches the Parquet scan; with
    ``partition_col`` (a month partition column of the source) the same
    cutoff also prunes whole month folders."""
    ts_type = dict(source.dtypes)[ts_col]
    rows = source.filter(F.col(ts_col) >= F.lit(cutoff).cast(ts_type))
    if partition_col:
        rows = rows.filter(F.col(partition_col) >= F.lit(cutoff).cast("date"))
    return rows


def refresh(spark: SparkSession, source: DataFrame, ts_col: str, rollup: Rollup,
            path: str, month_col: str, lookback_months: int = 1,
            partition_col: str | None = None) -> dict:
    """INC1: rebuild the trailing window of months from ``source``.

    Returns the cutoff used and the mode.  An empty target falls back to a
    full build.  See :func:`window_rows` for how the window is read.
    """
    cutoff = refresh_cutoff(spark, path, month_col, lookback_months)
    if cutoff is None:
        full_build(source, rollup, path, month_col)
        return {"cutoff": None, "mode": "full"}
    _replace_months(rollup(window_rows(source, ts_col, cutoff, partition_col)), path, month_col)
    return {"cutoff": cutoff, "mode": "incremental"}


def refresh_months(spark: SparkSession, staged: DataFrame, months: Sequence[date], rollup: Rollup,
                   path: str, month_col: str, partition_col: str) -> dict:
    """Rebuild exactly ``months`` from staging stored by ``partition_col``.

    Only the folders of those months are read.  A month that has no rows any more
    (its file was landed again without them) leaves the table.
    """
    if not versions.exists(spark, path):
        full_build(staged.where(F.col(partition_col).isNotNull()), rollup, path, month_col)
        return {"mode": "full", "months": None}
    if not months:
        return {"mode": "none", "months": ()}
    rows = staged.where(F.col(partition_col).isin(list(months)))
    left = {r[0] for r in rows.select(partition_col).distinct().collect()}
    if left:
        _replace_months(rollup(rows), path, month_col)
    versions.drop_folders(spark, [f"{versions.current_path(spark, path)}/{month_col}={m.isoformat()}"
                                  for m in sorted(set(months) - left)])
    return {"mode": "months", "months": tuple(months)}
