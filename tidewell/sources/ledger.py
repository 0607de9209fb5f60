"""Append-only staging with a ledger of landed files (INC1, SNK4).

A feed's folder of landed files only grows, or files in it are landed again.
``stage_new`` compares the listing (names, sizes, times; no file is opened) with
the ledger, parses the files that are new or changed, and appends their rows as one
batch:

    <store>/rows/batch=3/[stage_month=2024-05-01/]...    typed rows and their source_file
    <store>/ledger/batch=3/...                           one row a file
    <store>/committed/00000003                           the batch counts from here on

The marker is created last.  A load that fails before it leaves a batch that nobody
reads; the next load takes the same number and overwrites it.  So a landed file is
counted exactly once however often a load is repeated.  A ledger row keeps the
file's rows, its first and last time and its months, so what a batch touched, how
fresh a feed is and how many rows it has are answered from the ledger alone.

A file landed again under its name (other size or time) replaces its rows:
``read_staged`` leaves out the rows of the older batch.  A file that is gone from the
folder keeps its rows; landing folders may be cleared.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.operators.aggregates import month_start
from tidewell.operators.versions import DIGITS, create_marker, names_in, write_counted

STAGE_MONTH = "stage_month"
OWN_COLUMNS = ("batch", "source_file", STAGE_MONTH)
SMALL_FILES = 100_000           # superseded files up to which their list is broadcast


@dataclass(frozen=True)
class Load:
    """What one ``stage_new`` did; ``months`` are those whose rows changed."""
    batch: int | None = None
    files: int = 0
    rows: int = 0
    months: tuple[date, ...] = field(default=())


def landed_files(spark: SparkSession, path: str) -> DataFrame:
    """file, path, length, modified of every file under ``path``.  Only the listing is
    used: the content column is never asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        F.col("_metadata.file_path").alias("file"), "path",
        F.col("length").alias("length"), F.unix_micros("modificationTime").alias("modified"))


def committed(spark: SparkSession, store: str) -> int:
    """The last batch that counts; 0 before the first."""
    done = names_in(spark, f"{store}/committed", folders=False)
    return int(done[-1]) if done else 0


def read_ledger(spark: SparkSession, store: str) -> DataFrame | None:
    """One row per landed version of a file; None before the first load."""
    last = committed(spark, store)
    if not last:
        return None
    return spark.read.parquet(f"{store}/ledger").where(F.col("batch") <= last)


def _older(ledger: DataFrame) -> DataFrame:
    """(source_file, batch) of versions that a later batch replaced."""
    newest = ledger.groupBy("file").agg(F.max("batch").alias("newest"))
    return ledger.join(newest, "file").where("batch < newest") \
        .select(F.col("file").alias("source_file"), "batch")


def read_staged(spark: SparkSession, store: str, own_columns: bool = False) -> DataFrame:
    """Rows of all committed batches, without those of replaced files."""
    last = committed(spark, store)
    if not last:
        raise FileNotFoundError(f"nothing is staged under {store}")
    rows = spark.read.parquet(f"{store}/rows").where(F.col("batch") <= last)
    older = _older(read_ledger(spark, store))
    n = older.limit(SMALL_FILES + 1).count()
    if n:
        rows = rows.join(F.broadcast(older) if n <= SMALL_FILES else older,
                         ["source_file", "batch"], "left_anti")
    if STAGE_MONTH in rows.columns:
        rows = rows.withColumn(STAGE_MONTH, F.col(STAGE_MONTH).cast("date"))
    return rows if own_columns else rows.drop(*OWN_COLUMNS)


def stage_new(spark: SparkSession, landing: str, store: str,
              read: Callable[[Sequence[str]], DataFrame], ts_col: str | None = None) -> Load:
    """Parse and append the files of ``landing`` that the ledger does not have.

    ``read`` gets their paths and returns typed rows, made from the files by
    projections, filters and unfolding only, so that each row still knows its file.
    With ``ts_col`` the rows are stored by month.  Files without a single row raise
    together; some empty files among others are kept in the ledger with 0 rows.
    """
    landed, known = landed_files(spark, landing), read_ledger(spark, store)
    fresh = landed if known is None else landed.join(
        known.select("file", "length", "modified"), ["file", "length", "modified"], "left_anti")
    found = fresh.select(*landed.columns).collect()      # the listing of new files, as the reader needs it
    if not found:
        return Load()
    batch = committed(spark, store) + 1
    rows = read([r["path"] for r in found]).withColumn("source_file", F.col("_metadata.file_path"))
    by = ()
    if ts_col:
        rows, by = rows.withColumn(STAGE_MONTH, month_start(ts_col)), (STAGE_MONTH,)
    target = f"{store}/rows/batch={batch}"
    got = write_counted(rows, target, by, landing, mode="overwrite")
    # the batch's own columns give the ledger its figures; landed files are not read again
    written = spark.read.parquet(target)
    measures = [F.count(F.lit(1)).alias("rows")]
    none = F.lit(None)
    if ts_col:
        measures += [F.min(ts_col).cast("timestamp").alias("first"), F.max(ts_col).cast("timestamp").alias("last"),
                     F.array_sort(F.collect_set(F.col(STAGE_MONTH).cast("date"))).alias("months")]
    else:
        measures += [F.max(none.cast("timestamp")).alias("first"), F.max(none.cast("timestamp")).alias("last"),
                     F.max(F.array().cast("array<date>")).alias("months")]
    figures = written.groupBy(F.col("source_file").alias("file")).agg(*measures)
    listing = spark.createDataFrame(found, landed.schema)
    listing.join(figures, "file", "left") \
        .select("file", "path", "length", "modified", F.coalesce("rows", F.lit(0)).alias("rows"), "first", "last",
                F.coalesce("months", F.array().cast("array<date>")).alias("months")) \
        .coalesce(1).write.mode("overwrite").parquet(f"{store}/ledger/batch={batch}")
    create_marker(spark, f"{store}/committed/{batch:0{DIGITS}d}")
    return Load(batch, len(found), got["rows"], months_since(spark, store, batch - 1) if ts_col else ())


def months_since(spark: SparkSession, store: str, batch: int) -> tuple[date, ...]:
    """Months whose rows changed in the batches after ``batch``: those of their files, and
    those that earlier versions of these files had."""
    ledger = read_ledger(spark, store)
    files = ledger.where(F.col("batch") > batch).select("file").distinct()
    rows = ledger.join(files, "file", "left_semi").select(F.explode("months").alias("m")).distinct()
    return tuple(sorted(r["m"] for r in rows.collect()))


def staged_span(spark: SparkSession, store: str) -> DataFrame:
    """rows, files, first and last time of a feed from its ledger alone (FRS1, AGG15)."""
    ledger = read_ledger(spark, store)
    newest = ledger.groupBy("file").agg(F.max_by(F.struct("rows", "first", "last"), "batch").alias("x"))
    return newest.agg(F.coalesce(F.sum("x.rows"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("files"),
                      F.min("x.first").alias("first"), F.max("x.last").alias("last"))
