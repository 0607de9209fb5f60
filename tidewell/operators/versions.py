"""Tables that are replaced as a whole and never leave a hole (SNK1, SNK3).

A table is a folder of complete copies and of markers:

    <table>/copies/00000007/...parquet
    <table>/current/00000007

A replacement writes its copy first, in one job that also counts the rows, and
then creates the marker.  Readers resolve the highest marker when they open the
table, so they see the old copy until the marker is there and keep what they
opened afterwards.  A build that fails leaves a copy without marker: nobody reads
it, and the next replacement takes a new number.  Creating a file that must not
exist yet is atomic on HDFS, local disks and object stores; of two writers that
took the same number, one fails.  The last ``keep`` copies stay for readers that
are still at work.

All folders are reached through Hadoop's file systems, never by local paths.
"""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

COPIES, CURRENT, DIGITS = "copies", "current", 8


class EmptyFeed(ValueError):
    """A load produced zero rows."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def names_in(spark: SparkSession, path: str, folders: bool = True) -> list[str]:
    """Sorted names of the sub-folders (or files) of ``path``; none if it is missing."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() == folders)


def create_marker(spark: SparkSession, path: str) -> None:
    """Create an empty file; raises if it exists."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    fs.create(p, False).close()


def current_number(spark: SparkSession, table: str) -> int | None:
    done = [n for n in names_in(spark, f"{table}/{CURRENT}", folders=False) if n.isdigit()]
    return int(done[-1]) if done else None


def copy_path(table: str, number: int) -> str:
    return f"{table}/{COPIES}/{number:0{DIGITS}d}"


def current_path(spark: SparkSession, table: str) -> str:
    """Folder of the copy that readers see; raises when nothing was published."""
    number = current_number(spark, table)
    if number is None:
        raise FileNotFoundError(f"no published copy of {table}")
    return copy_path(table, number)


def exists(spark: SparkSession, table: str) -> bool:
    return current_number(spark, table) is not None


def new_copy(spark: SparkSession, table: str) -> int:
    """The next free number, counting copies that were never published."""
    taken = [int(n) for n in names_in(spark, f"{table}/{COPIES}") if n.isdigit()]
    return max([current_number(spark, table) or 0, *taken]) + 1


def publish(spark: SparkSession, table: str, number: int, keep: int = 2) -> str:
    """Make copy ``number`` the current one and drop copies older than the last ``keep``."""
    create_marker(spark, f"{table}/{CURRENT}/{number:0{DIGITS}d}")
    published = [n for n in names_in(spark, f"{table}/{CURRENT}", folders=False) if n.isdigit()]
    for old in published[:-keep]:
        drop_folders(spark, [copy_path(table, int(old)), f"{table}/{CURRENT}/{old}"])
    return copy_path(table, number)


def drop_folders(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete folders or files; missing ones are no error."""
    for path in paths:
        fs, p = _fs(spark, path)
        fs.delete(p, True)


def write_counted(df: DataFrame, path: str, partition_by: Sequence[str] = (), what: str | None = None,
                  mode: str = "errorifexists", **measures) -> dict:
    """Write ``df`` as Parquet and return {"rows": n, **measures} of the written rows,
    observed by the write itself: no job beside it.  With ``what``, zero rows
    raise (SRC13); the files stay unpublished."""
    seen = Observation()
    df = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in measures.items()])
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).option("partitionOverwriteMode", "static")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    try:
        got = seen.get
    except Py4JJavaError:
        # a stage that turned out empty is dropped from the running plan, its counts with it
        got = {"rows": 0, **{k: None for k in measures}}
    if what is not None and not got["rows"]:
        raise EmptyFeed(f"{what} returned zero rows")
    return got


def replace_table(df: DataFrame, table: str, partition_by: Sequence[str] = (), guard: bool = False,
                  keep: int = 2, **measures) -> dict:
    """Replace a table by ``df``; readers see the old copy until all of it is written.
    ``df`` may read the table itself.  With ``guard``, zero rows raise and the old
    copy stays.  Returns the counts of :func:`write_counted`."""
    spark = df.sparkSession
    number = new_copy(spark, table)
    got = write_counted(df, copy_path(table, number), partition_by, table if guard else None, **measures)
    publish(spark, table, number, keep)
    return got


def read_table(spark: SparkSession, table: str, schema=None) -> DataFrame:
    """The current copy of a table."""
    reader = spark.read.schema(schema) if schema else spark.read
    try:
        return reader.parquet(current_path(spark, table))
    except AnalysisException as exc:
        # a copy without rows and partitions holds no file that tells the columns
        raise ValueError(f"{table}: the current copy cannot be read without a schema") from exc
