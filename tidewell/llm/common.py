"""Column helpers shared by the training-data operators.

Words are maximal runs of characters other than space, tab, LF, VT, FF and CR.
Helper columns that the operators add are prefixed ``_tw_`` so that extra
columns of the input never clash with them.
"""

from __future__ import annotations

import gc
import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import shared_dir
from tidewell.sources.tables import load

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_or_empty(col: str | Column = "text") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def pieces(c: Column) -> Column:
    """A text cut at every white-space character, empty pieces included."""
    return F.split(F.coalesce(c, F.lit("")), r"[\x20\x09-\x0D]")


def words(c: Column) -> Column:
    """Words of a text in order; none or an empty text gives an empty array."""
    return F.array_remove(pieces(c), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_windows(df: DataFrame, col: str, n: int) -> DataFrame:
    """Replace the hash array ``col`` by the 64-bit hashes of its runs of ``n``
    elements (empty when shorter).  Runs are doubled step by step, so a run
    costs about log2(n) hashes; each step is a projection of its own, so no
    array is evaluated twice."""
    one, width = f"{col}1", 1
    d = df.withColumn(one, F.col(col))
    for bit in bin(n)[3:]:
        for other, step in [(col, width)] + ([(one, 1)] if bit == "1" else []):
            d = d.withColumn(col, F.zip_with(
                F.col(col), F.slice(F.col(other), 1 + width, F.size(other)),
                lambda p, q: F.xxhash64(p, q)))
            width += step
    return d.withColumn(col, F.slice(F.col(col), 1, F.greatest(F.size(col) - (n - 1), F.lit(0)))) \
        .drop(one)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


# Spark then deletes a query's shuffle files when the query has ended
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# Rows go to Python in batches of 10,000; whole texts need a limit in bytes
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the jobs of one block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: lineage is cut and a
    lost executor costs a reread, not a recompute.  The shuffle files of the write
    are deleted when it has ended, as nothing needs them any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark, 'llm', name, fresh=True)}/t"
    with setting(spark, _CLEANUP, "true"):
        # planned anew under the setting
        df.select("*").write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing will read again."""
    files = df.inputFiles()
    if files:
        sc = df.sparkSession.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop broadcasts and shuffles that nothing refers to any more;
    it does so shortly after the objects that stand for them are collected."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
