"""Tables bucketed by their key, for relationship checks against large parents (JON5, DQ5).

A join on a key normally shuffles both sides.  Tables that are checked again and again
can be stored so that equal keys already lie together: ``write_bucketed`` deals the
rows into a fixed number of buckets by a hash of the key, each sorted.  Two tables
bucketed alike are grouped and joined bucket by bucket; the plan has no exchange.

The bucket count is part of the data, so it is chosen from the size to come (about
128 MB of the key column and its row count a bucket), not from today's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int,
                   one_file: bool = True) -> DataFrame:
    """Write ``df`` as the catalogue table ``name`` at ``path``, bucketed by ``key``.

    With ``one_file`` rows are dealt by the key first, one task and one file a bucket: for
    keys without hot values, such as a parent's.  Without it each task writes its share
    of every bucket: no task gets all rows of a hot key.
    """
    rows = df.repartition(buckets, F.col(key)) if one_file else df
    rows.write.mode("overwrite").format("parquet").option("path", path) \
        .bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def open_bucketed(spark: SparkSession, name: str, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """Register a table written earlier (by another session) under ``name``."""
    spark.sql(f"create table if not exists {name} ({schema}) using parquet "
              f"clustered by ({key}) sorted by ({key}) into {int(buckets)} buckets location '{path}'")
    return spark.table(name)


def bucketed_orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Keys of ``child`` that ``parent`` lacks, with their rows: ``key``, n.  NULL keys
    refer to nothing.  Between tables bucketed alike by ``key`` nothing is shuffled; a
    hot child key is counted down to one row before the join."""
    keys = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # a plain merge join: broadcasting the parent would bound its size
    return keys.join(parent.select(key).where(F.col(key).isNotNull()).hint("merge"), key, "left_anti")
