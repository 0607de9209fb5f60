"""Keep a month-keyed summary table current as feed files land.

A file stream watches a landing folder.  Each micro-batch is typed by the
caller's ``stage`` function and written to a staging folder of its own
(``batch_id``, within it by month) — a retried batch overwrites only that folder,
so a batch is stored exactly once.  The months the batch touched are swapped into the
summary table with a dynamic partition overwrite; late rows of any age are counted
and replays are idempotent.  How a month is made anew depends on the rollup:

* :class:`Mergeable`: the batch's own rows are summed up and merged with the state
  that the batch before left (a row per month), so a batch costs its own size
  however long the history is.  Each batch writes a state of its own and a retried
  one starts from the same state before it, so nothing is counted twice;
* a plain function: the months are re-aggregated from all their staged rows (read
  by partition pruning); only the list of touched months reaches the driver.

Offsets and the file log live in a checkpoint folder under the
shared directory, so a restarted job resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.operators.aggregates import month_start
from tidewell.operators.versions import drop_folders, names_in
from tidewell.session import shared_dir

Stage = Callable[[DataFrame], DataFrame]
Rollup = Callable[[DataFrame], DataFrame]
LAST_BATCH = "last_batch"
STATES_KEPT = 2


@dataclass(frozen=True)
class Mergeable:
    """A rollup whose rows can be merged: ``partial`` sums rows up by month, ``merge``
    gives the measures that make one row of several of a month, ``finish`` makes the
    table's rows."""
    partial: Rollup
    merge: dict[str, Column]
    finish: Rollup


def _merged(spark: SparkSession, rollup: Mergeable, staging_path: str, state_path: str,
            month_col: str, batch_id: int) -> DataFrame:
    """State after a batch, stored: a row per month, with the last batch that had rows of it."""
    def staged(path):
        return spark.read.option("basePath", staging_path).parquet(path)
    before = sorted(i for i in (int(n.partition("=")[2]) for n in names_in(spark, state_path)) if i < batch_id)
    # a table kept without states so far: the first is made of all that is staged
    own = staged(f"{staging_path}/batch_id={batch_id}") if before or not batch_id else \
        staged(staging_path).where(F.col("batch_id") <= batch_id)
    rows = rollup.partial(own.drop("stage_month", "batch_id")).withColumn(LAST_BATCH, F.lit(batch_id).cast("bigint"))
    if before:
        rows = rows.unionByName(spark.read.parquet(f"{state_path}/batch_id={before[-1]}"))
    target = f"{state_path}/batch_id={batch_id}"
    (rows.groupBy(month_col).agg(*[c.alias(k) for k, c in rollup.merge.items()], F.max(LAST_BATCH).alias(LAST_BATCH))
         .coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(target))
    drop_folders(spark, [f"{state_path}/batch_id={i}" for i in before[:-STATES_KEPT]])
    return spark.read.parquet(target)


def start_month_refresh(spark: SparkSession, landing_dir: str, schema, stage: Stage,
                        ts_col: str, rollup: Rollup | Mergeable, staging_path: str, table_path: str,
                        month_col: str, name: str = "month_refresh", fmt: str = "csv",
                        options: dict | None = None, max_files_per_trigger: int | None = None,
                        available_now: bool = True,
                        checkpoint: str | None = None) -> StreamingQuery:
    """Start the stream; returns the running query (``awaitTermination`` it
    for an ``available_now`` run)."""
    reader = spark.readStream.format(fmt).schema(schema)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    source = reader.load(landing_dir)

    def apply(batch: DataFrame, batch_id: int) -> None:
        staged = stage(batch).withColumn("stage_month", month_start(ts_col))
        # a folder a batch: a retried batch overwrites only its own; months within it,
        # so that a month's history is found by partition pruning
        (staged.hint("rebalance", "stage_month")
               .write.mode("overwrite").option("partitionOverwriteMode", "static")
               .partitionBy("stage_month").parquet(f"{staging_path}/batch_id={batch_id}"))
        # the batch is read back, not parsed a second time; its months are folder names
        if not any(n.startswith("stage_month=") and not n.endswith("=__HIVE_DEFAULT_PARTITION__")
                   for n in names_in(spark, f"{staging_path}/batch_id={batch_id}")):
            return
        if isinstance(rollup, Mergeable):
            state = _merged(spark, rollup, staging_path, f"{staging_path}_state", month_col, batch_id)
            rows = rollup.finish(state.where(F.col(LAST_BATCH) >= batch_id).drop(LAST_BATCH))
        else:
            stored = spark.read.parquet(staging_path)
            touched = [r[0] for r in stored.filter((F.col("batch_id") == batch_id) & F.col("stage_month").isNotNull())
                                           .select("stage_month").distinct().collect()]
            rows = rollup(stored.filter(F.col("stage_month").isin(touched)).drop("stage_month", "batch_id"))
        (rows.hint("rebalance", month_col).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic")
             .partitionBy(month_col).parquet(table_path))

    ckpt = checkpoint or shared_dir(spark, "streams", name, fresh=True)
    writer = source.writeStream.foreachBatch(apply).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime="1 minute")
    return writer.queryName(name).start()
