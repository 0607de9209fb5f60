"""One session builder and the shared-folder helper.

Every job runs with the session time zone pinned to UTC (date logic must not
depend on the machine), ANSI mode on and AQE on (runtime coalescing and skew
splitting of shuffles).  The Spark UI stays off.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

# settings of a session that already exists; partition overwrite stays a matter
# of each write, so a full rebuild never keeps partitions of the table before
PINNED = ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.adaptive.enabled")


# Settings for a large cluster (hundreds of executors, tens of TB per job).
# Shuffle partitions start high and AQE coalesces them to ~256 MB each, so
# small stages do not pay for the large default; skewed partitions above
# 512 MB (and 5x the median) are split by AQE; scans read 256 MB splits.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.task.maxFailures": "8",
    "spark.stage.maxConsecutiveAttempts": "8",
}


def get_session(master: str | None = None, app: str = "tidewell",
                shuffle_partitions: int | None = None,
                extra: dict | None = None, profile: str = "local") -> SparkSession:
    """Build (or reuse) a session with the engine's fixed settings.

    ``master`` is only set when given, so on a cluster the launcher's master
    wins.  ``shuffle_partitions`` should be sized to the data (about 128 MB of
    shuffle input per partition); AQE then coalesces small ones at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if profile == "cluster":
        conf.update(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # session-scoped settings also apply when the session already existed
    for k in PINNED:
        spark.conf.set(k, conf[k])
    return spark


def pin_session(spark: SparkSession) -> SparkSession:
    """Apply the session-scoped settings to a session built elsewhere."""
    for k in PINNED:
        spark.conf.set(k, BASE_CONF[k])
    return spark


def shared_dir(spark: SparkSession, *parts: str, fresh: bool = False) -> str:
    """A folder under the cluster's shared checkpoint directory.

    The directory comes from ``spark.checkpoint.dir`` (or the context's
    checkpoint dir).  When neither is set, a cluster raises; only a local master
    (tests) gets a folder of its own, registered so ``DataFrame.checkpoint()``
    works too.  Folders are made through Hadoop's file system layer.  ``fresh=True``
    appends a unique leaf so concurrent or repeated runs never collide.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidewell-ckpt-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir() or base
    path = "/".join([base.rstrip("/"), "tidewell", *parts])
    if fresh:
        path = f"{path}/{uuid.uuid4().hex}"
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).mkdirs(folder)
    return path
