"""Session helpers."""

from tidewell.session import CLUSTER_CONF, shared_dir


def test_shared_dir_uses_session_checkpoint_dir(spark):
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    a, b = shared_dir(spark, "x", fresh=True), shared_dir(spark, "x", fresh=True)
    assert a != b and a.startswith(base.rstrip("/"))


def test_cluster_profile_keeps_aqe_coalescing():
    assert int(CLUSTER_CONF["spark.sql.shuffle.partitions"]) >= 1000
    assert CLUSTER_CONF["spark.sql.adaptive.advisoryPartitionSizeInBytes"].endswith("m")
