"""File-triggered month refresh: late files of any age are counted, replays
are idempotent, a restart resumes from the checkpoint."""

from pyspark.sql import functions as F

from tidewell.functions import columns as C
from tidewell.operators import aggregates as A
from tidewell.operators.refresh import read_table
from tidewell.session import shared_dir
from tidewell.streaming.month_refresh import start_month_refresh

SCHEMA = "ts string, v string"


def stage(b):
    return b.select(C.text_to_timestamp("ts").alias("ts"), C.lenient_int("v").alias("v"))


def rollup(df):
    return A.month_rollup(df, "ts", "m", {"n": F.count(F.lit(1)), "total": F.sum("v")})


def run(spark, base):
    q = start_month_refresh(spark, f"{base}/landing", SCHEMA, stage, "ts", rollup,
                            f"{base}/staging", f"{base}/table", "m",
                            options={"header": True}, max_files_per_trigger=1,
                            checkpoint=f"{base}/ckpt")
    q.awaitTermination()
    assert q.exception() is None
    return sorted((str(r.m), r.n, r.total) for r in
                  read_table(spark, f"{base}/table", "m").collect())


def test_stream_counts_late_files(spark):
    base = shared_dir(spark, "test_stream", fresh=True)
    import os
    land = base[len("file:"):] if base.startswith("file:") else base
    os.makedirs(f"{land}/landing")
    with open(f"{land}/landing/a.csv", "w") as f:
        f.write("ts,v\n2024-01-03 10:00:00,1\n2024-02-03 10:00:00,2\nbad,9\n")
    with open(f"{land}/landing/b.csv", "w") as f:
        f.write("ts,v\n2024-03-03 10:00:00,3\n")
    assert run(spark, base) == [("2024-01-01", 1, 1), ("2024-02-01", 1, 2), ("2024-03-01", 1, 3)]
    # a late file for January (outside any trailing window) arrives later
    with open(f"{land}/landing/c.csv", "w") as f:
        f.write("ts,v\n2024-01-20 10:00:00,10\n")
    assert run(spark, base) == [("2024-01-01", 2, 11), ("2024-02-01", 1, 2), ("2024-03-01", 1, 3)]
    # nothing new: a restart changes nothing
    assert run(spark, base) == [("2024-01-01", 2, 11), ("2024-02-01", 1, 2), ("2024-03-01", 1, 3)]


def test_mergeable_batches_do_not_read_the_history(spark):
    from tidewell.operators.versions import drop_folders, names_in
    from tidewell.streaming.month_refresh import Mergeable
    base = shared_dir(spark, "test_stream_state", fresh=True)
    merged = Mergeable(rollup, {"n": F.sum("n"), "total": F.sum("total")}, lambda df: df)

    def land(text):
        rows = spark.createDataFrame([tuple(x.split(",")) for x in text.split()], SCHEMA)
        rows.coalesce(1).write.mode("append").option("header", True).csv(f"{base}/landing")
        q = start_month_refresh(spark, f"{base}/landing", SCHEMA, stage, "ts", merged, f"{base}/staging",
                                f"{base}/table", "m", options={"header": True}, checkpoint=f"{base}/ckpt")
        q.awaitTermination()
        assert q.exception() is None
        return sorted((str(r.m), r.n, r.total) for r in read_table(spark, f"{base}/table", "m").collect())

    assert land("2024-01-03,1 2024-02-03,2 bad,9") == [("2024-01-01", 1, 1), ("2024-02-01", 1, 2)]
    # rows of the batch before are not needed again
    drop_folders(spark, [f"{base}/staging/batch_id=0"])
    want = [("2024-01-01", 2, 11), ("2024-02-01", 1, 2)]
    assert land("2024-01-20,10") == want
    # a batch that died before its commit is retried from the state before it
    drop_folders(spark, [f"{base}/ckpt/commits/1", f"{base}/ckpt/commits/.1.crc"])
    assert land("2024-03-01,5") == [*want, ("2024-03-01", 1, 5)]
    assert names_in(spark, f"{base}/staging_state") == ["batch_id=0", "batch_id=1", "batch_id=2"]


def test_refresh_query_takes_several_batches(spark, sf_small, monkeypatch):
    from tidewell.plans import registry
    base = shared_dir(spark, "test_refresh_query", fresh=True)
    monkeypatch.setattr(registry, "shared_dir", lambda *a, **k: base)
    got = {r["order_month"]: r["order_count"] for r in registry.stream_refresh(spark, sf_small).collect()}
    orders = spark.read.parquet(f"{sf_small}/orders.parquet")
    assert sum(got.values()) == orders.count()
    staged = spark.read.parquet(f"{base}/staging")
    batches = staged.groupBy("stage_month").agg(F.countDistinct("batch_id").alias("n"))
    assert staged.select("batch_id").distinct().count() > 1 and batches.where("n > 1").count() > 0
