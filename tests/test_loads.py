"""Loads: replaced tables, the ledger of landed files, complete pages, documents without data."""

import datetime as dt
import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators import aggregates as A
from tidewell.operators import versions as V
from tidewell.operators.refresh import read_table, refresh_months
from tidewell.plans import civic_marts as M
from tidewell.plans.civic_build import build_from_landing, stage_feed
from tidewell.sources import landing as L
from tidewell.sources.ledger import (STAGE_MONTH, Load, committed, read_ledger, read_staged, stage_new,
                                     staged_span)


def jobs(spark, run):
    """Spark jobs that ``run`` starts."""
    sc, group = spark.sparkContext, f"count-{os.urandom(4).hex()}"
    sc.setJobGroup(group, "count")
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(group))


def plan(spark, df) -> str:
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


# ------------------------------------------------------------------ replaced tables
def test_replacement_is_seen_only_when_whole(spark, tmp_path):
    t = str(tmp_path / "t")
    assert V.replace_table(spark.range(7), t, top=F.max("id")) == {"rows": 7, "top": 6}
    reader = V.read_table(spark, t)
    broken = spark.range(5).select(F.when(F.col("id") < 4, F.col("id")).otherwise(
        F.raise_error(F.lit("lost"))).alias("id"))
    with pytest.raises(PySparkException):
        V.replace_table(broken, t)
    assert V.read_table(spark, t).count() == 7
    # may read itself; a partitioned copy may follow a plain one; open readers go on
    V.replace_table(V.read_table(spark, t).withColumn("odd", F.col("id") % 2), t, ["odd"])
    assert sorted(r["odd"] for r in V.read_table(spark, t).collect()) == [0] * 4 + [1] * 3
    assert reader.count() == 7
    V.replace_table(spark.range(1), t)
    assert len(V.names_in(spark, f"{t}/current", folders=False)) == 3
    with pytest.raises(FileNotFoundError):
        V.read_table(spark, str(tmp_path / "nothing"))


def test_two_writers_of_one_number(spark, tmp_path):
    t = str(tmp_path / "t")
    n = V.new_copy(spark, t)
    for copy in ("a", "b"):
        spark.range(3).write.parquet(f"{V.copy_path(t, n)}/{copy}")
    V.publish(spark, t, n)
    with pytest.raises(Exception, match="already exists"):
        V.publish(spark, t, n)


def test_a_load_is_one_job_and_refuses_zero_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,x\n2,y\n")
    (tmp_path / "none.csv").write_text("k,v\n")
    t = str(tmp_path / "t")

    def read(name):
        return L.read_csv_text(spark, str(tmp_path / name), guard=False)
    ready = read("a.csv")
    assert jobs(spark, lambda: L.load_table(ready, t)) == 1
    with pytest.raises(L.EmptyFeed):
        L.load_table(read("none.csv"), t)
    assert V.read_table(spark, t).count() == 2
    (tmp_path / "f.json").write_text(json.dumps({"features": []}))
    attrs = T.StructType([T.StructField("NAME", T.StringType())])
    with pytest.raises(L.EmptyFeed):
        L.load_table(L.read_features(spark, str(tmp_path / "f.json"), attrs, guard=False), t)
    with pytest.raises(L.EmptyFeed):            # guarded by itself when it is read without a load
        L.read_features(spark, str(tmp_path / "f.json"), attrs)


# ------------------------------------------------------------------ pages
def pages(folder, sizes, first=0, shape=list):
    os.makedirs(folder, exist_ok=True)
    for i, n in sizes.items() if isinstance(sizes, dict) else enumerate(sizes, first):
        rows = [{"v": f"{i}.{k}"} for k in range(n)]
        text = rows if shape is list else {"features": [{"attributes": r, "geometry": None} for r in rows]}
        with open(f"{folder}/page-{i}.json", "w") as f:
            f.write(json.dumps(text))
    return str(folder)


def read_rows(spark, path):
    return L.read_json_pages(spark, path, "v string", guard=False, page_rows=3).count()


def test_complete_pages(spark, tmp_path):
    assert read_rows(spark, pages(tmp_path / "a", [3, 3, 2])) == 8
    assert read_rows(spark, pages(tmp_path / "b", [3, 3, 0], first=1)) == 6      # empty page ends it
    # two downloads, each complete; files given one by one
    for sub in ("x", "y"):
        pages(tmp_path / "c" / sub, [3, 1])
    assert read_rows(spark, str(tmp_path / "c")) == 8
    files = [str(tmp_path / "c" / s / f"page-{i}.json") for s in "xy" for i in (0, 1)]
    assert read_rows(spark, files) == 8
    assert read_rows(spark, files[:1]) == 3            # its folder is complete


@pytest.mark.parametrize("sizes, message", [
    ({0: 3, 2: 1}, "numbered 0 to 2"), ({2: 3, 3: 1}, "numbered 2 to 3"), ({0: 3, 1: 2, 2: 3, 3: 1}, "page-1.json is short"),
    ({0: 3, 1: 4, 2: 1}, "more than 3 rows"), ({0: 3, 1: 3}, "last and full")])
def test_incomplete_pages_are_refused(spark, tmp_path, sizes, message):
    with pytest.raises((L.IncompletePages, PySparkException), match=message):
        read_rows(spark, pages(tmp_path / "p", sizes))


def test_odd_page_files_are_refused(spark, tmp_path):
    path = pages(tmp_path / "p", [3, 1])
    (tmp_path / "p" / "other.json").write_text("[]")
    with pytest.raises(L.IncompletePages, match="1 without a number"):
        read_rows(spark, path)
    os.remove(tmp_path / "p" / "other.json")
    (tmp_path / "p" / "page_1.json").write_text("[]")
    with pytest.raises(L.IncompletePages, match="2 different"):
        read_rows(spark, path)
    os.remove(tmp_path / "p" / "page_1.json")
    (tmp_path / "p" / "page-1.json").write_text('{"error": "too many requests"')
    with pytest.raises(PySparkException, match="no list of rows|last and full|short"):
        L.read_json_pages(spark, path, "v string", guard=False, page_rows=3).collect()


def test_feature_layers_may_end_with_a_full_page(spark, tmp_path):
    attrs = T.StructType([T.StructField("v", T.StringType())])

    def read(path):
        return L.read_features(spark, path, attrs, guard=False, page_rows=3).count()
    assert read(pages(tmp_path / "a", [3, 3], shape=dict)) == 6
    with pytest.raises(PySparkException, match="page-0.json is short"):
        read(pages(tmp_path / "b", [2, 3], shape=dict))
    with pytest.raises(L.IncompletePages):
        read(pages(tmp_path / "c", {0: 3, 2: 1}, shape=dict))


def test_numbered_pages_are_complete(spark, tmp_path):
    df = spark.range(1003).selectExpr("id as k").repartition(3)
    df.write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    L.land_json_pages(scan, str(tmp_path / "p"), 100, numbered=True)
    back = L.read_json_pages(spark, str(tmp_path / "p"), "k string", page_rows=100)
    assert sorted(int(r.k) for r in back.collect()) == list(range(1003))


# ------------------------------------------------------------------ nested documents
def test_a_document_without_series_is_named(spark, tmp_path):
    good = {"value": {"timeSeries": [{"values": [{"value": [{"dateTime": "2024-01-01", "value": "5"}]}]}]}}
    (tmp_path / "a.json").write_text(json.dumps(good))
    assert L.read_time_series(spark, str(tmp_path)).count() == 1
    for i, bad in enumerate(['{"value": {"timeSeries": []}}', "{}", "not json",
                             '{"value": {"timeSeries": [{"values": []}]}}']):
        (tmp_path / f"b{i}.json").write_text(bad)
        with pytest.raises(PySparkException, match=f"no series in: .*b{i}.json"):
            L.read_time_series(spark, str(tmp_path), guard=False).collect()
        os.remove(tmp_path / f"b{i}.json")
    # a series without a single value is a document with a series
    (tmp_path / "c.json").write_text('{"value": {"timeSeries": [{"values": [{"value": []}]}]}}')
    assert L.read_time_series(spark, str(tmp_path)).count() == 1
    tides = tmp_path / "tides"
    tides.mkdir()
    (tides / "a.json").write_text('{"data": [{"year": "2020", "month": "1", "MSL": "1"}]}')
    (tides / "b.json").write_text('{"error": "no data"}')
    with pytest.raises(PySparkException, match="no data in: .*b.json"):
        L.read_tide_months(spark, str(tides), guard=False).collect()


# ------------------------------------------------------------------ ledger
def rollup(df):
    return A.month_rollup(df, "ts", "m", {"n": F.count(F.lit(1)), "total": F.sum("v")})


@pytest.fixture
def feed(spark, tmp_path):
    landing, store = tmp_path / "landing", str(tmp_path / "store")
    landing.mkdir()

    def land(name, rows):
        (landing / name).write_text("ts,v\n" + "".join(f"{t},{v}\n" for t, v in rows))

    def stage():
        return stage_new(spark, str(landing), store, lambda paths: L.read_csv_text(spark, paths, guard=False)
                         .select(F.col("ts").cast("timestamp").alias("ts"), F.col("v").cast("int").alias("v")), "ts")

    def staged():
        return sorted((str(r["ts"])[:10], r["v"]) for r in read_staged(spark, store).collect())
    return landing, store, land, stage, staged


def test_only_new_files_are_parsed(spark, feed, tmp_path):
    landing, store, land, stage, staged = feed
    land("a.csv", [("2024-01-05", 1), ("2024-02-05", 2)])
    land("b.csv", [("2024-03-05", 3)])
    first = stage()
    assert (first.batch, first.files, first.rows) == (1, 2, 3)
    assert [m.month for m in first.months] == [1, 2, 3]
    assert stage() == Load()
    # an old file that is gone is not missed, as it is not opened again
    os.remove(landing / "a.csv")
    land("c.csv", [("2024-02-20", 10)])
    second = stage()
    assert (second.batch, second.files, second.rows, second.months) == (2, 1, 1, (dt.date(2024, 2, 1),))
    assert staged() == [("2024-01-05", 1), ("2024-02-05", 2), ("2024-02-20", 10), ("2024-03-05", 3)]
    assert [r["rows"] for r in read_ledger(spark, store).where("batch = 2").collect()] == [1]
    span = staged_span(spark, store).first()
    assert (span["rows"], span["files"], str(span["first"])[:10], str(span["last"])[:10]) == \
        (4, 3, "2024-01-05", "2024-03-05")
    # the refresh reads the folders of the touched month only
    rows = read_staged(spark, store, own_columns=True).where(F.col(STAGE_MONTH).isin(list(second.months)))
    text = plan(spark, rows)
    assert "PartitionFilters" in text and STAGE_MONTH in text.split("PartitionFilters", 1)[1].splitlines()[0]
    assert {r["source_file"].rsplit("/", 1)[1] for r in rows.collect()} == {"a.csv", "c.csv"}


def test_a_file_landed_again_replaces_its_rows(spark, feed, tmp_path):
    landing, store, land, stage, staged = feed
    table = str(tmp_path / "table")

    def refresh(load):
        refresh_months(spark, read_staged(spark, store, own_columns=True), load.months, rollup, table, "m", STAGE_MONTH)
        return sorted((r["m"].month, r["n"], r["total"]) for r in read_table(spark, table, "m").collect())
    land("a.csv", [("2024-01-05", 1), ("2024-02-05", 2)])
    land("b.csv", [("2024-03-05", 3)])
    assert refresh(stage()) == [(1, 1, 1), (2, 1, 2), (3, 1, 3)]
    land("a.csv", [("2024-02-05", 2), ("2024-02-06", 7), ("2024-04-01", 9)])
    load = stage()
    # January is among the months: it loses its only row and leaves the table
    assert [m.month for m in load.months] == [1, 2, 4]
    assert refresh(load) == [(2, 2, 9), (3, 1, 3), (4, 1, 9)]
    assert staged() == [("2024-02-05", 2), ("2024-02-06", 7), ("2024-03-05", 3), ("2024-04-01", 9)]
    assert refresh(stage()) == [(2, 2, 9), (3, 1, 3), (4, 1, 9)]


def test_a_failed_load_counts_for_nothing(spark, feed):
    landing, store, land, stage, staged = feed
    land("a.csv", [("2024-01-05", 1)])
    stage()
    land("empty.csv", [])
    with pytest.raises(L.EmptyFeed):
        stage()
    # a load that died before its marker: rows of batch 2 lie there, nobody sees them
    spark.range(1).selectExpr("timestamp'2024-09-09' as ts", "99 as v", "'x' as source_file") \
        .write.parquet(f"{store}/rows/batch=2/stage_month=2024-09-01")
    assert staged() == [("2024-01-05", 1)] and committed(spark, store) == 1
    land("b.csv", [("2024-05-05", 5)])
    assert stage().batch == 2
    assert staged() == [("2024-01-05", 1), ("2024-05-05", 5)]


# ------------------------------------------------------------------ warehouse
CRIME = ("report_number,offense_id,report_date_time,offense_date,offense_category,offense_sub_category,"
         "nibrs_offense_code_description,nibrs_crime_against_category,block_address,neighborhood,beat,precinct,"
         "latitude,longitude\n")


def test_incremental_warehouse_parses_new_files_only(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "wh")
    (landing / "crime").mkdir(parents=True)
    (landing / "trees").mkdir()

    def crime(name, days):
        (landing / "crime" / name).write_text(CRIME + "".join(
            f"R{name}{i},{i},{d}T10:00:00,,THEFT,,,PROPERTY,a,n,b,p,47.6,-122.3\n" for i, d in enumerate(days)))
    crime("a.csv", ["2024-01-05", "2024-02-05", "2024-02-06"])
    (landing / "trees" / "page-0.json").write_text(json.dumps({"features": [{"attributes": {
        "SCIENTIFIC_NAME": "Acer rubrum", "CONDITION": "Good", "HERITAGE": "Y", "EXCEPTIONAL": "N",
        "PLANTED_DATE": 946684800000, "PRIMARYDISTRICTCD": "D1"}, "geometry": {"x": -122.3, "y": 47.6}}]}))
    tables = ["mart_crime_monthly", "mart_crime_by_category", "mart_trees_summary"]

    def months():
        return {str(r["crime_month"])[:7]: r["incident_count"]
                for r in M.read_mart(spark, out, "mart_crime_monthly").collect()}

    def crimes():
        return M.read_mart(spark, out, "mart_crime_by_category").first()["incident_count"]
    assert set(build_from_landing(spark, str(landing), out, tables)) == set(tables)
    assert months() == {"2024-01": 1, "2024-02": 2} and crimes() == 3
    # the old file cannot be opened again; trees have nothing new
    os.remove(landing / "crime" / "a.csv")
    crime("b.csv", ["2024-01-20", "2024-04-01"])
    assert set(build_from_landing(spark, str(landing), out, tables, incremental=True)) == set(tables[:2])
    assert months() == {"2024-01": 2, "2024-02": 2, "2024-04": 1} and crimes() == 5
    assert build_from_landing(spark, str(landing), out, tables, incremental=True) == []
    # a build that died after staging is made up for: only then are its months refreshed
    crime("c.csv", ["2024-02-20", "2024-05-01"])
    assert stage_feed(spark, str(landing), "crime", out, incremental=True).files == 1
    crime("d.csv", ["2024-06-01"])
    assert set(build_from_landing(spark, str(landing), out, tables, incremental=True)) == set(tables[:2])
    assert months() == {"2024-01": 2, "2024-02": 3, "2024-04": 1, "2024-05": 1, "2024-06": 1} and crimes() == 8
    for name in "cd":
        os.remove(landing / "crime" / f"{name}.csv")
    # a full build reads what is landed now
    build_from_landing(spark, str(landing), out, tables)
    assert months() == {"2024-01": 1, "2024-04": 1} and crimes() == 2
    assert set(M.warehouse_frames(spark, out)) == {"stg_crime", "stg_trees", *tables}
    frames = M.warehouse_frames(spark, out)
    assert frames["stg_crime"].count() == 2 and "source_file" not in frames["stg_crime"].columns


def test_a_failed_rebuild_leaves_the_mart(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "wh")
    (landing / "snowpack").mkdir(parents=True)
    (landing / "snowpack" / "s.csv").write_text("#x\nDate,SWE,Depth\n2020-10-01,2.0,3\n")
    build_from_landing(spark, str(landing), out, ["mart_snowpack_annual_peak"])
    (landing / "snowpack" / "s.csv").write_text("#x\nDate,SWE,Depth\n")
    with pytest.raises(L.EmptyFeed):
        build_from_landing(spark, str(landing), out, ["mart_snowpack_annual_peak"])
    assert M.read_mart(spark, out, "mart_snowpack_annual_peak").first()["peak_swe_in"] == 2.0
    assert M.read_staging(spark, out, "snowpack").count() == 1


def test_naming_landed_files_lists_folders_not_each_file(spark, tmp_path, monkeypatch):
    listed = []
    monkeypatch.setattr(L, "names_in", lambda s, path, folders=True: listed.append(path) or V.names_in(s, path, folders))
    for text in ("old", "new"):
        rows = spark.createDataFrame([(f"page-{i:05d}", f"{text} {i}") for i in range(40)], "name string, value string")
        assert L.land_named_text(rows, str(tmp_path / "p")) == [f"page-{i:05d}.json" for i in range(40)]
    got = {r["value"] for r in spark.read.text(str(tmp_path / "p")).collect()}
    assert got == {f"new {i}" for i in range(40)} and len(listed) <= 4


def test_pages_of_many_parts_are_fuller(spark, sf_small, tmp_path, monkeypatch):
    from tidewell.plans import landing_queries as Q
    few = Q.feature_load(spark, sf_small).collect()
    monkeypatch.setattr(Q, "LAYER_PAGES", 3, raising=False)
    monkeypatch.setattr(Q, "shared_dir", lambda *a, **k: str(tmp_path))
    assert sorted(Q.feature_load(spark, sf_small).collect()) == sorted(few)
    assert len(V.names_in(spark, str(tmp_path / "layer"), folders=False)) == 3
