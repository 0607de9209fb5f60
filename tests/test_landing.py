"""Landing readers on small files written by the tests (FIXTURES.md §3)."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.geo import centroid
from tidewell.sources.landing import (EmptyFeed, build, filter_and_rename, read_comment_csv,
                                      read_csv_text, read_features, read_json_pages,
                                      read_tide_months, read_time_series)


def test_paged_json_rows(spark, tmp_path):
    pages = [[{"v": "1"}, {"v": "2"}], [{"v": "3"}, {"v": "4"}], [{"v": "5"}]]
    for i, p in enumerate(pages):
        (tmp_path / f"page-{i}.json").write_text(json.dumps(p))
    df = read_json_pages(spark, str(tmp_path), "v string")
    assert sorted(int(r.v) for r in df.collect()) == [1, 2, 3, 4, 5]
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "page-0.json").write_text("[]")
    with pytest.raises(EmptyFeed):
        read_json_pages(spark, str(empty), "v string")


def test_csv_as_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,foo\n2,bar\n")
    df = read_csv_text(spark, str(tmp_path / "a.csv"))
    assert df.schema == T.StructType([T.StructField("a", T.StringType()),
                                      T.StructField("b", T.StringType())])
    assert sorted(tuple(r) for r in df.collect()) == [("1", "foo"), ("2", "bar")]
    (tmp_path / "h.csv").write_text("a,b\n")
    with pytest.raises(EmptyFeed):
        read_csv_text(spark, str(tmp_path / "h.csv"))


def test_comment_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("#station\n#units\nDate,SWE,Depth\n2024-01-01,3.1,20\n")
    df = read_comment_csv(spark, str(tmp_path / "s.csv"), ["obs_date", "swe_in", "snow_depth_in"])
    assert [tuple(r) for r in df.collect()] == [("2024-01-01", "3.1", "20")]


def test_filter_and_rename(spark):
    df = spark.createDataFrame([("53", "033", 68.0, "King"), ("53", "033", None, "King"),
                                ("41", "033", 30.0, "Other")],
                               "state_code string, county_code string, aqi double, county_name string")
    out = filter_and_rename(df, (F.col("state_code") == "53") & F.col("county_code").isin("033")
                            & F.col("aqi").isNotNull(), {"county_name": "county", "aqi": "aqi"})
    assert [tuple(r) for r in out.collect()] == [("King", 68.0)]


def test_time_series_and_tides(spark, tmp_path):
    doc = {"value": {"timeSeries": [{"values": [{"value": [
        {"dateTime": "2024-01-01T00:00:00.000", "value": "512"},
        {"dateTime": "2024-01-02T00:00:00.000", "value": "498"}]}]}]}}
    (tmp_path / "flow.json").write_text(json.dumps(doc))
    out = read_time_series(spark, str(tmp_path / "flow.json")).collect()
    assert [(r.obs_date[:10], r.value) for r in out] == [("2024-01-01", "512"), ("2024-01-02", "498")]
    (tmp_path / "none.json").write_text(json.dumps({"value": {"timeSeries": []}}))
    with pytest.raises(PySparkException, match="no series in"):
        read_time_series(spark, str(tmp_path / "none.json"))
    tides = {"data": [{"year": "2020", "month": "1", "MSL": "6.5", "MHHW": "1", "MLLW": "0",
                       "GT": "11", "highest": "13", "lowest": "-3"}]}
    (tmp_path / "tides.json").write_text(json.dumps(tides))
    assert read_tide_months(spark, str(tmp_path / "tides.json")).first().MSL == "6.5"


def test_features_and_centroid(spark, tmp_path):
    page = {"features": [
        {"attributes": {"NAME": "Pt"}, "geometry": {"x": -122.33, "y": 47.6}},
        {"attributes": {"NAME": "Sq"}, "geometry": {"rings": [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]}},
        {"attributes": {"NAME": "None"}, "geometry": None}]}
    (tmp_path / "f.json").write_text(json.dumps(page))
    attrs = T.StructType([T.StructField("NAME", T.StringType())])
    df = read_features(spark, str(tmp_path / "f.json"), attrs)
    lon, lat = centroid(F.col("geometry"))
    out = [tuple(r) for r in df.select("NAME", lon, lat).collect()]
    assert out == [("Pt", -122.33, 47.6), ("Sq", 0.5, 0.5), ("None", None, None)]


def test_build_named_subset():
    ran = []
    builders = {"a": lambda: ran.append("a"), "b": lambda: ran.append("b")}
    assert build(builders, ["b"]) == ["b"] and ran == ["b"]
    with pytest.raises(KeyError):
        build(builders, ["zzz"])
    assert ran == ["b"]


def test_json_pages_are_bounded(spark, tmp_path):
    from tidewell.sources.landing import land_json_pages, text_schema
    df = spark.range(2500).selectExpr("id as k", "id * 2 as v").repartition(3)
    land_json_pages(df, str(tmp_path / "p"), page_rows=400)
    back = read_json_pages(spark, str(tmp_path / "p" / "*" / "*.txt"), text_schema(["k", "v"]))
    assert sorted(int(r.k) for r in back.collect()) == list(range(2500))
    sizes = [len(json.loads(f.read_text())) for f in (tmp_path / "p").glob("*/*.txt")]
    assert max(sizes) <= 400 and sum(sizes) == 2500
