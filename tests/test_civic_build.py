"""Warehouse build from a landing folder of raw feed files."""

import json
import os

import pytest

from tidewell.plans import civic_marts as M
from tidewell.plans.civic_build import build_from_landing, feeds_for
from tidewell.session import shared_dir


def write(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write(text)


@pytest.fixture(scope="module")
def landing(spark):
    base = shared_dir(spark, "test_landing", fresh=True)
    root = base[len("file:"):] if base.startswith("file:") else base
    write(f"{root}/crime", "part-0.csv",
          "report_number,offense_id,report_date_time,offense_date,offense_category,"
          "offense_sub_category,nibrs_offense_code_description,nibrs_crime_against_category,"
          "block_address,neighborhood,beat,precinct,latitude,longitude\n"
          "R1,1,2024-01-01T10:00:00,,THEFT,,,PROPERTY,a,n,b,p,47.6,-122.3\n"
          "R2,2,2018-05-01T10:00:00,,THEFT,,,PROPERTY,a,n,b,p,47.6,-122.3\n"
          "R3,3,2024-02-01T10:00:00,,ASSAULT,,,PERSON,a,n,b,p,REDACTED,REDACTED\n")
    write(f"{root}/air_quality", "daily_88101_2024.csv",
          '"State Code","County Code","Site Num","Parameter Code","Latitude","Longitude",'
          '"Parameter Name","Date Local","Units of Measure","Arithmetic Mean","AQI",'
          '"Local Site Name","County Name","CBSA Name"\n'
          '"53","033","0080","88101",47.5,-122.3,"PM2.5 - Local Conditions","2024-01-01","ug",9.1,68,"Beacon Hill","King","Seattle"\n'
          '"53","033","0080","88101",47.5,-122.3,"PM2.5 - Local Conditions","2024-01-01","ug",9.1,,"Beacon Hill","King","Seattle"\n'
          '"41","033","0001","88101",45.5,-122.6,"PM2.5 - Local Conditions","2024-01-01","ug",3.0,20,"Other","Other","Portland"\n')
    write(f"{root}/food_inspections", "page-0.json", json.dumps([
        {"name": "Cafe", "inspection_date": "2024-01-05T00:00:00.000", "inspection_result": "Satisfactory",
         "grade": "1", "inspection_score": 5, "violation_type": "BLUE",
         "inspection_serial_num": "I1"},
        {"name": "Cafe", "inspection_date": "2024-01-05T00:00:00.000", "inspection_result": "Satisfactory",
         "grade": "1", "inspection_score": 5, "violation_type": None, "inspection_serial_num": "I2"}]))
    write(f"{root}/ntd_ridership", "page-0.json", json.dumps([
        {"agency": "King County", "mode": "MB", "tos": "DO", "date": "2016-01-01T00:00:00.000", "upt": "10", "state": "WA"},
        {"agency": "King County", "mode": "MB", "tos": "DO", "date": "2014-01-01T00:00:00.000", "upt": "99", "state": "WA"},
        {"agency": "Elsewhere", "mode": "MB", "tos": "DO", "date": "2016-01-01T00:00:00.000", "upt": "99", "state": "WA"},
        {"agency": "Washington State Ferries", "mode": "FB", "tos": "DO", "date": "2016-01-01T00:00:00.000", "upt": "5", "state": "WA"}]))
    write(f"{root}/parks", "page-0.json", json.dumps({"features": [
        {"attributes": {"NAME": "Alki Beach Park", "PARKSBND_AREA": 5000000.0},
         "geometry": {"rings": [[[-122.41, 47.57], [-122.40, 47.57], [-122.40, 47.58], [-122.41, 47.57]]]}},
        {"attributes": {"NAME": "Cal Anderson Park", "PARKSBND_AREA": 300000},
         "geometry": {"x": -122.32, "y": 47.62}}]}))
    write(f"{root}/trees", "page-0.json", json.dumps({"features": [
        {"attributes": {"SCIENTIFIC_NAME": "Acer rubrum", "CONDITION": "Good", "HERITAGE": "Y",
                        "EXCEPTIONAL": "N", "PLANTED_DATE": 946684800000, "PRIMARYDISTRICTCD": "D1"},
         "geometry": {"x": -122.3, "y": 47.6}}]}))
    write(f"{root}/snowpack", "snow.csv", "#Stampede Pass\n#units: in\nDate,SWE,Depth\n2020-10-01,2.0,3\n2021-03-01,30.5,80\n")
    write(f"{root}/cedar_river_flow", "flow.json", json.dumps({"value": {"timeSeries": [{"values": [{"value": [
        {"dateTime": "2023-01-01T00:00:00.000-08:00", "value": "500"},
        {"dateTime": "2023-06-01T00:00:00.000-07:00", "value": "100"}]}]}]}}))
    write(f"{root}/seattle_tides", "tides.json", json.dumps({"data": [
        {"year": "2020", "month": "1", "MSL": "6.5", "MHHW": "11", "MLLW": "0", "GT": "11.5", "highest": "13", "lowest": "-3"}]}))
    return base


TABLES = ["mart_crime_by_category", "mart_air_sites", "mart_inspections", "mart_transit_by_agency",
          "mart_ferry_by_operator", "mart_parks_points", "mart_trees_summary",
          "mart_snowpack_annual_peak", "mart_river_annual", "mart_tides_annual"]


def test_unknown_table_fails_first():
    with pytest.raises(KeyError):
        feeds_for(["mart_crime_by_category", "mart_nope"])


def test_build_from_landing(spark, landing):
    out = shared_dir(spark, "test_landing_out", fresh=True)
    written = build_from_landing(spark, landing, out, TABLES)
    assert set(TABLES) <= set(written)
    rd = lambda n: [r.asDict() for r in M.read_mart(spark, out, n).collect()]
    # the 2018 offence is before the source start date; REDACTED geo stays in counts
    assert {r["offense_category"]: r["incident_count"] for r in rd("mart_crime_by_category")} == {
        "THEFT": 1, "ASSAULT": 1}
    sites = rd("mart_air_sites")
    assert [(s["site"], s["county"], s["max_aqi"], s["day_count"]) for s in sites] == [
        ("Beacon Hill", "King", 68.0, 1)]
    assert sorted(r["violation_count"] for r in rd("mart_inspections")) == [0, 1]
    assert rd("mart_transit_by_agency") == [{"agency_label": "King County Metro", "boardings": 10}]
    assert rd("mart_ferry_by_operator") == [{"operator": "Washington State Ferries", "boardings": 5}]
    parks = {p["name"]: p for p in rd("mart_parks_points")}
    assert parks["Alki Beach Park"]["is_water_name"] is True
    assert parks["Alki Beach Park"]["longitude"] == pytest.approx((-122.41 - 122.40 - 122.40) / 3)
    assert parks["Cal Anderson Park"]["latitude"] == 47.62
    assert rd("mart_trees_summary")[0]["heritage_trees"] == 1
    assert {r["water_year"]: r["peak_swe_in"] for r in rd("mart_snowpack_annual_peak")} == {2021: 30.5}
    assert rd("mart_river_annual") == [{"year": 2023, "avg_discharge_cfs": 300.0, "min_discharge_cfs": 100.0}]
    assert rd("mart_tides_annual")[0]["avg_msl_ft"] == 6.5
