"""Column rules against the reference's unit cases (FIXTURES.md §3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewell.functions import columns as C


def one_col(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_keyword_flag_cases(spark):
    yes = ["GREEN LAKE", "DISCOVERY PARK TIDELANDS", "14TH AVENUE NW BOAT RAMP", "Alki Beach Park"]
    no = ["12TH AVE SQUARE PARK", "CAL ANDERSON PARK", "DISCOVERY PARK", None, ""]
    assert one_col(spark, yes, C.keyword_flag) == [True] * 4
    assert one_col(spark, no, C.keyword_flag) == [False] * 5


def test_genus_cases(spark):
    vals = ["Acer rubrum", "quercus garryana", "x Cupressocyparis leylandii",
            "× Cupressocyparis leylandii", "Magnolia", None, "", "   ", "Unknown", "VACANT"]
    assert one_col(spark, vals, C.first_token) == [
        "Acer", "Quercus", "Cupressocyparis", "Cupressocyparis", "Magnolia",
        None, None, None, None, None]


def test_mode_label_cases(spark):
    vals = ["MB", "LR", "FB", "CR", " mb ", "fb", "ZZ", None, ""]
    assert one_col(spark, vals, C.code_label) == [
        "Bus", "Light Rail", "Ferryboat", "Commuter Rail", "Bus", "Ferryboat", "ZZ",
        "Unknown", "Unknown"]


def test_whitespace_mode_code_gives_empty_label(spark):
    # a whitespace-only code is not empty, so it is trimmed to '' and has no label
    assert one_col(spark, ["   ", "\tlr "], C.code_label) == ["", "Light Rail"]


def test_agency_lookup_has_no_fallback(spark):
    out = one_col(spark, ["King County", "Nowhere"], lambda c: C.lookup(c, C.TRANSIT_AGENCIES))
    assert out == ["King County Metro", None]


def test_epoch_ms(spark):
    out = one_col(spark, [1577836800000, None, 0, -2240524800000],
                  C.epoch_ms_to_date, "bigint")
    # the SQL rule keeps 1970-01-01 and drops dates before 1900
    assert out == [dt.date(2020, 1, 1), None, dt.date(1970, 1, 1), None]


def test_lenient_numbers(spark):
    vals = ["12", " 12 ", "12.0", "1.5", "2.5", "-2.5", "1e3", "abc", "", None, "9" * 30]
    assert one_col(spark, vals, C.lenient_int) == [12, 12, 12, 2, 3, -3, 1000, None, None, None, None]
    assert one_col(spark, ["1.25", " 7 ", "x1", "inf", "NaN", ""], C.lenient_double)[:3] == [1.25, 7.0, None]
    assert one_col(spark, ["9007199254740993"], C.lenient_bigint) == [9007199254740993]


def test_text_dates(spark):
    vals = ["2021-03-04T05:06:07", "2021-03-04", "2020", "2020-01", "garbage", None]
    assert one_col(spark, vals, C.text_to_date) == [
        dt.date(2021, 3, 4), dt.date(2021, 3, 4), None, None, None, None]
    assert one_col(spark, ["20200131", "", "garbage", None], C.compact_date) == [
        dt.date(2020, 1, 31), None, None, None]


def test_aqi_band_uses_unrounded_value(spark):
    vals = [50.4, 50.0, 100.5, 0.0, 301.0, None]
    assert one_col(spark, vals, C.aqi_category, "double") == [
        "Moderate", "Good", "Unhealthy for Sensitive Groups", "Good", "Hazardous", "Hazardous"]
    assert one_col(spark, ["Good", "Hazardous", "Other"],
                   lambda c: C.label_rank(c, C.AQI_LABELS)) == [1, 6, None]


def test_park_bands(spark):
    vals = [0.1, 0.5, 4.99, 20.0, 100.0]
    assert one_col(spark, vals, lambda c: C.band(c, C.PARK_SIZE_LIMITS, C.PARK_SIZE_LABELS,
                                                  inclusive=False), "double") == [
        "Pocket (<0.5 ac)", "Small (0.5-5 ac)", "Small (0.5-5 ac)", "Large (20-100 ac)",
        "Flagship (100+ ac)"]


def test_water_year(spark):
    vals = [dt.date(2020, 10, 1), dt.date(2020, 9, 30)]
    assert one_col(spark, vals, C.water_year, "date") == [2021, 2020]


def test_weekday_and_month_names(spark):
    assert one_col(spark, [dt.datetime(2024, 1, 1, 13, 5)], C.weekday_name, "timestamp") == ["Monday"]
    assert one_col(spark, [1, 12, 13], C.month_abbrev, "int") == ["Jan", "Dec", None]


def test_date_from_parts_bad_month(spark):
    df = spark.createDataFrame([("2020", "2"), ("2020", "13"), ("x", "1")], "y string, m string")
    out = [r[0] for r in df.select(C.date_from_parts("y", "m")).collect()]
    assert out == [dt.date(2020, 2, 1), None, None]


def test_labels_and_flags(spark):
    assert one_col(spark, ["  ", None, "Mural", ""], C.label_or_unknown) == [
        "Unknown", "Unknown", "Mural", "Unknown"]
    assert one_col(spark, [None, ""], lambda c: C.label_or_unknown(c, blank_is_null=False)) == [
        "Unknown", ""]
    assert one_col(spark, ["Y", "N", None], C.yn_flag) == [True, False, None]


def test_units_and_display(spark):
    out = one_col(spark, ["  254", "100"], C.tenths_mm_to_in)
    assert out[0] == pytest.approx(1.0) and out[1] == pytest.approx(100 / 254)
    assert one_col(spark, ["100"], C.tenths_c_to_f) == [pytest.approx(50.0)]
    assert one_col(spark, [0.2, 1000.0, 4.0], C.clamped_radius, "double") == [
        40.0, pytest.approx(300 ** 0.5 * 40), 80.0]
    assert one_col(spark, [103.4], lambda c: C.display_int(c, " °F"), "double") == ["103 °F"]
    assert one_col(spark, [1.254, 5.0], lambda c: C.display_round(c, 2, " in"), "double") == [
        "1.25 in", "5.0 in"]


def test_filters(spark):
    df = spark.createDataFrame([(47.6, -122.3, "Lake View"), (-1.0, -1.0, None), (None, None, "x")],
                               "lat double, lon double, name string")
    assert [r[0] for r in df.select(C.in_box("lat", "lon")).collect()] == [True, False, None]
    hits = [r[0] for r in df.select(C.contains_ci(["name"], "VIEW")).collect()]
    assert hits == [True, False, False]
