"""The civic warehouse's data tests and feed freshness rules, as data.

Tables are named as models: ``stg_<feed>`` for staging and ``mart_*`` for
marts.  ``civic_quality_report`` evaluates every check whose table is
present (one aggregate per table for the row-level checks).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tidewell.operators.quality import Check, Freshness, freshness_report, quality_report

# fixed values: the published data tests (table, kind, column(s), options)
_NN, _UQ, _AV, _AR, _UC, _REL = ("not_null", "unique", "accepted_values", "accepted_range",
                                 "unique_combination", "relationships")
METRO_LAT, METRO_LON = (47.0, 48.5), (-122.6, -121.5)
CIVIC_CHECKS = (
    Check("stg_building_permits", _NN, ("permit_number",)),
    Check("stg_building_permits", _UQ, ("permit_number",)),
    Check("stg_building_permits", _AV, ("permit_class_mapped",),
          values=("Residential", "Non-Residential", "N/A")),
    Check("stg_crime", _NN, ("report_number",)),
    Check("stg_crime", _NN, ("offense_id",)),
    Check("stg_crime", _UQ, ("offense_id",), severity="warn"),
    Check("stg_crime", _NN, ("report_datetime",)),
    Check("stg_crime", _AV, ("crime_against",), severity="warn",
          values=("PROPERTY", "PERSON", "NOT_A_CRIME", "SOCIETY", "ANY")),
    Check("stg_fire_911", _NN, ("incident_number",)),
    Check("stg_fire_911", _UQ, ("incident_number",)),
    Check("stg_fire_911", _NN, ("call_datetime",)),
    Check("stg_csr_311", _NN, ("request_number",)),
    Check("stg_csr_311", _UQ, ("request_number",)),
    Check("stg_csr_311", _NN, ("created_at",)),
    Check("stg_ntd_ridership", _NN, ("ridership_month",)),
    Check("stg_ntd_ridership", _NN, ("upt",)),
    Check("stg_food_inspections", _NN, ("inspection_serial_num",)),
    Check("stg_food_inspections", _NN, ("inspection_date",)),
    Check("stg_food_inspections", _AV, ("inspection_result",),
          values=("Satisfactory", "Unsatisfactory", "Complete")),
    Check("stg_food_inspections", _AV, ("grade",),
          values=("Excellent", "Good", "Okay", "Not Rated", "Needs To Improve",
                  "Rating Not Available")),
    Check("stg_food_inspections", _AV, ("risk_category",), values=("1", "2", "3")),
    Check("stg_short_term_rentals", _NN, ("licenseid",)),
    Check("stg_short_term_rentals", _AV, ("licensestatus",),
          values=("Active", "Inactive", "Expired", "Revoked", "Canceled", "Denied", "In Process")),
    Check("stg_business_licenses", _NN, ("business_legal_name",)),
    Check("stg_public_art", _NN, ("title",)),
    Check("stg_parks", _NN, ("name",)),
    Check("stg_parks", _NN, ("area_acres",)),
    Check("stg_parks", _AR, ("area_acres",), min_value=0),
    Check("stg_parks", _NN, ("latitude",)),
    Check("stg_parks", _NN, ("longitude",)),
    Check("stg_trees", _NN, ("scientific_name",)),
    Check("stg_trees", _AV, ("condition",), values=("GOOD", "FAIR")),
    Check("stg_air_quality", _UC, ("site", "obs_date", "pollutant")),
    Check("stg_air_quality", _NN, ("obs_date",)),
    Check("stg_air_quality", _NN, ("aqi",)),
    Check("stg_air_quality", _AR, ("aqi",), min_value=0, max_value=500),
    Check("stg_air_quality", _AV, ("pollutant",), values=("PM2.5 - Local Conditions", "Ozone")),
    Check("stg_air_quality", _AV, ("aqi_category",),
          values=("Good", "Moderate", "Unhealthy for Sensitive Groups", "Unhealthy",
                  "Very Unhealthy", "Hazardous")),
    Check("stg_weather", _NN, ("obs_date",)),
    Check("stg_weather", _UQ, ("obs_date",)),
    Check("stg_snowpack", _NN, ("obs_date",)),
    Check("stg_snowpack", _UQ, ("obs_date",)),
    Check("stg_snowpack", _NN, ("water_year",)),
    Check("stg_cedar_river_flow", _NN, ("obs_date",)),
    Check("stg_cedar_river_flow", _UQ, ("obs_date",)),
    Check("stg_cedar_river_flow", _NN, ("discharge_cfs",)),
    Check("stg_seattle_tides", _UC, ("year", "month")),
    Check("stg_seattle_tides", _NN, ("year",)),
    Check("stg_seattle_tides", _AR, ("month",), min_value=1, max_value=12),
    Check("mart_art_points", _AR, ("latitude",), min_value=METRO_LAT[0], max_value=METRO_LAT[1]),
    Check("mart_art_points", _AR, ("longitude",), min_value=METRO_LON[0], max_value=METRO_LON[1]),
    Check("mart_csr_map_sample", _REL, ("request_number",), parent="stg_csr_311",
          parent_column="request_number"),
    Check("mart_fire_map_sample", _AR, ("latitude",), min_value=METRO_LAT[0], max_value=METRO_LAT[1]),
    Check("mart_fire_map_sample", _AR, ("longitude",), min_value=METRO_LON[0], max_value=METRO_LON[1]),
    Check("mart_inspections", _NN, ("inspection_serial_num",)),
    Check("mart_inspections", _UQ, ("inspection_serial_num",)),
    Check("mart_permits_map_sample", _REL, ("permit_number",), parent="stg_building_permits",
          parent_column="permit_number"),
    Check("mart_permits_map_sample", _AR, ("latitude",), min_value=METRO_LAT[0], max_value=METRO_LAT[1]),
    Check("mart_permits_map_sample", _AR, ("longitude",), min_value=METRO_LON[0], max_value=METRO_LON[1]),
    Check("mart_metrics", _NN, ("metric_name",)),
    Check("mart_metrics", _UQ, ("metric_name",)),
    Check("mart_metrics", _AV, ("unit",), values=("count", "usd", "percent")),
    Check("mart_metrics", _NN, ("value",)),
    Check("mart_build_info", _NN, ("built_at",)),
    Check("mart_build_info", _UQ, ("built_at",)),
    Check("mart_build_info", _NN, ("total_records",)),
    Check("mart_build_info", _AR, ("total_records",), min_value=3000000),
)

# fixed values: feed freshness limits in days (warn, error) on the raw time column
CIVIC_FRESHNESS = (
    Freshness("stg_building_permits", "issue_date", 30, 90),
    Freshness("stg_crime", "report_datetime", 14, 45),
    Freshness("stg_csr_311", "created_at", 14, 45),
)


def civic_quality_report(spark: SparkSession, frames: Mapping[str, DataFrame]) -> DataFrame:
    """Every check whose table (and parent) is in ``frames``."""
    checks = [c for c in CIVIC_CHECKS
              if c.table in frames and (c.parent is None or c.parent in frames)]
    return quality_report(spark, frames, checks)


def civic_freshness(frames: Mapping[str, DataFrame], as_of: str) -> DataFrame:
    rules = [r for r in CIVIC_FRESHNESS if r.feed in frames]
    return freshness_report(frames, rules, as_of)


# raw text columns typed leniently by staging, per feed (column -> parsed kind)
PARSED_COLUMNS = {
    "building_permits": {"housingunitsadded": "int", "estprojectcost": "double",
                         "issueddate": "timestamp", "latitude": "double", "longitude": "double"},
    "crime": {"report_date_time": "timestamp", "latitude": "double", "longitude": "double"},
    "csr_311": {"createddate": "timestamp", "latitude": "double", "longitude": "double"},
    "fire_911": {"datetime": "timestamp", "latitude": "double", "longitude": "double"},
    "food_inspections": {"inspection_date": "timestamp", "inspection_score": "double",
                         "violation_points": "int"},
    "business_licenses": {"license_start_date": "compact_date"},
    "ntd_ridership": {"date": "timestamp", "upt": "bigint"},
    "weather": {"DATE": "date", "PRCP": "double", "TMAX": "double", "TMIN": "double"},
    "snowpack": {"obs_date": "date", "swe_in": "double"},
    "seattle_tides": {"year": "int", "month": "int", "MSL": "double"},
}


def civic_parse_report(raw: Mapping[str, DataFrame]) -> DataFrame:
    """Unparsed-text counts for every landed feed present."""
    from tidewell.operators.quality import parse_failures
    parts = [parse_failures(df, {c: k for c, k in PARSED_COLUMNS[f].items() if c in df.columns}, f)
             for f, df in raw.items() if f in PARSED_COLUMNS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
