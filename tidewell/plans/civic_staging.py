"""Civic staging: one typed, cleaned DataFrame per raw feed.

Raw feeds arrive mostly as text (CSV landed without inference) or as JSON
with loose types.  Each staging function renames, types leniently (bad text
becomes NULL, never an error) and filters unusable rows, exactly as the
published staging views do.  ``typed`` adapts to the raw column's type, so
the same function works on text landings and on already-typed Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tidewell.functions import columns as C
from tidewell.functions.numeric import stable_mean


def typed(df: DataFrame, name: str, kind: str) -> Column:
    """Column ``name`` as ``kind`` (double | int | bigint | timestamp | date)."""
    dt = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dt, T.StringType):
        if kind == "double":
            return C.lenient_double(c)
        if kind in ("int", "bigint"):
            return C.lenient_int(c, kind)
        if kind == "timestamp":
            return C.text_to_timestamp(c)
        if kind == "date":
            return C.text_to_date(c)
        raise ValueError(kind)
    if kind in ("timestamp", "date"):
        return c.cast(kind)
    return c.try_cast(kind)


def _ts_date(df: DataFrame, name: str) -> Column:
    """try_cast(x as timestamp)::date"""
    return typed(df, name, "timestamp").cast("date")


def _text(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string")


# ------------------------------------------------------------------ landing
def land_ntd(raw: DataFrame) -> DataFrame:
    """Attach agency label (no fallback), mode label and the ferry flag."""
    return raw.select("*",
                      C.lookup("agency", C.TRANSIT_AGENCIES).alias("agency_label"),
                      C.code_label("mode").alias("mode_label"),
                      (F.col("mode") == C.FERRY_MODE).alias("is_ferry"))


def land_parks(raw: DataFrame) -> DataFrame:
    """Attach the name-derived water flag."""
    return raw.withColumn("is_water_name", C.keyword_flag("name"))


def land_trees(raw: DataFrame) -> DataFrame:
    """Attach the genus derived from the botanical name."""
    return raw.withColumn("genus", C.first_token("scientific_name"))


# ------------------------------------------------------------------ staging
def stg_air_quality(raw: DataFrame) -> DataFrame:
    """Readings averaged to one row per site, day and pollutant; AQI rounded
    for display, band cut on the unrounded mean."""
    base = raw.select(
        F.col("county_name").alias("county"), F.col("local_site_name").alias("site"),
        typed(raw, "latitude", "double").alias("latitude"),
        typed(raw, "longitude", "double").alias("longitude"),
        typed(raw, "date_local", "date").alias("obs_date"),
        F.col("parameter_name").alias("pollutant"), "units",
        typed(raw, "arithmetic_mean", "double").alias("am"),
        typed(raw, "aqi", "double").alias("aqi_raw"))
    dedup = (base.filter(F.col("obs_date").isNotNull())
                 .groupBy("county", "site", "latitude", "longitude", "obs_date", "pollutant")
                 .agg(F.max("units").alias("units"), stable_mean("am").alias("concentration"),
                      stable_mean("aqi_raw").alias("aqi_mean")))
    return dedup.select("county", "site", "latitude", "longitude", "obs_date", "pollutant",
                        "units", "concentration", F.round("aqi_mean").alias("aqi"),
                        C.aqi_category("aqi_mean").alias("aqi_category"))


def stg_building_permits(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("permitnum").alias("permit_number"), F.col("permitclass").alias("permit_class"),
        F.col("permitclassmapped").alias("permit_class_mapped"),
        F.col("permittypemapped").alias("permit_type_mapped"),
        F.col("permittypedesc").alias("permit_type_desc"), "description",
        typed(raw, "housingunitsadded", "int").alias("housing_units_added"),
        typed(raw, "estprojectcost", "double").alias("valuation"),
        _ts_date(raw, "applieddate").alias("applied_date"),
        _ts_date(raw, "issueddate").alias("issue_date"),
        _ts_date(raw, "completeddate").alias("completed_date"),
        F.col("statuscurrent").alias("status"), F.col("originaladdress1").alias("address"),
        F.col("originalcity").alias("city"), F.col("originalzip").alias("zip"),
        typed(raw, "latitude", "double").alias("latitude"),
        typed(raw, "longitude", "double").alias("longitude"))


def stg_business_licenses(raw: DataFrame) -> DataFrame:
    return raw.select("business_legal_name", "trade_name", "ownership_type", "naics_code",
                      "naics_description",
                      C.compact_date("license_start_date").alias("start_date"),
                      C.unparsed(F.nullif(F.col("license_start_date"), F.lit("")),
                                 C.compact_date("license_start_date")).alias("start_date_unparsed"),
                      "city", "zip")


def stg_cedar_river_flow(raw: DataFrame) -> DataFrame:
    out = raw.select(C.text_prefix_date(_text(raw, "obs_date")).alias("obs_date"),
                     typed(raw, "value", "double").alias("discharge_cfs"))
    return out.filter(F.col("discharge_cfs").isNotNull() & F.col("obs_date").isNotNull())


def _calls(df: DataFrame, ts: Column) -> list[Column]:
    return [C.weekday_name(ts).alias("weekday"), C.hour_of_day(ts).alias("hour_of_day")]


def stg_crime(raw: DataFrame) -> DataFrame:
    ts = typed(raw, "report_date_time", "timestamp")
    return raw.select(
        "report_number", "offense_id", ts.alias("report_datetime"),
        typed(raw, "offense_date", "timestamp").alias("offense_datetime"),
        "offense_category", "offense_sub_category",
        F.col("nibrs_offense_code_description").alias("offense_description"),
        F.col("nibrs_crime_against_category").alias("crime_against"),
        F.col("block_address").alias("address"), "neighborhood", "beat", "precinct",
        typed(raw, "latitude", "double").alias("latitude"),
        typed(raw, "longitude", "double").alias("longitude"), *_calls(raw, ts))


def stg_csr_311(raw: DataFrame) -> DataFrame:
    ts = typed(raw, "createddate", "timestamp")
    return raw.select(
        F.col("servicerequestnumber").alias("request_number"),
        F.col("webintakeservicerequests").alias("request_type"),
        F.col("departmentname").alias("department"),
        F.col("methodreceivedname").alias("method_received"),
        F.col("servicerequeststatusname").alias("status"), ts.alias("created_at"),
        F.col("location").alias("address"), "zipcode",
        F.col("councildistrict").alias("council_district"),
        F.col("policeprecinct").alias("police_precinct"),
        F.col("community_reporting_area").alias("reporting_area"),
        typed(raw, "latitude", "double").alias("latitude"),
        typed(raw, "longitude", "double").alias("longitude"), *_calls(raw, ts))


def stg_fire_911(raw: DataFrame) -> DataFrame:
    ts = typed(raw, "datetime", "timestamp")
    return raw.select("incident_number", F.col("type").alias("call_type"),
                      ts.alias("call_datetime"), "address",
                      typed(raw, "latitude", "double").alias("latitude"),
                      typed(raw, "longitude", "double").alias("longitude"), *_calls(raw, ts))


def stg_food_inspections(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("name").alias("establishment"),
        _ts_date(raw, "inspection_date").alias("inspection_date"), "city", "zip_code",
        "inspection_type", "inspection_result", "grade", "risk_category",
        typed(raw, "inspection_score", "double").alias("inspection_score"),
        "violation_type", "violation_description",
        typed(raw, "violation_points", "int").alias("violation_points"),
        "inspection_serial_num", "business_id")


def stg_ntd_ridership(raw: DataFrame) -> DataFrame:
    if "mode_label" not in raw.columns:
        raw = land_ntd(raw)
    out = raw.select("agency", "agency_label", F.col("mode").alias("mode_code"), "mode_label",
                     F.col("is_ferry").cast("boolean").alias("is_ferry"),
                     _ts_date(raw, "date").alias("ridership_month"),
                     typed(raw, "upt", "bigint").alias("upt"))
    return out.filter(F.col("upt").isNotNull())


def stg_parks(raw: DataFrame) -> DataFrame:
    if "is_water_name" not in raw.columns:
        raw = land_parks(raw)
    area = typed(raw, "area_sqft", "double")
    out = raw.select("name", area.alias("area_sqft"), C.sqft_to_acres(area).alias("area_acres"),
                     typed(raw, "latitude", "double").alias("latitude"),
                     typed(raw, "longitude", "double").alias("longitude"),
                     F.col("is_water_name").cast("boolean").alias("is_water_name"))
    return out.filter((F.col("area_sqft") > 0) & F.col("latitude").isNotNull()
                      & F.col("longitude").isNotNull())


def stg_public_art(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("TITLE").alias("title"), F.col("ARTIST_NAM").alias("artist"),
                      F.col("CLASSIFICA").alias("classification"),
                      F.col("MEDIUM").alias("medium"), F.col("DATED").alias("dated"),
                      F.col("LOCATION__").alias("location"),
                      F.col("DESCRIPTIO").alias("description"),
                      F.col("latitude").cast("double").alias("latitude"),
                      F.col("longitude").cast("double").alias("longitude"))


def stg_seattle_tides(raw: DataFrame) -> DataFrame:
    y, m = typed(raw, "year", "int"), typed(raw, "month", "int")
    out = raw.select(y.alias("year"), m.alias("month"),
                     C.date_from_parts(y.cast("string"), m.cast("string")).alias("obs_month"),
                     typed(raw, "MSL", "double").alias("msl_ft"),
                     typed(raw, "MHHW", "double").alias("mhhw_ft"),
                     typed(raw, "MLLW", "double").alias("mllw_ft"),
                     typed(raw, "GT", "double").alias("range_ft"),
                     typed(raw, "highest", "double").alias("highest_ft"),
                     typed(raw, "lowest", "double").alias("lowest_ft"))
    return out.filter(F.col("year").isNotNull())


def stg_short_term_rentals(raw: DataFrame) -> DataFrame:
    return raw.select("licenseid", "licensestatus",
                      _ts_date(raw, "licenseexpirationdate").alias("expiration_date"),
                      "propertytype", "geographicregion", "primaryresidence", "city", "zipcode",
                      typed(raw, "latitude", "double").alias("latitude"),
                      typed(raw, "longitude", "double").alias("longitude"))


def stg_snowpack(raw: DataFrame) -> DataFrame:
    d = typed(raw, "obs_date", "date")
    out = raw.select(d.alias("obs_date"), typed(raw, "swe_in", "double").alias("swe_in"),
                     typed(raw, "snow_depth_in", "double").alias("snow_depth_in"))
    out = out.filter(F.col("obs_date").isNotNull())
    return out.withColumn("water_year", C.water_year("obs_date"))


def stg_trees(raw: DataFrame) -> DataFrame:
    if "genus" not in raw.columns:
        raw = land_trees(raw)
    return raw.select("scientific_name", "genus",
                      C.blank_to_null("condition").alias("condition"),
                      C.yn_flag("heritage").alias("is_heritage"),
                      C.yn_flag("exceptional").alias("is_exceptional"), "district",
                      C.epoch_ms_to_date("planted_epoch_ms", floor="1900-01-01").alias("planted_date"),
                      typed(raw, "latitude", "double").alias("latitude"),
                      typed(raw, "longitude", "double").alias("longitude"))


def stg_weather(raw: DataFrame) -> DataFrame:
    def num(name):
        return C.lenient_double(F.trim(F.col(name).cast("string"))).alias(name)
    # parse each field once; the derived columns below reuse the parsed value
    # (Catalyst keeps a costly expression unduplicated when projects merge)
    parsed = raw.select(typed(raw, "DATE", "date").alias("obs_date"),
                        *[num(n) for n in ("PRCP", "SNOW", "SNWD", "TMAX", "TMIN")])
    prcp, tmax, tmin = F.col("PRCP"), F.col("TMAX"), F.col("TMIN")
    out = parsed.select("obs_date",
                        (prcp / 10.0).alias("precip_mm"), (prcp / 10.0 / 25.4).alias("precip_in"),
                        F.col("SNOW").alias("snow_mm"), F.col("SNWD").alias("snow_depth_mm"),
                        (tmax / 10.0).alias("tmax_c"), (tmin / 10.0).alias("tmin_c"),
                        (tmax / 10.0 * 9 / 5 + 32).alias("tmax_f"),
                        (tmin / 10.0 * 9 / 5 + 32).alias("tmin_f"))
    return out.filter(F.col("obs_date").isNotNull())


STAGING = {
    "air_quality": stg_air_quality,
    "building_permits": stg_building_permits,
    "business_licenses": stg_business_licenses,
    "cedar_river_flow": stg_cedar_river_flow,
    "crime": stg_crime,
    "csr_311": stg_csr_311,
    "fire_911": stg_fire_911,
    "food_inspections": stg_food_inspections,
    "ntd_ridership": stg_ntd_ridership,
    "parks": stg_parks,
    "public_art": stg_public_art,
    "seattle_tides": stg_seattle_tides,
    "short_term_rentals": stg_short_term_rentals,
    "snowpack": stg_snowpack,
    "trees": stg_trees,
    "weather": stg_weather,
}

# feeds whose staging groups rows of several files: their ledger keeps the raw rows,
# and staging is applied when they are read
GROUPED_STAGING = ("air_quality",)
