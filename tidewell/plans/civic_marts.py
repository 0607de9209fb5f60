"""Civic marts: the published summary tables as DataFrame functions.

Each mart takes the staging frames it needs (by name) and returns a lazy
DataFrame.  Sums and means of float readings use ``stable_sum`` /
``stable_mean`` so a rebuild gives the same bits on any partitioning.  Marts do not sort: order is applied when a mart is read
(``mart_order``), except where a limit makes order part of the result
(top-N and fixed-size samples).  ``build_marts`` writes the marts from staging, each
as a new copy that replaces the old one when it is whole, and can refresh the three
month-keyed marts by month; ``build_warehouse`` stages raw frames first.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.functions import columns as C
from tidewell.functions.numeric import stable_mean, stable_sum
from tidewell.operators import aggregates as A
from tidewell.operators import versions as V
from tidewell.operators.metrics import load_metrics, metric_table
from tidewell.operators.refresh import full_build, read_table, refresh, refresh_months
from tidewell.operators.topk import Extreme, extremes, hash_sample, top_rows
from tidewell.operators.windows import top_per_group
from tidewell.plans.civic_staging import GROUPED_STAGING, STAGING
from tidewell.sources.ledger import STAGE_MONTH, committed, months_since, read_staged

Frames = Mapping[str, DataFrame]


def _n(name: str):
    return F.count(F.lit(1)).alias(name)


def _pm(s: Frames) -> DataFrame:
    return s["air_quality"].filter(F.col("pollutant").like("PM2.5%"))


def _metro_daily_worst(s: Frames) -> DataFrame:
    # ties on the rounded AQI go to the first site, then county (total order)
    return top_per_group(_pm(s), ["obs_date"],
                         [F.desc_nulls_last("aqi"), F.asc("site"), F.asc("county")])


# ------------------------------------------------------------------ air
def mart_air_category_days(s: Frames) -> DataFrame:
    daily = _metro_daily_worst(s)
    return (daily.groupBy("aqi_category").agg(_n("day_count"))
                 .withColumn("severity", C.label_rank("aqi_category", C.AQI_LABELS)))


def mart_air_monthly(s: Frames) -> DataFrame:
    aq = s["air_quality"]
    return aq.groupBy(A.month_start("obs_date").alias("obs_month"), "pollutant").agg(
        stable_mean("aqi").alias("avg_aqi"), F.max("aqi").alias("max_aqi"), _n("reading_count"))


def mart_air_sites(s: Frames) -> DataFrame:
    return _pm(s).groupBy("site", "county").agg(
        stable_mean("latitude").alias("latitude"), stable_mean("longitude").alias("longitude"),
        F.round(stable_mean("aqi")).alias("avg_aqi"), F.max("aqi").alias("max_aqi"), _n("day_count"))


def mart_air_worst_days(s: Frames) -> DataFrame:
    daily = _metro_daily_worst(s).select("obs_date", F.col("aqi").alias("max_aqi"),
                                         "aqi_category", "site", "county")
    return top_rows(daily, [F.desc_nulls_last("max_aqi"), F.asc("obs_date")], 15)


# ------------------------------------------------------------------ art
def mart_art_by_type(s: Frames) -> DataFrame:
    return (s["public_art"].groupBy(C.label_or_unknown("classification").alias("classification"))
                           .agg(_n("artwork_count")))


def mart_art_points(s: Frames) -> DataFrame:
    return (s["public_art"].filter(C.in_box("latitude", "longitude"))
                           .select("title", "artist", "classification", "medium", "dated",
                                   "location", "latitude", "longitude"))


# ------------------------------------------------------------------ crime
def mart_crime_by_category(s: Frames) -> DataFrame:
    return A.frequency(s["crime"], "offense_category", "incident_count")


def mart_crime_by_hour_weekday(s: Frames) -> DataFrame:
    return A.grid(s["crime"], F.col("weekday"), F.col("hour_of_day"), "incident_count")


def mart_crime_map_sample(s: Frames, n: int = 12000, seed: str = "42") -> DataFrame:
    pts = (s["crime"].filter(C.in_box("latitude", "longitude"))
                     .select("report_number", "offense_category", "offense_description",
                             "report_datetime", "address", "latitude", "longitude"))
    return hash_sample(pts, n, None, seed)


def crime_monthly_rollup(df: DataFrame) -> DataFrame:
    return A.month_rollup(df, "report_datetime", "crime_month", {"incident_count": F.count(F.lit(1))})


def mart_crime_monthly(s: Frames) -> DataFrame:
    return crime_monthly_rollup(s["crime"])


# ------------------------------------------------------------------ 311
def mart_csr_by_department(s: Frames) -> DataFrame:
    return A.frequency(s["csr_311"], "department", "request_count")


def mart_csr_by_method(s: Frames) -> DataFrame:
    return A.frequency(s["csr_311"], "method_received", "request_count")


def mart_csr_by_type(s: Frames) -> DataFrame:
    return A.frequency(s["csr_311"], "request_type", "request_count")


def mart_csr_map_sample(s: Frames, n: int = 12000, seed: str = "42") -> DataFrame:
    pts = (s["csr_311"].filter(C.in_box("latitude", "longitude"))
                       .select("request_number", "request_type", "department", "created_at",
                               "address", "latitude", "longitude"))
    return hash_sample(pts, n, "request_number", seed)


def csr_monthly_rollup(df: DataFrame) -> DataFrame:
    return A.month_rollup(df, "created_at", "request_month", {"request_count": F.count(F.lit(1))})


def mart_csr_monthly(s: Frames) -> DataFrame:
    return csr_monthly_rollup(s["csr_311"])


# ------------------------------------------------------------------ transit & ferry
def _ferry(s: Frames) -> DataFrame:
    return s["ntd_ridership"].filter(F.col("is_ferry"))


def _transit(s: Frames) -> DataFrame:
    return s["ntd_ridership"].filter(~F.col("is_ferry"))


def _sum_upt():
    return F.sum("upt").cast("bigint")


def _ferry_monthly(s: Frames) -> DataFrame:
    return _ferry(s).groupBy("ridership_month").agg(_sum_upt().alias("boardings"))


def mart_ferry_annual(s: Frames) -> DataFrame:
    """Yearly boardings with the number of months reported (a partial year
    is left for the reader to filter on ``months_reported``)."""
    return (_ferry_monthly(s).groupBy(F.year("ridership_month").cast("int").alias("ridership_year"))
                             .agg(F.sum("boardings").cast("bigint").alias("boardings"),
                                  _n("months_reported")))


def mart_ferry_by_operator(s: Frames) -> DataFrame:
    op = C.two_way("agency", "Washington State Ferries", "Washington State Ferries",
                   "King County Water Taxi")
    return _ferry(s).groupBy(op.alias("operator")).agg(_sum_upt().alias("boardings"))


def mart_ferry_monthly(s: Frames) -> DataFrame:
    return _ferry_monthly(s)


def mart_ferry_seasonal(s: Frames) -> DataFrame:
    return (_ferry_monthly(s).groupBy(F.month("ridership_month").cast("int").alias("month_of_year"))
                             .agg(stable_mean("boardings").alias("avg_boardings")))


def mart_transit_by_agency(s: Frames) -> DataFrame:
    return _transit(s).groupBy("agency_label").agg(_sum_upt().alias("boardings"))


def mart_transit_by_mode(s: Frames) -> DataFrame:
    return _transit(s).groupBy("mode_label").agg(_sum_upt().alias("boardings"))


def mart_transit_light_rail_monthly(s: Frames) -> DataFrame:
    rail = s["ntd_ridership"].filter(F.col("mode_code") == "LR")
    return rail.groupBy("ridership_month").agg(_sum_upt().alias("boardings"))


def mart_transit_monthly(s: Frames) -> DataFrame:
    return _transit(s).groupBy("ridership_month").agg(_sum_upt().alias("boardings"))


# ------------------------------------------------------------------ fire
def mart_fire_by_hour_weekday(s: Frames) -> DataFrame:
    return A.grid(s["fire_911"], F.col("weekday"), F.col("hour_of_day"), "call_count")


def mart_fire_by_type(s: Frames) -> DataFrame:
    return A.frequency(s["fire_911"], "call_type", "call_count")


def mart_fire_map_sample(s: Frames, n: int = 12000, seed: str = "42") -> DataFrame:
    pts = (s["fire_911"].filter(C.in_box("latitude", "longitude"))
                        .select("call_type", "call_datetime", "address", "latitude", "longitude"))
    return hash_sample(pts, n, None, seed)


def mart_fire_monthly(s: Frames) -> DataFrame:
    return A.month_rollup(s["fire_911"], "call_datetime", "call_month", {"call_count": F.count(F.lit(1))})


# ------------------------------------------------------------------ food inspections
def mart_inspections(s: Frames) -> DataFrame:
    """One row per inspection; ``count(col)`` counts the violation rows."""
    return A.collapse(
        s["food_inspections"].filter(F.col("inspection_serial_num").isNotNull()),
        ["inspection_serial_num", "establishment", "inspection_date", "inspection_result", "grade"],
        {"inspection_score": F.max("inspection_score"),
         "violation_count": F.count("violation_type")})


def _insp(s: Frames) -> DataFrame:
    return s["mart_inspections"] if "mart_inspections" in s else mart_inspections(s)


def mart_inspection_results(s: Frames) -> DataFrame:
    return A.frequency(_insp(s), "inspection_result", "inspection_count")


def mart_inspections_over_time(s: Frames) -> DataFrame:
    return A.month_rollup(_insp(s), "inspection_date", "inspection_month",
                          {"inspection_count": F.count(F.lit(1)),
                           "avg_score": F.round(stable_mean("inspection_score"), 1)})


def mart_top_violations(s: Frames) -> DataFrame:
    return A.frequency(s["food_inspections"], "violation_description", "violation_count",
                       drop_blank=True)


def mart_worst_establishments(s: Frames) -> DataFrame:
    return A.having(_insp(s), ["establishment"],
                    {"inspections": F.count(F.lit(1)),
                     "avg_score": F.round(stable_mean("inspection_score"), 1),
                     "total_violations": F.sum("violation_count").cast("bigint")},
                    F.col("inspections") >= 3)


# ------------------------------------------------------------------ business licences
def mart_licenses_by_city(s: Frames) -> DataFrame:
    return (s["business_licenses"].groupBy(C.label_or_unknown("city", blank_is_null=False)
                                           .alias("city")).agg(_n("license_count")))


def mart_licenses_by_industry(s: Frames) -> DataFrame:
    return (s["business_licenses"]
            .groupBy(C.label_or_unknown("naics_description", blank_is_null=False)
                     .alias("naics_description")).agg(_n("license_count")))


def mart_licenses_by_ownership(s: Frames) -> DataFrame:
    return (s["business_licenses"]
            .groupBy(C.label_or_unknown("ownership_type", blank_is_null=False)
                     .alias("ownership_type")).agg(_n("license_count")))


def mart_licenses_monthly(s: Frames) -> DataFrame:
    lic = s["business_licenses"].filter(F.col("start_date") >= F.lit("2005-01-01").cast("date"))
    return A.month_rollup(lic, "start_date", "license_month", {"license_count": F.count(F.lit(1))})


# ------------------------------------------------------------------ parks
def mart_parks_largest(s: Frames) -> DataFrame:
    p = s["parks"].select("name", F.round("area_acres", 1).alias("area_acres"), "is_water_name",
                          F.col("area_acres").alias("_exact"))
    return top_rows(p, [F.desc("area_acres"), F.desc("_exact"), F.asc("name")], 15).drop("_exact")


def mart_parks_points(s: Frames) -> DataFrame:
    return s["parks"].select("name", F.round("area_acres", 2).alias("area_acres"),
                             "latitude", "longitude", "is_water_name")


def mart_parks_size_bands(s: Frames) -> DataFrame:
    p = s["parks"]
    banded = p.select(
        C.band("area_acres", C.PARK_SIZE_LIMITS, C.PARK_SIZE_LABELS, inclusive=False).alias("size_band"),
        C.band_rank("area_acres", C.PARK_SIZE_LIMITS, inclusive=False).alias("sort_order"))
    return banded.groupBy("size_band", "sort_order").agg(_n("park_count"))


# ------------------------------------------------------------------ permits
def mart_permits_by_class(s: Frames) -> DataFrame:
    return (s["building_permits"]
            .groupBy(C.label_or_unknown("permit_class", blank_is_null=False).alias("permit_class"))
            .agg(_n("permit_count"), stable_sum("valuation").alias("total_valuation"),
                 F.round(stable_mean("valuation"), 0).alias("avg_valuation")))


def mart_permits_map_sample(s: Frames, n: int = 5000) -> DataFrame:
    p = (s["building_permits"]
         .filter(F.col("issue_date").isNotNull() & C.in_box("latitude", "longitude"))
         .select("permit_number", "permit_class", "permit_type_desc", "valuation", "issue_date",
                 "address", "latitude", "longitude"))
    return top_rows(p, [F.desc("issue_date"), F.asc_nulls_last("permit_number")], n,
                    cutoff_key="issue_date")


def permits_monthly_rollup(df: DataFrame) -> DataFrame:
    return A.month_rollup(df, "issue_date", "issue_month",
                          {"permit_count": F.count(F.lit(1)), "total_valuation": stable_sum("valuation"),
                           "avg_valuation": F.round(stable_mean("valuation"), 0)})


def mart_permits_monthly(s: Frames) -> DataFrame:
    return permits_monthly_rollup(s["building_permits"])


# ------------------------------------------------------------------ water
def mart_river_annual(s: Frames) -> DataFrame:
    return A.year_rollup(s["cedar_river_flow"], "obs_date", "year",
                         {"avg_discharge_cfs": stable_mean("discharge_cfs"),
                          "min_discharge_cfs": F.min("discharge_cfs")})


def mart_river_monthly_normals(s: Frames) -> DataFrame:
    out = A.month_of_year_rollup(s["cedar_river_flow"], "obs_date",
                                 {"avg_discharge_cfs": stable_mean("discharge_cfs")})
    return out.withColumn("month_name", C.month_abbrev("month_num"))


def mart_snowpack_annual_peak(s: Frames) -> DataFrame:
    snow = s["snowpack"].filter(F.col("swe_in").isNotNull())
    return snow.groupBy("water_year").agg(F.max("swe_in").alias("peak_swe_in"))


def mart_snowpack_recent(s: Frames) -> DataFrame:
    """Days of the last three water years (cutoff as a scalar subquery)."""
    snow = s["snowpack"].filter(F.col("swe_in").isNotNull())
    start = snow.select(F.max("water_year") - 2).scalar()
    return snow.filter(F.col("water_year") >= start).select("obs_date", "water_year", "swe_in")


def mart_tides_annual(s: Frames) -> DataFrame:
    return s["seattle_tides"].groupBy("year").agg(
        stable_mean("msl_ft").alias("avg_msl_ft"), stable_mean("range_ft").alias("avg_range_ft"),
        _n("month_count"))


# ------------------------------------------------------------------ short-term rentals
def mart_str_by_region(s: Frames) -> DataFrame:
    return (s["short_term_rentals"]
            .groupBy(C.label_or_unknown("geographicregion", blank_is_null=False).alias("geographicregion"))
            .agg(_n("license_count")))


def mart_str_by_status(s: Frames) -> DataFrame:
    return A.frequency(s["short_term_rentals"], "licensestatus", "license_count")


def mart_str_by_type(s: Frames) -> DataFrame:
    return (s["short_term_rentals"]
            .groupBy(C.label_or_unknown("propertytype", blank_is_null=False).alias("propertytype"))
            .agg(_n("license_count")))


def mart_str_map(s: Frames) -> DataFrame:
    return (s["short_term_rentals"].filter(C.in_box("latitude", "longitude"))
                                   .select("licenseid", "licensestatus", "propertytype",
                                           "geographicregion", "latitude", "longitude"))


# ------------------------------------------------------------------ trees
def mart_trees_by_condition(s: Frames) -> DataFrame:
    return (s["trees"].groupBy(C.label_or_unknown("condition", blank_is_null=False,
                                                  default="Not assessed").alias("condition"))
                      .agg(_n("tree_count")))


def mart_trees_by_genus(s: Frames) -> DataFrame:
    return A.frequency(s["trees"], "genus", "tree_count")


def mart_trees_by_species(s: Frames) -> DataFrame:
    return A.frequency(s["trees"], "scientific_name", "tree_count")


def mart_trees_map_sample(s: Frames, n: int = 15000, seed: str = "42") -> DataFrame:
    pts = (s["trees"].filter(C.in_box("latitude", "longitude", C.TREES_BOX))
                     .select("scientific_name", "genus", "condition", "is_heritage",
                             "latitude", "longitude"))
    return hash_sample(pts, n, None, seed)


def mart_trees_planted_by_year(s: Frames, as_of: str = "2026-01-01") -> DataFrame:
    """Trees per planting year from 1970 up to ``as_of`` (a fixed date rather
    than today, so a rebuild repeats)."""
    t = s["trees"].filter((F.col("planted_date") >= F.lit("1970-01-01").cast("date"))
                          & (F.col("planted_date") <= F.lit(as_of).cast("date")))
    return A.year_rollup(t, "planted_date", "plant_year", {"tree_count": F.count(F.lit(1))})


def mart_trees_summary(s: Frames) -> DataFrame:
    one = A.distinct_row(s["trees"], {"distinct_species": "scientific_name", "distinct_genera": "genus"},
                         {"total_trees": F.lit(1), **{n: F.coalesce(F.col(c).cast("int"), F.lit(0)) for n, c in (
                             ("heritage_trees", "is_heritage"), ("exceptional_trees", "is_exceptional"))}})
    return one.select(F.coalesce("total_trees", F.lit(0)).alias("total_trees"), "distinct_species",
                      "distinct_genera", "heritage_trees", "exceptional_trees")


# ------------------------------------------------------------------ weather
def mart_weather_annual(s: Frames) -> DataFrame:
    return A.year_rollup(s["weather"], "obs_date", "year", {
        "total_precip_in": stable_sum("precip_in"),
        "rain_days": A.count_where(F.col("precip_in") > 0.01),
        "avg_tmax_f": stable_mean("tmax_f"), "avg_tmin_f": stable_mean("tmin_f")})


def mart_weather_monthly_normals(s: Frames) -> DataFrame:
    out = A.month_of_year_rollup(s["weather"], "obs_date", {
        "avg_precip_in": stable_mean("precip_in"), "avg_tmax_f": stable_mean("tmax_f"),
        "avg_tmin_f": stable_mean("tmin_f")})
    return out.withColumn("month_name", C.month_abbrev("month_num"))


def mart_weather_recent(s: Frames) -> DataFrame:
    """Days of the last two years before the newest day (scalar subquery)."""
    daily = s["weather"]
    start = daily.select(F.add_months(F.max("obs_date"), -24)).scalar()
    return daily.filter(F.col("obs_date") >= start).select("obs_date", "tmax_f", "tmin_f",
                                                             "precip_in")


WEATHER_RECORDS = (
    Extreme(1, "Hottest day", "tmax_f", True, lambda v: C.display_int(v, " °F")),
    Extreme(2, "Coldest day", "tmin_f", False, lambda v: C.display_int(v, " °F")),
    Extreme(3, "Wettest day", "precip_in", True, lambda v: C.display_round(v, 2, " in")),
    Extreme(4, "Snowiest day", "snow_in", True, lambda v: C.display_round(v, 1, " in")),
)


def mart_weather_records(s: Frames) -> DataFrame:
    daily = s["weather"].withColumn("snow_in", F.col("snow_mm") / 25.4)
    return extremes(daily, "obs_date", WEATHER_RECORDS).select("record_type", "obs_date", "value")


# ------------------------------------------------------------------ build info & metrics
# the marts whose rows mart_build_info adds up
BUILD_INFO_INPUTS = ("mart_permits_monthly", "mart_crime_monthly", "mart_fire_monthly",
                     "mart_inspections", "mart_csr_monthly", "mart_licenses_by_industry",
                     "mart_art_by_type", "mart_parks_points", "mart_trees_summary")


def mart_build_info(m: Frames, built_at: str) -> DataFrame:
    """Build time plus the total of nine grain counts (scalar subqueries)."""
    parts = [m["mart_permits_monthly"].select(F.sum("permit_count")),
             m["mart_crime_monthly"].select(F.sum("incident_count")),
             m["mart_fire_monthly"].select(F.sum("call_count")),
             m["mart_inspections"].select(F.count(F.lit(1))),
             m["mart_csr_monthly"].select(F.sum("request_count")),
             m["mart_licenses_by_industry"].select(F.sum("license_count")),
             m["mart_art_by_type"].select(F.sum("artwork_count")),
             m["mart_parks_points"].select(F.count(F.lit(1))),
             m["mart_trees_summary"].select(F.max("total_trees"))]
    total = F.lit(0).cast("bigint")
    for p in parts:
        total = total + F.coalesce(p.scalar().cast("bigint"), F.lit(0))
    first = m["mart_trees_summary"].sparkSession.range(1)
    return first.select(F.lit(built_at).cast("timestamp_ntz").alias("built_at"),
                        total.alias("total_records"))


CIVIC_METRICS_PATH = Path(__file__).with_name("civic_metrics.yml")


def derived_inputs(name: str) -> list[str]:
    """The marts that a derived mart reads."""
    if name == "mart_build_info":
        return list(BUILD_INFO_INPUTS)
    return sorted({x["table"] for x in load_metrics(CIVIC_METRICS_PATH)})


def mart_metrics(m: Frames, registry_path: str | Path = CIVIC_METRICS_PATH) -> DataFrame:
    return metric_table(m, load_metrics(registry_path))


# name -> (staging feeds used, function)
MARTS: dict[str, tuple[tuple[str, ...], Callable[[Frames], DataFrame]]] = {
    "mart_air_category_days": (("air_quality",), mart_air_category_days),
    "mart_air_monthly": (("air_quality",), mart_air_monthly),
    "mart_air_sites": (("air_quality",), mart_air_sites),
    "mart_air_worst_days": (("air_quality",), mart_air_worst_days),
    "mart_art_by_type": (("public_art",), mart_art_by_type),
    "mart_art_points": (("public_art",), mart_art_points),
    "mart_crime_by_category": (("crime",), mart_crime_by_category),
    "mart_crime_by_hour_weekday": (("crime",), mart_crime_by_hour_weekday),
    "mart_crime_map_sample": (("crime",), mart_crime_map_sample),
    "mart_crime_monthly": (("crime",), mart_crime_monthly),
    "mart_csr_by_department": (("csr_311",), mart_csr_by_department),
    "mart_csr_by_method": (("csr_311",), mart_csr_by_method),
    "mart_csr_by_type": (("csr_311",), mart_csr_by_type),
    "mart_csr_map_sample": (("csr_311",), mart_csr_map_sample),
    "mart_csr_monthly": (("csr_311",), mart_csr_monthly),
    "mart_ferry_annual": (("ntd_ridership",), mart_ferry_annual),
    "mart_ferry_by_operator": (("ntd_ridership",), mart_ferry_by_operator),
    "mart_ferry_monthly": (("ntd_ridership",), mart_ferry_monthly),
    "mart_ferry_seasonal": (("ntd_ridership",), mart_ferry_seasonal),
    "mart_fire_by_hour_weekday": (("fire_911",), mart_fire_by_hour_weekday),
    "mart_fire_by_type": (("fire_911",), mart_fire_by_type),
    "mart_fire_map_sample": (("fire_911",), mart_fire_map_sample),
    "mart_fire_monthly": (("fire_911",), mart_fire_monthly),
    "mart_inspections": (("food_inspections",), mart_inspections),
    "mart_inspection_results": (("mart_inspections",), mart_inspection_results),
    "mart_inspections_over_time": (("mart_inspections",), mart_inspections_over_time),
    "mart_top_violations": (("food_inspections",), mart_top_violations),
    "mart_worst_establishments": (("mart_inspections",), mart_worst_establishments),
    "mart_licenses_by_city": (("business_licenses",), mart_licenses_by_city),
    "mart_licenses_by_industry": (("business_licenses",), mart_licenses_by_industry),
    "mart_licenses_by_ownership": (("business_licenses",), mart_licenses_by_ownership),
    "mart_licenses_monthly": (("business_licenses",), mart_licenses_monthly),
    "mart_parks_largest": (("parks",), mart_parks_largest),
    "mart_parks_points": (("parks",), mart_parks_points),
    "mart_parks_size_bands": (("parks",), mart_parks_size_bands),
    "mart_permits_by_class": (("building_permits",), mart_permits_by_class),
    "mart_permits_map_sample": (("building_permits",), mart_permits_map_sample),
    "mart_permits_monthly": (("building_permits",), mart_permits_monthly),
    "mart_river_annual": (("cedar_river_flow",), mart_river_annual),
    "mart_river_monthly_normals": (("cedar_river_flow",), mart_river_monthly_normals),
    "mart_snowpack_annual_peak": (("snowpack",), mart_snowpack_annual_peak),
    "mart_snowpack_recent": (("snowpack",), mart_snowpack_recent),
    "mart_str_by_region": (("short_term_rentals",), mart_str_by_region),
    "mart_str_by_status": (("short_term_rentals",), mart_str_by_status),
    "mart_str_by_type": (("short_term_rentals",), mart_str_by_type),
    "mart_str_map": (("short_term_rentals",), mart_str_map),
    "mart_tides_annual": (("seattle_tides",), mart_tides_annual),
    "mart_transit_by_agency": (("ntd_ridership",), mart_transit_by_agency),
    "mart_transit_by_mode": (("ntd_ridership",), mart_transit_by_mode),
    "mart_transit_light_rail_monthly": (("ntd_ridership",), mart_transit_light_rail_monthly),
    "mart_transit_monthly": (("ntd_ridership",), mart_transit_monthly),
    "mart_trees_by_condition": (("trees",), mart_trees_by_condition),
    "mart_trees_by_genus": (("trees",), mart_trees_by_genus),
    "mart_trees_by_species": (("trees",), mart_trees_by_species),
    "mart_trees_map_sample": (("trees",), mart_trees_map_sample),
    "mart_trees_planted_by_year": (("trees",), mart_trees_planted_by_year),
    "mart_trees_summary": (("trees",), mart_trees_summary),
    "mart_weather_annual": (("weather",), mart_weather_annual),
    "mart_weather_monthly_normals": (("weather",), mart_weather_monthly_normals),
    "mart_weather_recent": (("weather",), mart_weather_recent),
    "mart_weather_records": (("weather",), mart_weather_records),
}

# marts built from other marts (after the staging-level ones)
DERIVED = ("mart_build_info", "mart_metrics")

# the order each mart is read in (SRT1; '-' = descending); marts not listed
# have no defined order
# the measure that a mart is listed by, largest first
_BY_MEASURE = {
    "artwork_count": ("mart_art_by_type",), "incident_count": ("mart_crime_by_category",),
    "request_count": ("mart_csr_by_department", "mart_csr_by_method", "mart_csr_by_type"),
    "boardings": ("mart_ferry_by_operator", "mart_transit_by_agency", "mart_transit_by_mode"),
    "call_count": ("mart_fire_by_type",), "inspection_count": ("mart_inspection_results",),
    "license_count": ("mart_licenses_by_city", "mart_licenses_by_industry", "mart_licenses_by_ownership",
                      "mart_str_by_region", "mart_str_by_status", "mart_str_by_type"),
    "area_acres": ("mart_parks_largest", "mart_parks_points"), "permit_count": ("mart_permits_by_class",),
    "issue_date": ("mart_permits_map_sample",), "violation_count": ("mart_top_violations",),
    "tree_count": ("mart_trees_by_condition", "mart_trees_by_genus", "mart_trees_by_species"),
    "avg_aqi": ("mart_air_sites",), "max_aqi": ("mart_air_worst_days",),
    "avg_score": ("mart_worst_establishments",),
}
# marts listed by their leading columns, by how many
_BY_LEADING = {
    1: ("mart_crime_monthly", "mart_csr_monthly", "mart_ferry_annual", "mart_ferry_monthly",
        "mart_ferry_seasonal", "mart_fire_monthly", "mart_inspections_over_time", "mart_licenses_monthly",
        "mart_permits_monthly", "mart_river_annual", "mart_river_monthly_normals",
        "mart_snowpack_annual_peak", "mart_tides_annual", "mart_transit_light_rail_monthly",
        "mart_transit_monthly", "mart_trees_planted_by_year", "mart_weather_annual",
        "mart_weather_monthly_normals"),
    2: ("mart_air_monthly", "mart_crime_by_hour_weekday", "mart_fire_by_hour_weekday"),
}
RECORD_ORDER = ("Hottest day", "Coldest day", "Wettest day", "Snowiest day")


def mart_order(name: str, columns: Sequence[str]) -> list:
    """Sort columns of a mart as it is shown, the other columns breaking ties;
    empty for marts without an order."""
    named = {"mart_air_category_days": "severity", "mart_parks_size_bands": "sort_order",
             "mart_metrics": "metric_name", "mart_snowpack_recent": "obs_date",
             "mart_weather_recent": "obs_date"}
    lead: list = []
    for measure, marts in _BY_MEASURE.items():
        if name in marts:
            lead = [F.desc_nulls_last(measure)]
    for n, marts in _BY_LEADING.items():
        if name in marts:
            lead = [F.asc_nulls_last(c) for c in
                    ([INCREMENTAL[name][3]] if name in INCREMENTAL else columns[:n])]
    if name in named:
        lead = [F.asc_nulls_last(named[name])]
    if name == "mart_weather_records":
        lead = [F.array_position(F.array(*[F.lit(x) for x in RECORD_ORDER]), F.col("record_type"))]
    return lead + [F.asc_nulls_last(c) for c in columns] if lead else []

# month-keyed marts refreshed incrementally: name -> (feed, time column, rollup, month column)
INCREMENTAL = {
    "mart_crime_monthly": ("crime", "report_datetime", crime_monthly_rollup, "crime_month"),
    "mart_csr_monthly": ("csr_311", "created_at", csr_monthly_rollup, "request_month"),
    "mart_permits_monthly": ("building_permits", "issue_date", permits_monthly_rollup, "issue_month"),
}


def staging_frames(raw: Frames) -> dict[str, DataFrame]:
    """Staging for every raw feed present."""
    return {name: fn(raw[name]) for name, fn in STAGING.items() if name in raw}


def marts_for(staged: Frames, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Lazy marts whose inputs are present (all of them, or ``names``)."""
    chosen = list(names) if names else list(MARTS)
    unknown = [n for n in chosen if n not in MARTS]
    if unknown:
        raise KeyError(f"unknown marts: {unknown}")
    frames = dict(staged)
    out = {}
    if "food_inspections" in frames and "mart_inspections" not in frames:
        frames["mart_inspections"] = mart_inspections(frames)
    for n in chosen:
        deps, fn = MARTS[n]
        if all(d in frames for d in deps):
            out[n] = fn(frames)
    return out


def build_warehouse(spark: SparkSession, raw: Frames, out_dir: str,
                    names: Sequence[str] | None = None, built_at: str = "1970-01-01 00:00:00",
                    incremental: bool = False) -> list[str]:
    """Stage raw frames, then write each mart as Parquet under ``out_dir``.

    Staging is written to ``out_dir/staging/<feed>`` and read back, so the
    marts sharing a feed (up to eight) never re-parse its text, and lineage
    is cut at a durable folder.  All of ``raw`` is staged each time; with
    ``incremental`` only the month-keyed marts' trailing window is aggregated.
    ``civic_build.build_from_landing`` keeps a ledger and parses new files only.
    """
    needed = None
    chosen = _asked_and_inputs(names)
    if names:
        needed = {"food_inspections" if d == "mart_inspections" else d
                  for n in chosen for d in MARTS.get(n, ((),))[0]}
    month_keyed = {feed: ts for feed, ts, _, _ in INCREMENTAL.values()}
    staged = {}
    for feed, df in staging_frames(raw).items():
        if needed is not None and feed not in needed:
            continue
        if feed in month_keyed:
            # month folders: a trailing-window refresh reads only its months
            df = df.withColumn(STAGE_MONTH, A.month_start(month_keyed[feed]))
        V.replace_table(df, f"{out_dir}/staging/{feed}", [STAGE_MONTH] if feed in month_keyed else ())
        staged[feed] = read_staging(spark, out_dir, feed, own_columns=True)
    return build_marts(spark, staged, out_dir, names, built_at, "window" if incremental else "all")


def _asked_and_inputs(names: Sequence[str] | None) -> list[str]:
    """The named marts and those that named derived marts read; empty for all."""
    asked = list(names or ())
    return list(dict.fromkeys([n for n in asked if n not in DERIVED]
                              + [x for n in asked if n in DERIVED for x in derived_inputs(n)]))


def _positions(spark: SparkSession, out_dir: str, feeds) -> dict[str, tuple[int, int]]:
    """(copy, last batch) of each feed's staging; 0 batches where no ledger is kept."""
    out = {}
    for feed in feeds:
        table = f"{out_dir}/staging/{feed}"
        number = V.current_number(spark, table)
        out[feed] = (number, committed(spark, V.copy_path(table, number)))
    return out


def _built_from(spark: SparkSession, out_dir: str, name: str) -> dict[str, tuple[int, int]]:
    """The staging positions that a mart was last built from, by feed."""
    notes = [n.split(".") for n in V.names_in(spark, f"{out_dir}/built/{name}", folders=False)]
    out: dict[str, tuple[int, int]] = {}
    for feed, number, batch in (n for n in notes if len(n) == 3):
        out[feed] = max(out.get(feed, (0, 0)), (int(number), int(batch)))
    return out


def build_marts(spark: SparkSession, staged: Frames, out_dir: str, names: Sequence[str] | None = None,
                built_at: str = "1970-01-01 00:00:00", what: str = "all") -> list[str]:
    """Write marts from staging frames; each replaces its old copy when it is whole.

    ``what`` is "all" for a full build, "window" to refresh the trailing months of the
    month-keyed marts, "new" to take over what was staged since each mart was built:
    month-keyed marts rebuild the months touched since then, a mart whose feeds have
    nothing new is left as it is, and the others are rebuilt.  A mart notes the staging
    it was built from after it is written, so a build that died is made up for.
    ``mart_inspections`` is written before the three marts that read it.
    """
    asked = list(names or ())
    derived = [n for n in DERIVED if n in asked or not names]
    chosen = _asked_and_inputs(names) if names else None
    frames = {n: df.drop(STAGE_MONTH, "batch", "source_file") for n, df in staged.items()}
    now = _positions(spark, out_dir, staged)

    def sources(n):
        return {"food_inspections" if d == "mart_inspections" else d for d in MARTS[n][0]}

    def noted(n):
        at = _built_from(spark, out_dir, n)
        return {f: at.get(f) for f in sources(n)}

    def note(n):
        for f in sources(n):
            path = f"{out_dir}/built/{n}/{f}.{now[f][0]}.{now[f][1]}"
            if path.rsplit("/", 1)[1] not in V.names_in(spark, f"{out_dir}/built/{n}", folders=False):
                V.create_marker(spark, path)

    def current(n):
        return what == "new" and V.exists(spark, f"{out_dir}/marts/{n}") \
            and noted(n) == {f: now[f] for f in sources(n)}
    if "food_inspections" in frames:
        if not current("mart_inspections"):
            V.replace_table(mart_inspections(frames), f"{out_dir}/marts/mart_inspections")
        frames["mart_inspections"] = V.read_table(spark, f"{out_dir}/marts/mart_inspections")
    lazy = marts_for(frames, chosen)
    missing = [n for n in chosen or () if n not in lazy]
    if missing:
        raise KeyError(f"marts whose feeds are not landed: {missing}")
    written = []
    for n, df in lazy.items():
        p = f"{out_dir}/marts/{n}"
        if current(n):
            continue
        if n in INCREMENTAL:
            feed, ts, rollup, mcol = INCREMENTAL[n]
            rows = staged[feed].filter(F.col(ts).isNotNull())
            before = noted(n)[feed]
            if what == "new" and before and before[0] == now[feed][0]:
                store = V.current_path(spark, f"{out_dir}/staging/{feed}")
                refresh_months(spark, rows, months_since(spark, store, before[1]), rollup, p, mcol, STAGE_MONTH)
            elif what == "window":
                refresh(spark, rows, ts, rollup, p, mcol, partition_col=STAGE_MONTH)
            else:
                full_build(staged[feed], rollup, p, mcol)
        elif n != "mart_inspections":
            V.replace_table(df, p)
        note(n)
        written.append(n)
    if "food_inspections" in frames:
        note("mart_inspections")
    marts = {n: read_mart(spark, out_dir, n, ordered=False) for n in lazy}
    for n in derived:
        lacking = [x for x in derived_inputs(n) if x not in marts]
        if lacking and n in asked:
            raise KeyError(f"{n} needs marts that were not built: {lacking}")
        if lacking:                      # a landing of some feeds only
            continue
        df = mart_build_info(marts, built_at) if n == "mart_build_info" else mart_metrics(marts)
        V.replace_table(df, f"{out_dir}/marts/{n}")
        written.append(n)
    return written


def read_mart(spark: SparkSession, out_dir: str, name: str, ordered: bool = True) -> DataFrame:
    if name in INCREMENTAL:
        mcol = INCREMENTAL[name][3]
        df = read_table(spark, f"{out_dir}/marts/{name}", mcol)
    else:
        df = V.read_table(spark, f"{out_dir}/marts/{name}")
    order = mart_order(name, df.columns) if ordered else []
    if order:
        df = df.orderBy(*order)
    return df


def read_staging(spark: SparkSession, out_dir: str, feed: str, own_columns: bool = False) -> DataFrame:
    """Typed rows of a staged feed; with ``own_columns`` also the month that they are
    stored by and, where a ledger is kept, their batch and file."""
    path = V.current_path(spark, f"{out_dir}/staging/{feed}")
    if "committed" in list_folders(spark, path):
        rows = read_staged(spark, path, own_columns and feed not in GROUPED_STAGING)
        return STAGING[feed](rows) if feed in GROUPED_STAGING else rows
    df = spark.read.parquet(path)
    if STAGE_MONTH in df.columns:
        df = df.withColumn(STAGE_MONTH, F.col(STAGE_MONTH).cast("date"))
    return df if own_columns else df.drop(STAGE_MONTH)


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the sub-folders of ``path`` on any Hadoop file system
    (local, HDFS, object store); empty when ``path`` does not exist."""
    return V.names_in(spark, path)


def warehouse_frames(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """Every built staging table (as ``stg_<feed>``) and mart under ``out_dir``."""
    frames: dict[str, DataFrame] = {}
    for kind, prefix in (("staging", "stg_"), ("marts", "")):
        base = f"{out_dir}/{kind}"
        for n in list_folders(spark, base):
            frames[prefix + n] = (read_mart(spark, out_dir, n, ordered=False) if kind == "marts"
                                  else read_staging(spark, out_dir, n))
    return frames


def register_warehouse_views(spark: SparkSession, out_dir: str) -> list[str]:
    """Register every built staging table and mart as a temp view under its
    model name, for ad-hoc read-only SQL (``audit.run_read_only``)."""
    frames = warehouse_frames(spark, out_dir)
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return sorted(frames)
