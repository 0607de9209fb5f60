"""Build the civic warehouse from a landing folder of raw feed files.

Layout: ``<landing>/<feed>/`` holds that feed's files as they were landed —
CSV exports (read as text), JSON row pages, feature pages, nested JSON
series or '#'-commented CSV.  Each feed is read with the matching landing
reader, filtered at the source the way the published fetchers filter, given
its landing-time derived columns (labels, flags, genus, centroids), and
guarded against an empty feed.  ``main`` builds all tables or a named
subset; an unknown name is an error before anything runs.

    python -m tidewell.plans.civic_build --landing DIR --out DIR [--tables crime,trees]
                                         [--incremental] [--check]
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidewell.functions import columns as C
from tidewell.functions.geo import centroid
from tidewell.operators import versions as V
from tidewell.plans import civic_marts as M
from tidewell.plans import civic_staging as S
from tidewell.sources import landing as L
from tidewell.sources.ledger import Load, stage_new

# fixed values: source-side start dates of the incident feeds and ridership
CRIME_START = "2019-01-01"
FIRE_START = "2019-01-01"
CSR_311_START = "2020-01-01"
NTD_START = "2015-01-01"
NTD_STATE = "WA"

# fixed values: air-quality national daily files -> metro rows
AQS_STATE = "53"
AQS_COUNTIES = ("033", "053", "061")
AQS_COLUMNS = {
    "State Code": "state_code",
    "County Code": "county_code",
    "County Name": "county_name",
    "Site Num": "site_num",
    "Parameter Code": "parameter_code",
    "Parameter Name": "parameter_name",
    "Latitude": "latitude",
    "Longitude": "longitude",
    "Date Local": "date_local",
    "Arithmetic Mean": "arithmetic_mean",
    "AQI": "aqi",
    "Units of Measure": "units",
    "Local Site Name": "local_site_name",
    "CBSA Name": "cbsa_name",
}

# raw columns read from JSON row pages (everything as text)
PAGE_COLUMNS = {
    "building_permits": ("permitnum", "permitclass", "permitclassmapped", "permittypemapped",
                         "permittypedesc", "description", "housingunitsadded", "estprojectcost",
                         "applieddate", "issueddate", "completeddate", "statuscurrent",
                         "originaladdress1", "originalcity", "originalzip", "latitude",
                         "longitude"),
    "food_inspections": ("name", "inspection_date", "city", "zip_code", "inspection_type",
                         "inspection_result", "grade", "risk_category", "inspection_score",
                         "violation_type", "violation_description", "violation_points",
                         "inspection_serial_num", "business_id"),
    "short_term_rentals": ("licenseid", "licensestatus", "licenseexpirationdate", "propertytype",
                           "geographicregion", "primaryresidence", "city", "zipcode",
                           "latitude", "longitude"),
    "business_licenses": ("business_legal_name", "trade_name", "ownership_type", "naics_code",
                          "naics_description", "license_start_date", "city", "zip"),
    "ntd_ridership": ("agency", "mode", "tos", "date", "upt", "state"),
}

# feature layers: attribute -> raw column
FEATURE_FIELDS = {
    "public_art": {"TITLE": "TITLE", "ARTIST_NAM": "ARTIST_NAM", "CLASSIFICA": "CLASSIFICA",
                   "MEDIUM": "MEDIUM", "DATED": "DATED", "LOCATION__": "LOCATION__",
                   "DESCRIPTIO": "DESCRIPTIO"},
    "parks": {"NAME": "name", "PARKSBND_AREA": "area_sqft"},
    "trees": {"SCIENTIFIC_NAME": "scientific_name", "CONDITION": "condition",
              "HERITAGE": "heritage", "EXCEPTIONAL": "exceptional",
              "PLANTED_DATE": "planted_epoch_ms", "PRIMARYDISTRICTCD": "district"},
}

CSV_FEEDS = {"crime": ("report_date_time", CRIME_START),
             "fire_911": ("datetime", FIRE_START),
             "csr_311": ("createddate", CSR_311_START),
             "weather": None}


# the time column that a feed's staging is stored by month of
MONTH_KEYED = {feed: ts for feed, ts, _, _ in M.INCREMENTAL.values()}


def _csv(spark, paths, start, guard):
    df = L.read_csv_text(spark, paths, guard=guard)
    if start:
        col, since = start
        df = df.filter(F.col(col) >= F.lit(since))
    return df


def _features(spark, paths, fields, guard, page_rows):
    attrs = T.StructType([T.StructField(a, T.StringType()) for a in fields])
    df = L.read_features(spark, paths, attrs, guard=guard, page_rows=page_rows)
    lon, lat = centroid(F.col("geometry"))
    return df.select(*[F.col(a).alias(c) for a, c in fields.items()],
                     lon.alias("longitude"), lat.alias("latitude"))


def read_feed(spark: SparkSession, feed: str, paths: L.Paths, guard: bool = True,
              page_rows: int | None = None) -> DataFrame:
    """One raw feed from its landed files.  ``guard`` checks for rows with a job of its
    own; loads that count what they write do without.  ``page_rows`` is the size of a
    full page where it is not the usual one."""
    if feed in CSV_FEEDS:
        return _csv(spark, paths, CSV_FEEDS[feed], guard)
    if feed == "air_quality":
        nat = L.read_csv_text(spark, paths, guard=False)
        keep = ((F.col("State Code") == AQS_STATE) & F.col("County Code").isin(*AQS_COUNTIES)
                & F.col("AQI").isNotNull() & (F.col("AQI") != ""))
        df = L.filter_and_rename(nat, keep, AQS_COLUMNS)
        return L.require_rows(df, paths) if guard else df
    if feed in PAGE_COLUMNS:
        df = L.read_json_pages(spark, paths, L.text_schema(PAGE_COLUMNS[feed]), guard=guard,
                               page_rows=page_rows or L.ROW_PAGE)
        if feed == "ntd_ridership":
            df = df.filter(F.col("agency").isin(*C.TRANSIT_AGENCIES) & (F.col("state") == NTD_STATE)
                           & (F.col("date") >= F.lit(NTD_START))).drop("state")
            df = S.land_ntd(df)
        return df
    if feed in FEATURE_FIELDS:
        df = _features(spark, paths, FEATURE_FIELDS[feed], guard, page_rows or L.FEATURE_PAGE)
        if feed == "parks":
            df = S.land_parks(df)
        if feed == "trees":
            df = S.land_trees(df)
        return df
    if feed == "cedar_river_flow":
        return L.read_time_series(spark, paths, guard=guard)
    if feed == "seattle_tides":
        return L.read_tide_months(spark, paths, guard=guard)
    if feed == "snowpack":
        return L.read_comment_csv(spark, paths, ["obs_date", "swe_in", "snow_depth_in"], guard=guard)
    raise KeyError(f"unknown feed {feed!r}")


def load_feed(spark: SparkSession, landing: str, feed: str) -> DataFrame:
    """One raw feed from ``<landing>/<feed>``."""
    return read_feed(spark, feed, f"{landing.rstrip('/')}/{feed}")


def stage_feed(spark: SparkSession, landing: str, feed: str, out_dir: str, incremental: bool = False,
               page_rows: int | None = None) -> Load:
    """Stage a feed's landed files under ``<out>/staging/<feed>``.

    A full build stages all files into a new copy, which readers see when it is
    complete; an incremental one parses and appends only files that the ledger of
    the current copy does not have.
    """
    table = f"{out_dir}/staging/{feed}"
    append = incremental and V.exists(spark, table)
    number = V.current_number(spark, table) if append else V.new_copy(spark, table)

    def read(paths):
        raw = read_feed(spark, feed, paths, False, page_rows)
        return raw if feed in S.GROUPED_STAGING else S.STAGING[feed](raw)
    load = stage_new(spark, f"{landing.rstrip('/')}/{feed}", V.copy_path(table, number), read, MONTH_KEYED.get(feed))
    if not append:
        V.publish(spark, table, number)
    return load


def feeds_for(tables: Sequence[str] | None) -> list[str]:
    """Feeds needed by the named marts (or feeds named directly)."""
    if not tables:
        return list(S.STAGING)
    feeds: list[str] = []
    for t in tables:
        if t in S.STAGING:
            deps = (t,)
        elif t in M.MARTS:
            deps = M.MARTS[t][0]
        elif t in M.DERIVED:
            deps = tuple(S.STAGING)
        else:
            raise KeyError(f"unknown table {t!r}")
        for d in deps:
            d = "food_inspections" if d == "mart_inspections" else d
            if d not in feeds:
                feeds.append(d)
    return feeds


def build_from_landing(spark: SparkSession, landing: str, out_dir: str,
                       tables: Sequence[str] | None = None, incremental: bool = False,
                       built_at: str = "1970-01-01 00:00:00",
                       page_rows: Mapping[str, int] | None = None) -> list[str]:
    """Stage the feeds and build the marts; returns the marts written.

    With ``incremental``, files in the ledger are not opened again, month-keyed marts
    rebuild only the months that new files touched, marts of feeds without new files
    stay as they are, and the others are rebuilt from staging.  Each mart remembers the
    batches that it was built from, so a build that died after staging is made up for.
    """
    feeds = feeds_for(tables)                       # validates every name first
    for f in feeds:
        stage_feed(spark, landing, f, out_dir, incremental, (page_rows or {}).get(f))
    marts = [t for t in tables if t in M.MARTS or t in M.DERIVED] if tables else None
    frames = {f: M.read_staging(spark, out_dir, f, own_columns=True) for f in feeds}
    return M.build_marts(spark, frames, out_dir, marts or None, built_at, "new" if incremental else "all")


def main(argv: Sequence[str] | None = None) -> None:
    from tidewell.session import get_session
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--landing", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--tables", default="")
    ap.add_argument("--incremental", action="store_true")
    ap.add_argument("--page-rows", default="", help="full page sizes that differ, e.g. trees=1000,parks=500")
    ap.add_argument("--built-at", default="1970-01-01 00:00:00")
    ap.add_argument("--check", action="store_true", help="run the data checks; fail on errors")
    ap.add_argument("--profile", default="cluster")
    args = ap.parse_args(argv)
    spark = get_session(app="tidewell-build", profile=args.profile)
    tables = [t for t in args.tables.split(",") if t]
    written = build_from_landing(spark, args.landing, args.out, tables or None,
                                 args.incremental, args.built_at,
                                 {k: int(n) for k, n in (x.split("=") for x in args.page_rows.split(",") if x)})
    print("built:", ", ".join(written))
    if args.check:
        from tidewell.plans.civic_quality import civic_parse_report
        raw = {f: load_feed(spark, args.landing, f) for f in feeds_for(tables or None)}
        civic_parse_report(raw).write.mode("overwrite").parquet(f"{args.out}/parse_report")
        from tidewell.operators.quality import raise_on_error
        from tidewell.plans.civic_quality import civic_quality_report
        report = civic_quality_report(spark, M.warehouse_frames(spark, args.out))
        report.write.mode("overwrite").parquet(f"{args.out}/quality_report")
        raise_on_error(spark.read.parquet(f"{args.out}/quality_report"))


if __name__ == "__main__":
    main()
