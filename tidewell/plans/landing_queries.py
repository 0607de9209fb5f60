"""Landed files in the gate: loads, pages, nested documents, replaced tables.

Each query lays rows of the test tables out as landed files in a fresh folder of the
shared directory and reads them with the library's own readers.  Where a reader must
refuse something (a missing page, a document without series, an empty layer), the
query plants it and returns what happened as a row.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from tidewell.functions import columns as C
from tidewell.functions.geo import centroid
from tidewell.functions.numeric import exact_sum, fixed
from tidewell.operators import aggregates as A
from tidewell.operators import versions as V
from tidewell.operators.bucketed import bucketed_orphans, write_bucketed
from tidewell.operators.quality import Freshness, freshness_of
from tidewell.operators.refresh import read_table, refresh_months
from tidewell.session import shared_dir
from tidewell.sources import landing as L
from tidewell.sources.footers import table_ranges
from tidewell.sources.ledger import STAGE_MONTH, read_staged, stage_new, staged_span
from tidewell.sources.tables import load, table_path

FILE_ROWS = 20_000           # about the rows of one landed file
LAYER_PAGES = 400            # pages of a layer before they grow beyond 50 features


def _refused(run) -> str:
    """'refused' if ``run`` raises what a reader raises, else 'loaded'."""
    try:
        run()
    except (ValueError, KeyError, PySparkException):
        return "refused"
    return "loaded"


# ---------------------------------------------------------------- INC1, SNK4, FRS1
def _landed_orders(spark, sf_dir):
    """Orders with the name of their landed file: year, and a part of it where a year
    has more rows than a file should."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    years = orders.agg(F.count(F.lit(1)).alias("n"), F.min(F.year("o_orderdate")).alias("first"),
                       F.max(F.year("o_orderdate")).alias("last")).first()
    parts = -(-years["n"] // ((years["last"] - years["first"] + 1) * FILE_ROWS))
    name = F.concat_ws("_", F.lit("orders"), F.year("o_orderdate"), F.pmod("o_orderkey", F.lit(parts)))
    return orders, name, years["last"]


def _stage_orders(paths, spark):
    return L.read_csv_text(spark, paths, guard=False).select(
        C.lenient_bigint("o_orderkey").alias("o_orderkey"),
        C.text_to_timestamp("o_orderdate").alias("o_orderdate"),
        C.lenient_double("o_totalprice").alias("o_totalprice"))


def _two_loads(spark, sf_dir, refreshed=True):
    """All years but the last are landed, the year before it with half its rows; after
    a load, that year's files are landed again, whole, and the last year's come new."""
    orders, name, last = _landed_orders(spark, sf_dir)
    base = shared_dir(spark, "ledger", fresh=True)
    landing, store, table = (f"{base}/{x}" for x in ("landing", "staging", "table"))
    year = F.year("o_orderdate")

    def run():
        return stage_new(spark, landing, store, lambda paths: _stage_orders(paths, spark), "o_orderdate")

    def refresh(load_):
        def rollup(df):
            return A.month_rollup(df, "o_orderdate", "order_month", {
                "order_count": F.count(F.lit(1)), "total_price": exact_sum("o_totalprice")})
        refresh_months(spark, read_staged(spark, store, own_columns=True), load_.months, rollup, table,
                       "order_month", STAGE_MONTH)
    def load_new():
        got = run()
        if refreshed:
            refresh(got)
        return got
    half = (year == last - 1) & (F.pmod("o_orderkey", F.lit(8)) >= 4)
    L.land_named_csv(orders.where((year < last) & ~half), landing, name)
    load_new()
    L.land_named_csv(orders.where(year >= last - 1), landing, name)
    second = load_new()
    return store, table, second, run()


def ledger_refresh(spark, sf_dir) -> DataFrame:
    """Month table after a second load that parses only its new and changed files and
    rebuilds only the months that these touch; a third load finds nothing new."""
    _, table, second, third = _two_loads(spark, sf_dir)
    if third.files:
        raise AssertionError(f"the third load parsed {third.files} files again")
    return read_table(spark, table, "order_month").select(
        "order_month", "order_count", "total_price",
        F.col("order_month").isin(list(second.months)).alias("rebuilt"))


LEDGER_RULE, LEDGER_AS_OF = Freshness("orders", "o_orderdate", 30, 90), "1998-10-01"


def ledger_freshness(spark, sf_dir) -> DataFrame:
    """Rows, first and newest day of the staged feed and its freshness, answered from the
    ledger: neither landed files nor staged rows are read."""
    store, _, _, _ = _two_loads(spark, sf_dir, refreshed=False)
    span = staged_span(spark, store)
    fresh = freshness_of([span.select(F.col("last").alias("newest"))], [LEDGER_RULE], LEDGER_AS_OF)
    return fresh.select("*", span.select("rows").scalar().alias("row_count"),
                        F.to_date(span.select("first").scalar()).alias("first_date"))


# ---------------------------------------------------------------- AGG15, BLD1
FOOTER_COLUMNS = {"orders": ["o_orderkey", "o_custkey", "o_totalprice"], "lineitem": ["l_orderkey", "l_quantity"],
                  "part": ["p_partkey", "p_size"], "events": ["event_id", "user_id"]}


def footer_ranges(spark, sf_dir) -> DataFrame:
    """Row counts and key ranges of four tables from their Parquet footers."""
    return table_ranges(spark, {n: (table_path(sf_dir, n), cols) for n, cols in FOOTER_COLUMNS.items()})


# ---------------------------------------------------------------- SRC1
def page_gap(spark, sf_dir) -> DataFrame:
    """Orders as numbered row pages: a complete download loads; one that lacks a page,
    has a short page before the last, or ends with a full page is refused."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    n = orders.count()
    size = min(50_000, max(50, n // 10))
    size += n % size == 0                       # a complete download ends with a short page
    base = shared_dir(spark, "page_gap", fresh=True)
    cols = orders.columns

    def read(folder):
        return L.read_json_pages(spark, folder, L.text_schema(cols), guard=False, page_rows=size)

    def landed(folder, keep=None, rows=orders):
        L.land_json_pages(rows, folder, size, numbered=True)
        if keep is not None:
            V.drop_folders(spark, [f"{folder}/page={p}" for p in range(n // size + 1) if not keep(p)])
        return folder
    whole = read(landed(f"{base}/whole")).agg(
        F.count(F.lit(1)).alias("order_count"), F.sum(C.lenient_bigint("o_orderkey")).alias("key_sum"))
    found = [("missing page", _refused(lambda: read(landed(f"{base}/gap", lambda p: p != 3)).count())),
             ("cut after a full page", _refused(lambda: read(landed(f"{base}/cut", lambda p: p < 4)).count()))]
    short = landed(f"{base}/short")
    orders.limit(1).select(F.to_json(F.array(F.struct(*[F.col(c).cast("string").alias(c) for c in cols])))) \
        .write.mode("overwrite").text(f"{short}/page=2")
    found.append(("short page before the last", _refused(lambda: read(short).count())))
    rows = spark.createDataFrame(found, "download string, outcome string")
    return whole.select(F.lit("complete").alias("download"), F.lit("loaded").alias("outcome"),
                        "order_count", "key_sum") \
        .unionByName(rows, allowMissingColumns=True)


# ---------------------------------------------------------------- SRC7, SRC8
def series_files(spark, sf_dir) -> DataFrame:
    """Order days and prices as nested daily series, one file a year, and monthly
    documents; all are read by file, and a folder with one document without a series (or
    data) is refused."""
    orders = load(spark, sf_dir, "orders")
    base = shared_dir(spark, "series", fresh=True)
    day = orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    points = day.groupBy(F.year("d").alias("name")).agg(F.collect_list(F.struct(
        F.date_format("d", "yyyy-MM-dd").alias("dateTime"), F.col("n").cast("string").alias("value"))).alias("p"))
    flow = points.select("name", F.to_json(F.struct(F.struct(F.array(F.struct(F.array(F.struct(
        F.col("p").alias("value"))).alias("values"))).alias("timeSeries")).alias("value"))).alias("value"))
    month = day.groupBy(F.year("d").alias("name"), F.month("d").alias("m")).agg(F.sum("n").alias("n"))
    tides = month.groupBy("name").agg(F.to_json(F.struct(F.collect_list(F.struct(
        F.col("name").cast("string").alias("year"), F.col("m").cast("string").alias("month"),
        F.col("n").cast("string").alias("MSL"))).alias("data"))).alias("value"))
    out = []
    for kind, docs, empty, read, date, value in (
            ("flow", flow, '{"value": {"timeSeries": []}}', L.read_time_series, F.col("obs_date"), "value"),
            ("tide", tides, '{"data": []}', L.read_tide_months, F.concat_ws("-", "year", "month"), "MSL")):
        L.land_named_text(docs, f"{base}/{kind}")
        L.land_named_text(docs, f"{base}/{kind}_gap")
        L.land_named_text(spark.createDataFrame([("none", empty)], "name string, value string"), f"{base}/{kind}_gap")
        refused = _refused(lambda: read(spark, f"{base}/{kind}_gap", guard=False).count())
        out.append(read(spark, f"{base}/{kind}", guard=False).select(
            F.lit(kind).alias("kind"), date.alias("period"), F.col(value).cast("bigint").alias("order_count"),
            F.lit(refused).alias("with_empty_document")))
    return out[0].unionByName(out[1])


# ---------------------------------------------------------------- SRC9
def comment_csv(spark, sf_dir) -> DataFrame:
    """Suppliers as a CSV preceded by '#' lines, renamed by position."""
    supplier = load(spark, sf_dir, "supplier")
    base = shared_dir(spark, "comment_csv", fresh=True)
    lines = supplier.groupBy(F.pmod("s_suppkey", F.lit(7)).alias("name")).agg(F.array_join(F.concat(
        F.array(F.lit("# daily report"), F.lit("#units: none"), F.lit("Key,Name,Balance (usd)")),
        F.collect_list(F.concat_ws(",", "s_suppkey", "s_name", F.col("s_acctbal").cast("string")))), "\n")
        .alias("value"))
    L.land_named_text(lines, f"{base}/csv", ".csv")
    raw = L.read_comment_csv(spark, f"{base}/csv", ["supplier_key", "supplier_name", "balance"], guard=False)
    return raw.select(C.lenient_bigint("supplier_key").alias("supplier_key"), "supplier_name",
                      C.lenient_double("balance").alias("balance"))


# ---------------------------------------------------------------- SRC10, SRC12, SRC13, SNK1, SNK3
PART_ATTRIBUTES = T.StructType([T.StructField("NAME", T.StringType()), T.StructField("SIZE", T.LongType()),
                                T.StructField("KEY", T.LongType())])


def _part_pages(spark, sf_dir, folder, page_rows):
    part = load(spark, sf_dir, "part")
    lon, lat, d = F.lit(-122.3) + F.col("p_size") / 1000.0, F.lit(47.6) + F.col("p_retailprice") / 100000.0, 0.001
    ring = F.array(F.array(lon, lat), F.array(lon + d, lat), F.array(lon + d, lat + d),
                   F.array(lon, lat + d), F.array(lon, lat))
    feature = F.struct(F.struct(F.col("p_name").alias("NAME"), F.col("p_size").cast("bigint").alias("SIZE"),
                                F.col("p_partkey").alias("KEY")).alias("attributes"),
                       F.struct(F.array(ring).alias("rings")).alias("geometry"))
    # p_partkey runs from 0 without gaps, so pages fill up in its order
    pages = part.groupBy(F.floor(F.col("p_partkey") / page_rows).alias("n")).agg(
        F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value"))
    L.land_named_text(pages.select(F.format_string("page-%05d", "n").alias("name"), "value"), folder)


def _read_parts(spark, folder, page_rows):
    df = L.read_features(spark, folder, PART_ATTRIBUTES, guard=False, page_rows=page_rows)
    lon, lat = centroid(F.col("geometry"))
    return df.select(F.col("KEY").alias("p_partkey"), F.col("NAME").alias("name"), F.col("SIZE").alias("size"),
                     fixed(lon, 6).alias("lon"), fixed(lat, 6).alias("lat"))


def feature_load(spark, sf_dir) -> DataFrame:
    """Parts as feature pages, loaded into a raw table by one job; a later load of an
    empty layer and one of a layer with a page lost are refused and leave the table."""
    base = shared_dir(spark, "feature_load", fresh=True)
    # several pages at every size; many parts come in pages as full as a layer's
    size = min(max(50, -(-load(spark, sf_dir, "part").count() // LAYER_PAGES)), L.FEATURE_PAGE)
    _part_pages(spark, sf_dir, f"{base}/layer", size)
    L.load_table(_read_parts(spark, f"{base}/layer", size), f"{base}/raw_parts")
    L.land_named_text(spark.createDataFrame([("page-00000", '{"features": []}')], "name string, value string"),
                      f"{base}/empty")
    _part_pages(spark, sf_dir, f"{base}/lost", size)
    V.drop_folders(spark, [f"{base}/lost/page-00001.json"])
    refused = [_refused(lambda: L.load_table(_read_parts(spark, f"{base}/{x}", size), f"{base}/raw_parts"))
               for x in ("empty", "lost")]
    return V.read_table(spark, f"{base}/raw_parts").withColumn("later_loads", F.lit(",".join(refused)))


def replaced_table(spark, sf_dir) -> DataFrame:
    """A raw table is loaded, then replaced: a replacement that fails midway leaves the
    first copy readable, one that ends is what readers see next.  A replacement may
    read the table itself."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    table = f"{shared_dir(spark, 'replaced', fresh=True)}/raw_orders"
    L.load_table(orders, table)
    last = orders.agg(F.max("o_orderkey")).first()[0]
    broken = orders.select("o_orderkey", F.when(F.col("o_orderkey") < last, F.col("o_orderpriority"))
                           .otherwise(F.raise_error(F.lit("lost connection"))).alias("o_orderpriority"))
    outcome = _refused(lambda: L.load_table(broken, table))
    kept = V.read_table(spark, table).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("order_count"))
    kept = kept.select(F.lit(f"after a {outcome} load").alias("state"), "o_orderpriority", "order_count").collect()
    L.load_table(V.read_table(spark, table).where(F.col("o_orderkey") % 2 == 0), table)
    now = V.read_table(spark, table).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("order_count"))
    before = spark.createDataFrame(kept, "state string, o_orderpriority string, order_count bigint")
    return before.unionByName(now.select(F.lit("after a replacement").alias("state"), "o_orderpriority", "order_count"))


# ---------------------------------------------------------------- SNK5
def named_build(spark, sf_dir) -> DataFrame:
    """Two of three raw tables are built by name; an unknown name is refused before
    anything runs."""
    base = shared_dir(spark, "named_build", fresh=True)
    builders = {n: (lambda n=n: L.load_table(load(spark, sf_dir, n), f"{base}/{n}"))
                for n in ("nation", "customer", "supplier")}
    unknown = _refused(lambda: L.build(builders, ["nation", "no_such_table"])) \
        if not V.names_in(spark, base) else "late"
    nothing_yet = not V.names_in(spark, base)
    L.build(builders, ["nation", "supplier"])
    counts = [V.read_table(spark, f"{base}/{n}").agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
              for n in V.names_in(spark, base)]
    return counts[0].unionByName(counts[1]).withColumn("unknown_name", F.lit(unknown)) \
        .withColumn("refused_first", F.lit(nothing_yet))


# ---------------------------------------------------------------- JON5, DQ5
def orphans_bucketed(spark, sf_dir) -> DataFrame:
    """Lineitem order keys without an order placed before 2000, on tables stored in
    buckets of the key: no side is shuffled and none is broadcast."""
    base = shared_dir(spark, "bucketed", fresh=True)
    name = f"tidewell_{base.rsplit('/', 1)[1]}"
    orders, lines = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    buckets = max(8, -(-lines.count() // 1_000_000))
    parent = write_bucketed(
        orders.where(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
        .select(F.col("o_orderkey").alias("l_orderkey")), f"{name}_orders", f"{base}/orders", "l_orderkey", buckets)
    child = write_bucketed(lines.select("l_orderkey", "l_linenumber"), f"{name}_lines", f"{base}/lines",
                           "l_orderkey", buckets, one_file=False)
    return bucketed_orphans(child, parent, "l_orderkey").withColumnRenamed("n", "line_count")


LANDING_QUERIES = {f.__name__: f for f in (
    ledger_refresh, ledger_freshness, footer_ranges, page_gap, series_files, comment_csv, feature_load, replaced_table, named_build,
    orphans_bucketed)}

LANDING_SQL = {
    "ledger_refresh": """
select cast(date_trunc('month', o_orderdate) as date) as order_month, count(*) as order_count,
       round(sum(cast(o_totalprice as decimal(18,2))), 2)::double as total_price,
       year(o_orderdate) >= (select max(year(o_orderdate)) - 1 from orders) as rebuilt
from orders group by all""",
    "ledger_freshness": """
select 'orders' as feed, cast(max(o_orderdate) as date) as newest_date,
       cast(date '1998-10-01' - cast(max(o_orderdate) as date) as integer) as age_days,
       case when date '1998-10-01' - cast(max(o_orderdate) as date) > 90 then 'error'
            when date '1998-10-01' - cast(max(o_orderdate) as date) > 30 then 'warn' else 'pass' end as status,
       count(*) as row_count, cast(min(o_orderdate) as date) as first_date
from orders""",
    "footer_ranges": "\nunion all\n".join(
        f"select '{t}' as table_name, '{c}' as column_name, (select count(*) from {t}) as row_count, "
        f"cast(min({c}) as varchar) as least, cast(max({c}) as varchar) as largest from {t}"
        for t, cols in FOOTER_COLUMNS.items() for c in cols),
    "page_gap": """
select 'complete' as download, 'loaded' as outcome, count(*) as order_count,
       cast(sum(o_orderkey) as bigint) as key_sum from orders
union all values ('missing page', 'refused', null, null), ('cut after a full page', 'refused', null, null),
                 ('short page before the last', 'refused', null, null)""",
    "series_files": """
select 'flow' as kind, strftime(o_orderdate, '%Y-%m-%d') as period, count(*) as order_count,
       'refused' as with_empty_document from orders group by all
union all
select 'tide', year(o_orderdate) || '-' || month(o_orderdate), count(*), 'refused' from orders group by all""",
    "comment_csv": """
select s_suppkey as supplier_key, s_name as supplier_name, s_acctbal as balance from supplier""",
    "feature_load": """
with p as (
    select *, -122.3 + cast(p_size as double) / 1000.0 as lon, 47.6 + p_retailprice / 100000.0 as lat from part
)
select p_partkey, p_name as name, cast(p_size as bigint) as size,
       round(((((0.0 + lon) + (lon + 0.001)) + (lon + 0.001)) + lon) / 4, 6) as lon,
       round(((((0.0 + lat) + lat) + (lat + 0.001)) + (lat + 0.001)) / 4, 6) as lat,
       'refused,refused' as later_loads
from p""",
    "replaced_table": """
select 'after a refused load' as state, o_orderpriority, count(*) as order_count from orders group by all
union all
select 'after a replacement', o_orderpriority, count(*) from orders where o_orderkey % 2 = 0 group by all""",
    "orphans_bucketed": """
select l_orderkey, count(*) as line_count
from lineitem left join (select * from orders where o_orderdate < timestamp '2000-01-01') on o_orderkey = l_orderkey
where o_orderkey is null and l_orderkey is not null group by l_orderkey""",
    "named_build": """
select 'nation' as table_name, count(*) as row_count, 'refused' as unknown_name, true as refused_first from nation
union all select 'supplier', count(*), 'refused', true from supplier""",
}
