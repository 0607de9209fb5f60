"""Landing readers: feed files in a landing folder -> typed DataFrames.

Transport (HTTP, tokens, retries) is outside the engine; a feed arrives as
files in a folder (local, HDFS or object store).  Each file is an input
split, so a feed of thousands of pages is read in parallel.  CSV feeds are
read **as text** (no inference pass over the data) and typed afterwards with
the lenient casts of ``functions.columns``; JSON feeds are read with an
explicit schema.

An empty feed is an error (SRC13).  A load counts its rows as it writes them
(``versions.write_counted``, ``load_table``), so the guard costs no job of its own;
a reader used without a load can check by itself (``guard=True``): one job that
stops on the first row.  Paged feeds are checked for completeness (SRC1, SRC10):
page numbers come from the listing, page sizes are checked where the pages are
parsed, and a page that is missing, landed twice, too long or short before the last
fails the load.  A nested document without its series fails it too (SRC7); the
message names the file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidewell.operators.versions import EmptyFeed, names_in, replace_table

Paths = str | Sequence[str]


class IncompletePages(ValueError):
    """A paged feed lacks a page or has one twice."""


def _paths(path: Paths) -> Paths:
    return path if isinstance(path, str) else list(path)


def require_rows(df: DataFrame, what: Paths) -> DataFrame:
    """Raise when ``df`` has no row (SRC13)."""
    if df.isEmpty():
        raise EmptyFeed(f"{what} returned zero rows")
    return df


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


# ------------------------------------------------------------------ CSV feeds
def read_csv_text(spark: SparkSession, path: Paths, guard: bool = True,
                  **options) -> DataFrame:
    """CSV with a header, every column as text (SRC2, SRC3, SRC4).

    ``.csv.gz`` files are read transparently (one split per file).  Extra
    reader options pass through (``comment='#'`` for SRC9).
    """
    reader = spark.read.option("header", True).option("inferSchema", False)
    for k, v in options.items():
        reader = reader.option(k, v)
    df = reader.csv(_paths(path))
    return require_rows(df, path) if guard else df


def read_comment_csv(spark: SparkSession, path: Paths, names: Sequence[str],
                     guard: bool = True) -> DataFrame:
    """CSV preceded by '#' lines; columns renamed by position (SRC9)."""
    df = read_csv_text(spark, path, guard=guard, comment="#")
    if len(df.columns) != len(names):
        raise ValueError(f"expected {len(names)} columns, found {len(df.columns)}")
    return df.toDF(*names)


def filter_and_rename(df: DataFrame, where, renames: Mapping[str, str]) -> DataFrame:
    """Keep matching rows, then keep and rename the mapped columns (SRC5)."""
    return df.filter(where).select(*[F.col(src).alias(dst) for src, dst in renames.items()])


# ----------------------------------------------------------------- JSON feeds
def read_json_text(spark: SparkSession, path: str, columns: Sequence[str],
                   guard: bool = True) -> DataFrame:
    """JSON lines with the named columns read as text."""
    df = spark.read.schema(text_schema(columns)).json(path)
    return require_rows(df, path) if guard else df


# fixed values: rows of a full page of a row feed and of a feature layer
ROW_PAGE, FEATURE_PAGE = 50_000, 2_000
PAGE_NAME = r"page[-_=]?(\d+)"


def _folder(file: Column) -> Column:
    """Folder of a page file; a ``page=N`` folder counts as part of the name."""
    return F.regexp_replace(file, r"(/page=\d+)?/[^/]*$", "")


def _page(file: Column, pattern: str) -> Column:
    """Page number in a file's path, the last one of several; NULL without any."""
    return F.try_element_at(F.regexp_extract_all(file, F.lit(pattern), F.lit(1)), F.lit(-1)).cast("bigint")


def page_sequence(files: DataFrame, pattern: str = PAGE_NAME) -> DataFrame:
    """Check the page numbers of a listing with a ``file`` column (SRC1, SRC10) and
    return folder, first, last, pages.

    Files of one folder are one download.  Its pages must be numbered without a gap
    or a repeat, from 0 or 1.  Raises naming the first folder at fault.
    """
    pages = files.select(_folder(F.col("file")).alias("folder"), _page(F.col("file"), pattern).alias("page")) \
        .groupBy("folder").agg(
            F.min("page").alias("first"), F.max("page").alias("last"), F.count(F.lit(1)).alias("pages"),
            F.count_if(F.col("page").isNull()).alias("unnumbered"), F.count_distinct("page").alias("different"))
    good = (F.col("unnumbered") == 0) & (F.col("different") == F.col("pages")) \
        & F.col("first").isin(0, 1) & (F.col("last") - F.col("first") + 1 == F.col("pages"))
    for r in pages.where(~F.coalesce(good, F.lit(False))).orderBy("folder").limit(1).collect():
        raise IncompletePages(
            f"{r['folder']}: {r['pages']} page files numbered {r['first']} to {r['last']}, "
            f"{r['different']} different, {r['unnumbered']} without a number")
    return pages.select("folder", "first", "last", "pages")


def _whole_pages(spark: SparkSession, path: Paths, page_rows: int, pattern: str,
                 parse: Callable[[Column], Column], last_may_be_full: bool) -> DataFrame:
    """One row per page file: ``file`` and its parsed ``rows``.

    The page numbers are checked on the listing of the folders that the files lie in,
    the sizes where a page is parsed, so that check costs no job.  Only the last page
    of a folder may be short, and it must be (a full last page means that paging
    stopped early), unless ``last_may_be_full``.
    """
    files = _paths(path)
    roots = files if isinstance(files, str) else \
        sorted({re.sub(r"(/page=\d+)?/[^/]*$", "", f) for f in files})
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots) \
        .select(F.col("_metadata.file_path").alias("file"))
    # one entry a download folder, of a listing that the reader below needs as a whole; no
    # join, so that rows still know the file they come from (``_metadata``)
    lasts = {r["folder"]: r["last"] for r in page_sequence(listing, pattern).collect()}
    last = F.try_element_at(F.create_map(*[F.lit(x) for item in lasts.items() for x in item]) if lasts
                            else F.lit(None).cast("map<string,bigint>"), _folder(F.col("file")))
    pages = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(files) \
        .select("value", F.col("_metadata.file_path").alias("file")) \
        .select("file", last.alias("last"), _page(F.col("file"), pattern).alias("page"), parse(F.col("value")).alias("rows"))
    n = F.size("rows")
    problem = F.when(F.col("rows").isNull(), "is no list of rows") \
        .when(n > page_rows, f"has more than {page_rows} rows") \
        .when((F.col("page") < F.col("last")) & (n < page_rows), "is short before the last page")
    if not last_may_be_full:
        problem = problem.when((F.col("page") == F.col("last")) & (n == page_rows),
                               "is the last and full: pages after it are missing")
    return pages.select("file", F.when(problem.isNull(), F.col("rows")).otherwise(F.raise_error(
        F.concat(F.lit("incomplete pages: "), "file", F.lit(" "), problem))).alias("rows"))


def read_json_pages(spark: SparkSession, path: Paths, schema, guard: bool = True,
                    page_rows: int | None = None, pattern: str = PAGE_NAME,
                    last_may_be_full: bool = False) -> DataFrame:
    """Paged JSON rows (SRC1): each page file holds one JSON array of row
    objects; all pages of a folder form one table, one split per page.  With
    ``page_rows``, the pages must be a complete download (see the module's notes)."""
    if page_rows is None:
        df = spark.read.schema(schema).option("multiLine", True).json(_paths(path))
        return require_rows(df, path) if guard else df
    row = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    pages = _whole_pages(spark, path, page_rows, pattern,
                         lambda v: F.from_json(v, T.ArrayType(row)), last_may_be_full)
    df = pages.select(F.explode("rows").alias("r")).select("r.*")
    return require_rows(df, path) if guard else df


FLOW_SCHEMA = ("value struct<timeSeries: array<struct<values: array<struct<"
               "value: array<struct<dateTime: string, value: string>>>>>>>")

TIDES_SCHEMA = ("data array<struct<year: string, month: string, MSL: string, "
                "MHHW: string, MLLW: string, GT: string, highest: string, lowest: string>>")


def _or_raise(value: Column, ok: Column, message: str, of: Column) -> Column:
    """``value``, or an error naming ``of`` where ``ok`` does not hold; part of the row."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(
        F.raise_error(F.concat(F.lit(f"{message}: "), F.coalesce(of, F.lit("?")))))


def first_points(doc: Column) -> Column:
    """The points of a series document: first series, first values block; NULL without."""
    series = F.get(doc.getField("value").getField("timeSeries"), 0)
    return F.get(series.getField("values"), 0).getField("value")


def flatten_time_series(doc: DataFrame, col: str = "doc", keep: Sequence[str] = (),
                        name: Column | None = None) -> DataFrame:
    """(dateTime, value) points of the first series' first values block of
    a parsed daily-series document (SRC7).  With ``name`` (the document's name), a
    document without a series or a values block raises; without it, it has no rows."""
    points = first_points(F.col(col))
    if name is not None:
        points = _or_raise(points, points.isNotNull(), "no series in", name)
    pts = doc.select(*keep, F.explode(points).alias("p"))
    return pts.select(*keep, F.col("p.dateTime").alias("obs_date"), F.col("p.value").alias("value"))


def read_time_series(spark: SparkSession, path: Paths, guard: bool = True) -> DataFrame:
    """Nested daily series files (SRC7); any file without a series raises, by name,
    when the rows are read."""
    doc = spark.read.schema(FLOW_SCHEMA).option("multiLine", True).json(_paths(path))
    out = flatten_time_series(doc.select(F.struct("value").alias("doc"), F.col("_metadata.file_path").alias("file")),
                              name=F.col("file"))
    return require_rows(out, path) if guard else out


def flatten_tide_months(doc: DataFrame, col: str = "doc", keep: Sequence[str] = (),
                        name: Column | None = None) -> DataFrame:
    """Monthly rows of a parsed ``data[]`` document (SRC8); with ``name``, a document
    without months raises."""
    data = F.col(f"{col}.data")
    if name is not None:
        data = _or_raise(data, F.size(data) > 0, "no data in", name)
    return doc.select(*keep, F.explode(data).alias("d")).select(*keep, "d.*")


def read_tide_months(spark: SparkSession, path: Paths, guard: bool = True) -> DataFrame:
    """JSON ``data[]`` of monthly values (SRC8); any file without months raises."""
    doc = spark.read.schema(TIDES_SCHEMA).option("multiLine", True).json(_paths(path))
    out = flatten_tide_months(doc.select(F.struct("data").alias("doc"), F.col("_metadata.file_path").alias("file")),
                              name=F.col("file"))
    return require_rows(out, path) if guard else out


def read_features(spark: SparkSession, path: Paths, attributes: T.StructType, guard: bool = True,
                  page_rows: int | None = None, pattern: str = PAGE_NAME) -> DataFrame:
    """Feature pages (SRC10): ``features[]`` of (attributes, geometry).

    Returns one row per feature with the attribute fields flattened and the
    geometry struct kept for :func:`tidewell.functions.geo.centroid`.  With
    ``page_rows``, the pages must be a complete download; a layer may end with a full
    page, as an empty answer after it is not landed.
    """
    geom = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()),
                         T.StructField("rings", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))])
    feature = T.StructType([T.StructField("attributes", attributes),
                            T.StructField("geometry", geom)])
    schema = T.StructType([T.StructField("features", T.ArrayType(feature))])
    if page_rows is None:
        doc = spark.read.schema(schema).option("multiLine", True).json(_paths(path))
    else:
        doc = _whole_pages(spark, path, page_rows, pattern,
                           lambda v: F.from_json(v, schema).getField("features"), True) \
            .withColumnRenamed("rows", "features")
    out = doc.select(F.explode("features").alias("f")).select("f.attributes.*", "f.geometry")
    return require_rows(out, path) if guard else out


# ---------------------------------------------------------------------- sinks
MOVERS = 16                  # landed files named at a time


def land_csv_text(df: DataFrame, path: str, compression: str | None = None,
                  max_rows: int = 0) -> None:
    """Write a frame as header CSV with every value as text (optionally
    gzip-compressed, as national bulk files arrive; files of at most
    ``max_rows`` rows when given)."""
    w = (df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
           .write.mode("overwrite").option("header", True))
    if compression:
        w = w.option("compression", compression)
    if max_rows:
        w = w.option("maxRecordsPerFile", max_rows)
    w.csv(path)


def land_json_text(df: DataFrame, path: str) -> None:
    """Write a frame as JSON lines with every value as text."""
    (df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
       .write.mode("overwrite").json(path))


def _name_files(spark: SparkSession, written: str, folder: str, suffix: str) -> list[str]:
    """Give the single file of each ``name=<x>`` folder its landed name ``<x><suffix>``
    in ``folder``, replacing a file of that name; returns the names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at(folder))
    # one listing a folder for all files; only the files of this landing are moved
    found = {}
    for status in fs.globStatus(at(f"{written}/name=*/part-*")) or []:
        found.setdefault(status.getPath().getParent().getName(), []).append(status.getPath())
    there = set(names_in(spark, folder, folders=False))

    def move(sub: str) -> str:
        if len(found[sub]) != 1:
            raise ValueError(f"{sub} has {len(found[sub])} files")
        name = sub.partition("=")[2] + suffix
        if name in there:
            fs.delete(at(f"{folder}/{name}"), False)
        if not fs.rename(found[sub][0], at(f"{folder}/{name}")):
            raise OSError(f"{name} could not be landed in {folder}")
        return name
    # a move is a call to the store that mostly waits
    with ThreadPoolExecutor(MOVERS) as pool:
        names = list(pool.map(move, sorted(found)))
    fs.delete(at(written), True)
    return names


def land_named_csv(df: DataFrame, folder: str, name: Column) -> list[str]:
    """Land header CSV files whose names come from the rows: the rows of one ``name``
    form one file, so a name should stand for as many rows as a file may have."""
    tmp = f"{folder.rstrip('/')}_landing"
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns], name.alias("name"))
    text.repartition("name").write.mode("overwrite").option("partitionOverwriteMode", "static") \
        .option("header", True).partitionBy("name").csv(tmp)
    return _name_files(df.sparkSession, tmp, folder, ".csv")


def land_named_text(df: DataFrame, folder: str, suffix: str = ".json") -> list[str]:
    """Land one file per row of (name, value)."""
    tmp = f"{folder.rstrip('/')}_landing"
    df.select(F.col("name").cast("string").alias("name"), F.col("value")).repartition("name") \
        .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("name").text(tmp)
    return _name_files(df.sparkSession, tmp, folder, suffix)


def land_json_pages(df: DataFrame, path: str, page_rows: int = 50000, numbered: bool = False) -> None:
    """Write a frame as JSON row pages: each page file holds one JSON array
    of at most ``page_rows`` row objects (values as text), the shape paged
    row APIs return.  Pages never span input partitions, so a page is
    built inside one task from a bounded number of rows.  ``numbered`` pages run
    from 0 without a gap and only the last is short, as in a complete download;
    ``df`` must then give the same partitions each time it is read (a scan)."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    row = F.monotonically_increasing_id()
    if numbered:
        before, n = [], 0
        for r in df.groupBy(F.spark_partition_id().alias("p")).count().orderBy("p").collect():
            before += [F.lit(r["p"]), F.lit(n)]
            n += r["count"]
        if before:
            text = text.withColumn("row", row)
            row = F.element_at(F.create_map(*before), F.shiftright("row", 33).cast("int")) \
                + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    paged = text.withColumn("page", F.floor(row / page_rows))
    pages = paged.groupBy("page").agg(
        F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))
    pages.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("page").text(path)


def load_table(df: DataFrame, table: str, partition_by: Sequence[str] = ()) -> int:
    """Load a feed into a raw table (SNK1): one job writes a new copy and counts its
    rows; an empty feed raises (SRC13) and the table stays as it was; else readers
    (``versions.read_table``) see the new copy.  Returns the rows."""
    return replace_table(df, table, partition_by, guard=True)["rows"]


def build(builders: Mapping[str, Callable[[], None]], names: Sequence[str] | None = None) -> list[str]:
    """Run the named table builders (all when ``names`` is empty); an unknown
    name raises before anything runs (SNK5)."""
    chosen = list(names) if names else list(builders)
    unknown = [n for n in chosen if n not in builders]
    if unknown:
        raise KeyError(f"unknown tables: {unknown}; known: {sorted(builders)}")
    for n in chosen:
        builders[n]()
    return chosen
