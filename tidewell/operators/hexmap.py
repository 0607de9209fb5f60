"""Hexagon density maps and per-cell detail for all cells at once (HEX1, HEX2).

A map page bins points into hexagons and, for a picked cell, shows its
count, its most common categories and a few example rows.  Here the same
numbers are computed for **every** cell in one pass each: the cell id is
column arithmetic, counts are a partial aggregate, the per-cell top
categories and samples are ``row_number() <= k`` windows (with
``WindowGroupLimit`` on both sides of the shuffle, so a cell holding a third
of the points moves k rows per map task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewell.functions.geo import hex_cell, hex_center
from tidewell.functions.numeric import fixed
from tidewell.operators.windows import sample_per_group, top_categories

CELL = ["hex_q", "hex_r"]


def with_cell(df: DataFrame, lon: str, lat: str, radius_m: float = 250.0) -> DataFrame:
    """Add the hexagon cell (hex_q, hex_r) of each point; points without
    coordinates get no cell and are dropped."""
    q, r = hex_cell(lon, lat, radius_m=radius_m)
    return (df.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
              .withColumn("hex_q", q).withColumn("hex_r", r))


def hex_density(df: DataFrame, lon: str, lat: str, radius_m: float = 250.0) -> DataFrame:
    """Points per hexagon with the cell centre (6 decimals)."""
    counts = with_cell(df, lon, lat, radius_m).groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("point_count"))
    clon, clat = hex_center("hex_q", "hex_r", radius_m=radius_m)
    return counts.select(*CELL, "point_count", fixed(clon, 6).alias("center_lon"),
                         fixed(clat, 6).alias("center_lat"))


def hex_top_categories(df: DataFrame, lon: str, lat: str, category: str,
                       radius_m: float = 250.0, k: int = 8) -> DataFrame:
    """The k most common categories of every cell (ties by category)."""
    return top_categories(with_cell(df, lon, lat, radius_m), CELL, category, k,
                          count_name="category_count", rank_col="category_rank")


def hex_samples(df: DataFrame, lon: str, lat: str, key: str, radius_m: float = 250.0,
                k: int = 12, seed: str = "42") -> DataFrame:
    """k repeatable example rows of every cell (md5 of key and seed)."""
    return sample_per_group(with_cell(df, lon, lat, radius_m), CELL, key, k, seed)
