"""Geometry as columns: feature centroids and hexagon binning (SRC11, HEX1).

Hexagon binning projects lon/lat to local metres around a fixed origin
(equirectangular, good to well under 1 % over a metro area), converts to
axial coordinates of pointy-top hexagons of the given radius and rounds in
cube space.  It is plain column arithmetic, so a density map is one partial
aggregate ``groupBy(hex_q, hex_r).count()`` over the full table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# metres per degree of latitude / of longitude at the equator (WGS84 means)
M_PER_DEG_LAT = 110540.0
M_PER_DEG_LON = 111320.0
SQRT3 = math.sqrt(3.0)


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def centroid(geom: Column) -> tuple[Column, Column]:
    """(lon, lat) of a feature geometry struct<x, y, rings>.

    A point gives (x, y).  A polygon gives the vertex mean of its outer ring,
    with the closing vertex dropped when it repeats the first; anything
    else gives (NULL, NULL).
    """
    x, y = geom.getField("x"), geom.getField("y")
    ring = F.get(geom.getField("rings"), 0)
    n = F.size(ring)
    closed = (n > 1) & (F.get(ring, 0) == F.get(ring, n - 1))
    pts = F.when(closed, F.slice(ring, 1, n - 1)).otherwise(ring)
    m = F.size(pts)

    def mean(i):
        total = F.aggregate(pts, F.lit(0.0), lambda acc, p: acc + F.get(p, i).cast("double"))
        return F.when(m > 0, total / m)

    is_point = x.isNotNull()
    lon = F.when(geom.isNull(), F.lit(None)).when(is_point, x.cast("double")).otherwise(mean(0))
    lat = F.when(geom.isNull(), F.lit(None)).when(is_point, y.cast("double")).otherwise(mean(1))
    return lon.cast("double"), lat.cast("double")


def _round_half_up(v: Column) -> Column:
    return F.floor(v + 0.5).cast("double")


def hex_cell(lon, lat, radius_m: float = 250.0,
             origin: tuple[float, float] = (-122.33, 47.61)) -> tuple[Column, Column]:
    """Axial (q, r) of the pointy-top hexagon containing each point."""
    lon0, lat0 = origin
    kx = M_PER_DEG_LON * math.cos(math.radians(lat0)) / radius_m
    ky = M_PER_DEG_LAT / radius_m
    x = (_c(lon) - lon0) * kx
    y = (_c(lat) - lat0) * ky
    fq = x * (SQRT3 / 3.0) - y * (1.0 / 3.0)
    fr = y * (2.0 / 3.0)
    fs = F.lit(0.0) - fq - fr
    rq, rr, rs = _round_half_up(fq), _round_half_up(fr), _round_half_up(fs)
    dq, dr, ds = F.abs(rq - fq), F.abs(rr - fr), F.abs(rs - fs)
    q = F.when((dq > dr) & (dq > ds), F.lit(0.0) - rr - rs).otherwise(rq)
    r = F.when(~((dq > dr) & (dq > ds)) & (dr > ds), F.lit(0.0) - rq - rs).otherwise(rr)
    return q.cast("bigint"), r.cast("bigint")


def hex_center(q, r, radius_m: float = 250.0,
               origin: tuple[float, float] = (-122.33, 47.61)) -> tuple[Column, Column]:
    """(lon, lat) of a hexagon's centre."""
    lon0, lat0 = origin
    kx = M_PER_DEG_LON * math.cos(math.radians(lat0)) / radius_m
    ky = M_PER_DEG_LAT / radius_m
    x = (_c(q).cast("double") * SQRT3 + _c(r).cast("double") * (SQRT3 / 2.0))
    y = _c(r).cast("double") * 1.5
    return (x / kx + lon0), (y / ky + lat0)
