"""Centroids and hexagon binning."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions.geo import SQRT3, centroid, hex_cell, hex_center

GEOM = "g struct<x: double, y: double, rings: array<array<array<double>>>>"


def test_centroid_cases(spark):
    square = [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]]
    rows = [((-122.33, 47.6, None),), ((None, None, square),), (None,), ((None, None, []),),
            ((None, None, [[]]),)]
    df = spark.createDataFrame(rows, GEOM)
    lon, lat = centroid(F.col("g"))
    out = [tuple(r) for r in df.select(lon, lat).collect()]
    assert out[0] == (-122.33, 47.6)
    assert out[1] == (0.5, 0.5)
    assert out[2:] == [(None, None)] * 3


def _hex_ref(lon, lat, radius=250.0, origin=(-122.33, 47.61)):
    lon0, lat0 = origin
    x = (lon - lon0) * 111320.0 * math.cos(math.radians(lat0)) / radius
    y = (lat - lat0) * 110540.0 / radius
    q, r = x * SQRT3 / 3 - y / 3, y * 2 / 3
    s = -q - r
    rq, rr, rs = (math.floor(v + 0.5) for v in (q, r, s))
    dq, dr, ds = abs(rq - q), abs(rr - r), abs(rs - s)
    if dq > dr and dq > ds:
        rq = -rr - rs
    elif dr > ds:
        rr = -rq - rs
    return rq, rr


def test_hex_cell_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    pts = [(float(a), float(b)) for a, b in zip(rng.uniform(-122.5, -122.1, 500),
                                                rng.uniform(47.4, 47.8, 500))]
    df = spark.createDataFrame(pts, "lon double, lat double")
    q, r = hex_cell("lon", "lat")
    got = [tuple(x) for x in df.select(q, r).collect()]
    assert got == [_hex_ref(a, b) for a, b in pts]


def test_hex_center_falls_in_its_cell(spark):
    df = spark.createDataFrame([(3, -2), (0, 0), (-5, 7)], "q long, r long")
    lon, lat = hex_center("q", "r")
    back = df.select(lon.alias("lon"), lat.alias("lat"))
    q, r = hex_cell("lon", "lat")
    assert [tuple(x) for x in back.select(q, r).collect()] == [(3, -2), (0, 0), (-5, 7)]
