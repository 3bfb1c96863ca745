"""Projection against the meridian arc of a complex latitude, which has no series."""

import cmath
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovespark.operators import geodesy

NODES, WEIGHTS = np.polynomial.legendre.leggauss(60)


def plain(lat, lon, s):
    """The meridian arc up to the complex latitude whose isometric latitude is psi + i * (lon - meridian)."""
    e2 = s.flattening * (2 - s.flattening)
    e = math.sqrt(e2)
    iso = lambda p: cmath.atanh(cmath.sin(p)) - e * cmath.atanh(e * cmath.sin(p))
    want = iso(math.radians(lat)) + 1j * math.radians(lon - s.meridian)
    p = complex(math.radians(lat), math.radians(lon - s.meridian) * math.cos(math.radians(lat)))
    for _ in range(50):
        p -= (iso(p) - want) * (cmath.cos(p) * (1 - e2 * cmath.sin(p) ** 2) / (1 - e2))
    t = p * (NODES + 1) / 2
    arc = geodesy.AXIS * (1 - e2) * np.sum(WEIGHTS / (1 - e2 * np.sin(t) ** 2) ** 1.5) * p / 2
    return s.east + s.scale * arc.imag, s.north + s.scale * arc.real


@pytest.mark.parametrize("crs", ["EPSG:2180", "EPSG:2178", "EPSG:32634", "EPSG:32719"])
def test_projection_to_a_tenth_of_a_millimetre(spark, crs):
    s, pick = geodesy.system(crs), random.Random(1)
    places = [(pick.uniform(-80, 84), s.meridian + pick.uniform(-6, 6)) for _ in range(60)] + [(0.0, float(s.meridian)), (52.0, float(s.meridian)), (-45.0, s.meridian - 3.0)]
    df = spark.createDataFrame(places + [(None, 3.0)], "lat double, lon double")
    rows = geodesy.with_grid(df, crs).collect()
    for r in rows[:-1]:
        x, y = plain(r["lat"], r["lon"], s)
        assert abs(r["x"] - x) < 1e-4 and abs(r["y"] - y) < 1e-4
    assert rows[-1]["x"] is None
    back = geodesy.with_degrees(geodesy.with_grid(df, crs).select(F.col("lat").alias("a"), F.col("lon").alias("b"), "x", "y"), crs).where("x is not null").collect()
    assert max(abs(r["lat"] - r["a"]) + abs(r["lon"] - r["b"]) for r in back) < 1e-10


def test_boxes_hold_their_edges(spark):
    rows = [(500_000.0, 480_000.0), (350_000.0, 700_000.0), (820_000.0, 200_000.0)]
    half = 60_000.0
    for r in geodesy.with_box(spark.createDataFrame(rows, "x double, y double"), half, "EPSG:2180").collect():
        edge = np.linspace(-half, half, 201)
        spots = [(float(r["x"] + a), float(r["y"] + b)) for t in edge for a, b in ((t, half), (t, -half), (half, t), (-half, t))]
        got = geodesy.with_degrees(spark.createDataFrame(spots, "x double, y double"), "EPSG:2180").agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
        assert np.abs(np.array(got) - (r["south"], r["north"], r["west"], r["east"])).max() < 2e-6
        assert got[0] >= r["south"] - 1e-12 and got[1] <= r["north"] + 1e-12 and got[2] >= r["west"] - 1e-12 and got[3] <= r["east"] + 1e-12


def test_unknown_systems():
    for crs in ("EPSG:4326", "EPSG:32661"):
        with pytest.raises(ValueError, match="unknown"):
            geodesy.system(crs)
