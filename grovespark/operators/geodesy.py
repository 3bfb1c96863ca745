"""Transverse Mercator coordinates as column expressions, forward and inverse, by series in the third flattening.

Terms to the fourth power leave less than a micrometre within ten degrees of the central meridian. Angles are degrees.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import find_species

# The ellipsoids GRS 80 and WGS 84, and the coefficients of the series by power of n.
AXIS, GRS80, WGS84 = 6378137.0, 1 / 298.257222101, 1 / 298.257223563
ALPHA = [(1 / 2, -2 / 3, 5 / 16, 41 / 180), (0, 13 / 48, -3 / 5, 557 / 1440), (0, 0, 61 / 240, -103 / 140), (0, 0, 0, 49561 / 161280)]
BETA = [(1 / 2, -2 / 3, 37 / 96, -1 / 360), (0, 1 / 48, 1 / 15, -437 / 1440), (0, 0, 17 / 480, -37 / 840), (0, 0, 0, 4397 / 161280)]
DELTA = [(2, -2 / 3, -2, 116 / 45), (0, 7 / 3, -8 / 5, -227 / 45), (0, 0, 56 / 15, -136 / 35), (0, 0, 0, 4279 / 630)]


def series(table: list[tuple[float, ...]], n: float) -> list[float]:
    return [sum(c * n ** (k + 1) for k, c in enumerate(row)) for row in table]


@dataclass(frozen=True)
class System:
    """A transverse Mercator system: central meridian, scale on it, false easting and northing, flattening."""

    meridian: float
    scale: float
    east: float
    north: float
    flattening: float = GRS80

    @property
    def n(self) -> float:
        return self.flattening / (2 - self.flattening)

    @property
    def radius(self) -> float:
        """Of the rectified meridian, times the scale."""
        return self.scale * AXIS / (1 + self.n) * (1 + self.n**2 / 4 + self.n**4 / 64)


#: Fixed values of the national systems, by EPSG code.
SYSTEMS = {2180: System(19, 0.9993, 500_000, -5_300_000)} | {2171 + zone: System(3 * zone, 0.999923, zone * 1_000_000 + 500_000, 0) for zone in range(5, 9)}


def system(crs: str) -> System:
    """Of `EPSG:n`: a national system, or a zone of UTM on WGS 84; others are an error."""
    code = int(crs.upper().removeprefix("EPSG:"))
    if code in SYSTEMS:
        return SYSTEMS[code]
    half, zone = divmod(code, 100)
    if half in (326, 327) and 1 <= zone <= 60:
        return System(6 * zone - 183, 0.9996, 500_000, 10_000_000 if half == 327 else 0, WGS84)
    raise ValueError(f"unknown coordinate system {crs}")


def total(columns: list[Column]) -> Column:
    return sum(columns[1:], columns[0])


def project(lat: Column, lon: Column, s: System) -> tuple[Column, Column]:
    """(east, north) in metres."""
    k = 2 * s.n**0.5 / (1 + s.n)
    sine, away = F.sin(F.radians(lat)), F.radians(lon - s.meridian)
    t = F.sinh(F.atanh(sine) - k * F.atanh(k * sine))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    a = series(ALPHA, s.n)
    east = total([eta, *(c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(a, 1))])
    north = total([xi, *(c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(a, 1))])
    return s.east + s.radius * east, s.north + s.radius * north


def unproject(east: Column, north: Column, s: System) -> tuple[Column, Column]:
    """(latitude, longitude)"""
    xi, eta = (north - s.north) / s.radius, (east - s.east) / s.radius
    b = series(BETA, s.n)
    x = total([xi, *(-c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(b, 1))])
    e = total([eta, *(-c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(b, 1))])
    chi = F.asin(F.sin(x) / F.cosh(e))
    lat = total([chi, *(c * F.sin(2 * j * chi) for j, c in enumerate(series(DELTA, s.n), 1))])
    return F.degrees(lat), s.meridian + F.degrees(F.atan2(F.sinh(e), F.cos(x)))


def with_grid(rows: DataFrame, crs: str) -> DataFrame:
    """Adds x and y of lat and lon. Nulls stay nulls."""
    x, y = project(F.col("lat"), F.col("lon"), system(crs))
    return rows.withColumns({"x": x, "y": y})


def with_degrees(rows: DataFrame, crs: str) -> DataFrame:
    """Adds lat and lon of x and y."""
    lat, lon = unproject(F.col("x"), F.col("y"), system(crs))
    return rows.withColumns({"lat": lat, "lon": lon})


def with_box(rows: DataFrame, half: float, crs: str) -> DataFrame:
    """Adds the least box of degrees (west, south, east, north) about the square of that half size around x and y.

    The square's edges are curves in degrees. A parallel's edge is farthest north or south at an end or at the central meridian, a meridian's
    farthest east or west at an end or at the equator, so these points bound the square; its corners alone don't.
    """
    s = system(crs)
    lo_x, hi_x, lo_y, hi_y = F.col("x") - half, F.col("x") + half, F.col("y") - half, F.col("y") + half
    middle, equator = F.greatest(lo_x, F.least(hi_x, F.lit(float(s.east)))), F.greatest(lo_y, F.least(hi_y, F.lit(float(s.north))))
    spots = [unproject(x, y, s) for x in (lo_x, middle, hi_x) for y in (lo_y, equator, hi_y)]
    lat, lon = [p[0] for p in spots], [p[1] for p in spots]
    return rows.withColumns({"west": F.least(*lon), "south": F.least(*lat), "east": F.greatest(*lon), "north": F.greatest(*lat)})


def find_species_at(spots: DataFrame, stands: DataFrame, size: float, crs: str) -> DataFrame:
    """find_species() for spots (spot_id, lat, lon, genus) and stands (stand_id, lat, lon, species_code) in degrees; the box about each spot is that of the system."""
    return find_species(with_grid(spots, crs).select("spot_id", "x", "y", "genus"), with_grid(stands, crs).select("stand_id", "x", "y", "species_code"), size)


def sql_of(lat: str, lon: str, crs: str) -> tuple[str, str]:
    """project() in SQL, for rows that are compared by SQL."""
    s, d = system(crs), "::DOUBLE"
    k = 2 * s.n**0.5 / (1 + s.n)
    t = f"sinh(atanh(sin({lat} * {pi / 180!r}{d})) - {k!r}{d} * atanh({k!r}{d} * sin({lat} * {pi / 180!r}{d})))"
    away = f"(({lon} - {s.meridian}) * {pi / 180!r}{d})"
    xi, eta = f"atan2({t}, cos{away})", f"atanh(sin{away} / sqrt(1 + {t} * {t}))"
    terms = list(enumerate(series(ALPHA, s.n), 1))
    east = " + ".join([eta, *(f"{c!r}{d} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, c in terms)])
    north = " + ".join([xi, *(f"{c!r}{d} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, c in terms)])
    return f"({s.east}{d} + {s.radius!r}{d} * ({east}))", f"({s.north}{d} + {s.radius!r}{d} * ({north}))"
