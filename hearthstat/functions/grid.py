"""Coordinates of the transverse Mercator grid as degrees, and measures of rings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the grid (GRS80 ellipsoid; EPSG 2039): semi-axis, flattening, scale, origin in degrees, false easting and
# northing; and of its datum's shift to WGS84 in metres.
A, FLAT, SCALE = 6378137.0, 1 / 298.257222101, 1.0000067
LON0, LAT0 = 35.20451694444444, 31.734393611111113
EAST0, NORTH0 = 219529.584, 626907.39
SHIFT = (-48.0, 55.0, 52.0)

N = FLAT / (2 - FLAT)
R = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
TO_LAT = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
TO_GRID = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
E2 = FLAT * (2 - FLAT)


def _xi0() -> float:
    """The rectified latitude of the origin."""
    p, e = math.radians(LAT0), math.sqrt(E2)
    t = math.sinh(math.atanh(math.sin(p)) - e * math.atanh(e * math.sin(p)))
    x = math.atan(t)
    return x + sum(a * math.sin(2 * j * x) for j, a in enumerate(TO_GRID, 1))


def on_datum(x: Column, y: Column) -> tuple[Column, Column]:
    """(lon, lat) on the grid's own datum, by Krueger's series to the third order."""
    xi, eta = _xi0() + (y - NORTH0) / (SCALE * R), (x - EAST0) / (SCALE * R)
    xi1 = xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(TO_LAT, 1)), F.lit(0.0))
    eta1 = eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(TO_LAT, 1)), F.lit(0.0))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    d = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)
    lat = chi + sum((c * F.sin(2 * j * chi) for j, c in enumerate(d, 1)), F.lit(0.0))
    return LON0 + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(lat)


def to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """(lon, lat) on WGS84: the datum's shift along east and north over the radii of curvature there."""
    lon, lat = on_datum(x, y)
    sl, cl, sp, cp = F.sin(F.radians(lon)), F.cos(F.radians(lon)), F.sin(F.radians(lat)), F.cos(F.radians(lat))
    east = SHIFT[1] * cl - SHIFT[0] * sl
    north = SHIFT[2] * cp - (SHIFT[0] * cl + SHIFT[1] * sl) * sp
    w = 1 - E2 * sp * sp
    return lon + F.degrees(east * F.sqrt(w) / (A * cp)), lat + F.degrees(north * F.pow(w, F.lit(1.5)) / (A * (1 - E2)))


def as_degrees(x: Column, y: Column) -> Column:
    """A point in degrees: as it is where it can be degrees, else taken as grid coordinates."""
    lon, lat = to_degrees(x, y)
    plain = x.between(-180, 180) & y.between(-90, 90)
    return F.struct(F.when(plain, x).otherwise(lon).alias("lon"), F.when(plain, y).otherwise(lat).alias("lat"))


def _crosses(ring: Column) -> Column:
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda a, b: F.struct((a["x"] * b["y"] - b["x"] * a["y"]).alias("c"), (a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def ring_area(ring: Column) -> Column:
    return F.abs(_sum(F.transform(_crosses(ring), lambda v: v["c"]))) / 2


def ring_centroid(ring: Column) -> Column:
    """The centre of mass of an open ring; NULL where it has no area."""
    twice = _sum(F.transform(_crosses(ring), lambda v: v["c"]))
    at = lambda k: _sum(F.transform(_crosses(ring), lambda v: v["c"] * v[k])) / (3 * twice)
    return F.when(is_valid_ring(ring), F.struct(at("x").alias("x"), at("y").alias("y")))


def is_valid_ring(ring: Column) -> Column:
    """At least three distinct vertices, none without a number, around some area."""
    whole = ~F.exists(ring, lambda p: p["x"].isNull() | p["y"].isNull())
    return F.coalesce((F.size(F.array_distinct(ring)) >= 3) & whole & (ring_area(ring) > 0), F.lit(False))
