"""Points, rings and distances as column expressions; a grid cell turns spatial joins into equi-joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthstat.functions.clean import haversine_km


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether an even-odd ray crosses a ring (an open list of x, y) an odd number of times."""
    following = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    crosses = F.zip_with(ring, following, lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]))
    return F.size(F.filter(crosses, lambda c: c)) % 2 == 1


def contained(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Pairs of points and polygons around them; polygons carry ``ring`` and are spread over the cells of their box."""
    at = lambda c: F.floor(c / cell)
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    spread = lambda v: F.sequence(at(F.array_min(v)), at(F.array_max(v)))
    cells = polygons.withColumn("cx", F.explode(spread(xs))).withColumn("cy", F.explode(spread(ys)))
    return points.withColumn("cx", at(F.col("lon"))).withColumn("cy", at(F.col("lat"))).join(cells, ["cx", "cy"]).filter(in_ring(F.col("lon"), F.col("lat"), F.col("ring"))).drop("cx", "cy")


def nearest(points: DataFrame, anchors: DataFrame, km: float) -> DataFrame:
    """The nearest anchor within ``km`` of each point; anchors are spread over the cells that the radius can reach.

    Rows of cells are as high as the radius; in each row cells are as wide as the radius at its latitude furthest from the
    equator, neighbours included, so all latitudes are covered (beyond 85 degrees a row is one cell).  An anchor near the
    180th meridian also stands a turn further, beyond the other end.  Anchors at one place come down to the least id, and
    points at one place are looked up once.
    """
    anchors = anchors.groupBy("a_lon", "a_lat").agg(F.min("anchor_id").alias("anchor_id"))
    high = km / 111.0 * 1.01
    row = lambda lat: F.floor(lat / high)

    def width(r):
        far = F.greatest(F.abs(r - 1), F.abs(r + 2)) * high
        return F.when(far > 85, 360.0).otherwise(F.lit(high * 1.1) / F.cos(F.radians(far)))

    column = lambda lon, r: F.floor(lon / width(r))

    a = anchors.withColumn("cy", F.explode(F.sequence(row(F.col("a_lat")) - 1, row(F.col("a_lat")) + 1)))
    turns = F.filter(F.array(F.col("a_lon"), F.col("a_lon") - 360, F.col("a_lon") + 360), lambda x: F.abs(x) <= 180 + 2 * width(F.col("cy")))
    a = a.withColumn("at", F.explode(turns)).withColumn("cx", F.explode(F.sequence(column(F.col("at"), F.col("cy")) - 1, column(F.col("at"), F.col("cy")) + 1))).drop("at")
    p = points.select("lon", "lat").distinct().withColumn("cy", row(F.col("lat"))).withColumn("cx", column(F.col("lon"), F.col("cy")))
    d = p.join(a, ["cx", "cy"]).withColumn("km", haversine_km(F.col("lon"), F.col("lat"), F.col("a_lon"), F.col("a_lat")))
    best = d.filter(F.col("km") <= km).groupBy("lon", "lat").agg(F.min(F.struct(F.round("km", 6).alias("km"), "anchor_id")).alias("m"))
    return points.join(best, ["lon", "lat"]).select("point_id", "m.anchor_id", "m.km")


def cells(polygons: DataFrame, size: float) -> DataFrame:
    """Grid cells (cx, cy) whose centre lies in ``ring``; polygons become sets of cells."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    spread = lambda v: F.explode(F.sequence(F.floor(F.array_min(v) / size), F.floor(F.array_max(v) / size)))
    grid = polygons.withColumn("cx", spread(xs)).withColumn("cy", spread(ys))
    return grid.filter(in_ring((F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size, F.col("ring"))).drop("ring")


def overlap_ratio(a: DataFrame, b: DataFrame, a_id: str, b_id: str, least: float = 0.2) -> DataFrame:
    """Share of each ``a``'s cells that a ``b`` covers, to the grid's precision; .95 from four fifths on, else .7."""
    size = a.groupBy(a_id).agg(F.count("*").alias("cells"))
    shared = a.join(b, ["cx", "cy"]).groupBy(a_id, b_id).agg(F.count("*").alias("shared"))
    ratio = shared.join(size, a_id).select(a_id, b_id, F.round(F.col("shared") / F.col("cells"), 6).alias("overlap_ratio"))
    return ratio.filter(F.col("overlap_ratio") >= least).withColumn("confidence", F.when(F.col("overlap_ratio") >= 0.8, 0.95).otherwise(0.7))


def dissolve(members: DataFrame, key: str, safe: float = 0.8) -> DataFrame:
    """The union of members' cells (key, member, safe, cx, cy), of keys with enough members safe for polygons."""
    of = members.select(key, "member", "safe").distinct().groupBy(key).agg(F.avg(F.col("safe").cast("double")).alias("share")).filter(F.col("share") >= safe)
    return members.join(of, key, "left_semi").select(key, "cx", "cy").distinct()


def tile_features(points: DataFrame, z: int, x: int, y: int) -> DataFrame:
    """Points in a web-mercator tile."""
    west, east, north, south = tile_box(z, x, y)
    return points.filter((F.col("lon") >= west) & (F.col("lon") < east) & (F.col("lat") > south) & (F.col("lat") <= north))


def tile_box(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    lat = lambda row: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * row / 2**z))))
    return x / 2**z * 360 - 180, (x + 1) / 2**z * 360 - 180, lat(y), lat(y + 1)


def simplify(ring: Column, digits: int = 4) -> Column:
    """Vertices rounded, consecutive equal ones once."""
    near = F.transform(ring, lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y")))
    return F.filter(near, lambda p, i: (i == 0) | ~p.eqNullSafe(F.get(near, i - 1)))
