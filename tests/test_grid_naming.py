"""Grid coordinates against arcs of the ellipsoid, ring measures, and names and streets on literal rows."""

import math

import numpy as np
from pyspark.sql import functions as F

from hearthstat.functions import grid
from hearthstat.operators import naming, quality

M = lambda p: grid.A * (1 - grid.E2) / (1 - grid.E2 * np.sin(p) ** 2) ** 1.5  # noqa: E731  radius along the meridian
NU = lambda p: grid.A / np.sqrt(1 - grid.E2 * np.sin(p) ** 2)


def lonlat(spark, points):
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "i int, x double, y double")
    lon, lat = grid.on_datum(F.col("x"), F.col("y"))
    return [tuple(r) for r in df.orderBy("i").select(lon, lat).collect()]


def test_meridian(spark):
    """North of the origin, latitude is where the meridian's arc, scaled, has the length of the step."""
    steps = [0, 100_000, -150_000, 250_000]
    for d, (lon, lat) in zip(steps, lonlat(spark, [(grid.EAST0, grid.NORTH0 + d) for d in steps]), strict=True):
        p = np.linspace(math.radians(grid.LAT0), math.radians(lat), 20_001)
        assert abs(lon - grid.LON0) < 1e-12 and abs(np.trapezoid(M(p), p) * grid.SCALE - d) < 1e-3


def test_conformal(spark):
    """Ten metres east or north are as long on the ellipsoid, by the scale at that distance from the meridian."""
    for e in (-60_000, 0, 40_000):
        x, y = grid.EAST0 + e, grid.NORTH0 + 80_000
        (a, b), (a1, b1), (a2, b2) = lonlat(spark, [(x, y), (x + 10, y), (x, y + 10)])
        p = math.radians(b)
        k = grid.SCALE * (1 + e**2 / (2 * M(p) * NU(p) * grid.SCALE**2))
        for u, v in ((a1, b1), (a2, b2)):
            length = math.hypot(math.radians(v - b) * M(p), math.radians(u - a) * NU(p) * math.cos(p))
            assert abs(length * k - 10) < 1e-4


def test_shift_and_range(spark):
    df = spark.createDataFrame([(34.8, 32.0), (grid.EAST0, grid.NORTH0), (None, 1.0)], "x double, y double")
    got = [r[0] for r in df.select(grid.as_degrees(F.col("x"), F.col("y"))).collect()]
    p = math.radians(grid.LAT0)
    east, north = math.radians(got[1]["lon"] - grid.LON0) * NU(p) * math.cos(p), math.radians(got[1]["lat"] - grid.LAT0) * M(p)
    assert tuple(got[0]) == (34.8, 32.0) and 60 < east < 85 and 35 < north < 60 and got[2]["lon"] is None


def test_rings(spark):
    rows = [([(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)],), ([(0.0, 0.0), (1.0, 1.0)],), ([],), (None,), ([(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)],)]
    df = spark.createDataFrame(rows, "ring array<struct<x:double,y:double>>")
    got = df.select(grid.is_valid_ring(F.col("ring")), grid.ring_centroid(F.col("ring"))).collect()
    assert [r[0] for r in got] == [True, False, False, False, False] and tuple(got[0][1]) == (1.0, 0.5) and got[2][1] is None


def test_names(spark):
    hoods = spark.createDataFrame([(1, 10, "North-Side"), (2, 20, "Northside")], "city_id int, neighborhood_id int, name string")
    aliases = naming.build_aliases(hoods, spark.createDataFrame([(10, "Upper", 0.7), (10, "  ", 0.9)], "neighborhood_id int, source_name string, confidence double"))
    rows = [(1, 1, "NORTH SIDE", None), (2, 2, "north side", None), (3, 1, "upper", None), (4, 1, None, None), (5, 1, "upper", 7)]
    got = naming.resolve_names(spark.createDataFrame(rows, "id int, city_id int, place_name string, neighborhood_id int"), aliases, "id").collect()
    assert sorted(tuple(r) for r in got) == [(1, 10, "name"), (2, 20, "name"), (3, 10, "alias"), (4, None, "unresolved"), (5, 7, "earlier")]


def test_streets(spark):
    rules = spark.createDataFrame([(1, "Elm", 10, 0.9), (1, "Old Elm Road", 20, 0.5), (1, "", 30, 1.0)], "city_id int, street string, neighborhood_id int, confidence double")
    rows = [(1, 1, "elm 4"), (2, 1, "the old elm road 3"), (3, 1, "elmwood 2"), (4, 2, "elm"), (5, 1, None), (6, 1, "road")]
    got = naming.resolve_streets(spark.createDataFrame(rows, "id int, city_id int, address string"), rules, "id").collect()
    assert sorted((r["id"], r["place_id"], r["method"]) for r in got) == [(1, 10, "street"), (2, 10, "part_of_street"), (3, None, None), (4, None, None), (5, None, None), (6, 20, "part_of_street")]


def test_evaluation_log(spark):
    import datetime as dt

    case = lambda passed: spark.createDataFrame([("a", 4, 0 if passed else 2, passed)], '"case" string, rows long, violations long, passed boolean'.replace('"case"', "`case`"))
    log = quality.append_evaluation(quality.append_evaluation(None, case(True), 1, dt.datetime(2024, 1, 1)), case(True), 2, dt.datetime(2024, 1, 2))
    log = quality.append_evaluation(log, case(False), 2, dt.datetime(2024, 1, 2))  # a run again replaces itself
    assert [tuple(r) for r in quality.latest_evaluation(log).collect()] == [("a", False, 2, 2, 2, 1)]
