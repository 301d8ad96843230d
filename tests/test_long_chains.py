import math

import pytest

from hearthstat.operators import identity, spatial


def test_closure_has_no_last_level(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(12)], "child string, parent string")
    got = {(r["node"], r["ancestor"]): r["depth"] for r in identity.closure(edges).collect()}
    assert got == {(f"n{i}", f"n{j}"): j - i for i in range(12) for j in range(i + 1, 13)}
    assert identity.closure(edges.limit(0)).count() == 0
    with pytest.raises(ValueError):
        identity.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string"))


def test_nearest_at_any_latitude(spark):
    """Against all pairs."""

    def km(a, b):
        x, y, u, v = map(math.radians, (a[1], a[2], b[1], b[2]))
        h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    points = [(i, 10 + 0.05 * (i % 7), lat + 0.03 * (i % 5)) for lat in (-84, -60, 0, 40, 55, 70, 84, 88) for i in range(lat * 100 + 10_000, lat * 100 + 10_012)]
    anchors = [(i, lon + 0.021 * (i % 3), lat + 0.017 * (i % 4)) for i, (lon, lat) in enumerate((10 + 0.06 * k, lat) for k in range(8) for lat in (-84, -60, 0, 40, 55, 70, 84, 88))]
    got = spatial.nearest(spark.createDataFrame(points, "point_id long, lon double, lat double"), spark.createDataFrame(anchors, "anchor_id long, a_lon double, a_lat double"), 5.0)
    near = {p[0]: min(km(p, a) for a in anchors) for p in points}
    want = {k: v for k, v in near.items() if v <= 5.0}
    have = {r["point_id"]: r["km"] for r in got.collect()}
    assert have.keys() == want.keys() and all(abs(have[k] - want[k]) < 0.01 for k in want)
