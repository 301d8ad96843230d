"""Exact polygon overlaps against counted unit squares and clipped triangles."""

import random

import pytest
from pyspark.sql import functions as F

from hearthstat.operators import polygons as P

SHAPE = "array<array<struct<x:double,y:double>>>"


def frame(spark, key, shapes):
    return spark.createDataFrame([(i, [[(float(x), float(y)) for x, y in ring] for ring in rings]) for i, rings in shapes], f"{key} long, rings {SHAPE}")


def rect(a, b, c, d, back=False):
    r = [(a, b), (c, b), (c, d), (a, d)]
    return r[::-1] if back else r


def squares(rings):
    """Unit squares whose centre lies in an odd number of the upright rectangles."""
    inside = lambda r, x, y: min(p[0] for p in r) < x + 0.5 < max(p[0] for p in r) and min(p[1] for p in r) < y + 0.5 < max(p[1] for p in r)
    return {(x, y) for x in range(-2, 32) for y in range(-2, 32) if sum(inside(r, x, y) for r in rings) % 2}


def test_rectangles_with_holes_and_parts(spark):
    r = random.Random(1)
    def shape():
        x, y, w, h = r.randint(0, 15), r.randint(0, 15), r.randint(4, 12), r.randint(4, 12)
        rings = [rect(x, y, x + w, y + h, r.random() < 0.5)]
        if r.random() < 0.6:
            rings.append(rect(x + 1, y + 1, x + w - 2, y + h - 1, r.random() < 0.5))
            if w > 7 and h > 6 and r.random() < 0.7:
                rings.append(rect(x + 2, y + 2, x + w - 3, y + h - 2))  # an island in the hole
        if r.random() < 0.3:
            rings.append(rect(x + w + 1, y, x + w + 3, y + 3))
        return rings
    a, b = [(i, shape()) for i in range(25)], [(100 + i, shape()) for i in range(25)]
    got = {(x["a_id"], x["b_id"]): (x["shared"], x["ratio"], x["confidence"]) for x in P.overlaps(frame(spark, "a_id", a), frame(spark, "b_id", b), 3.0).collect()}
    want = {(i, j): (len(s & t), len(s & t) / len(s)) for i, ra in a for j, rb in b if (s := squares(ra)) & (t := squares(rb))}
    assert got.keys() == want.keys()
    for k, (n, share) in want.items():
        assert got[k][:2] == pytest.approx((n, share)) and got[k][2] == (0.95 if share >= 0.8 else 0.7)
    areas = {x["a_id"]: x["s"] for x in frame(spark, "a_id", a).select("a_id", P.area(F.col("rings")).alias("s")).collect()}
    assert areas == {i: pytest.approx(len(squares(rings))) for i, rings in a}


def clip(subject, window):
    """Area of two convex polygons' overlap, cutting one by each edge of the other."""
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    window = window if cross(*window) > 0 else window[::-1]
    out = subject
    for k in range(3):
        a, b = window[k], window[(k + 1) % 3]
        nxt = []
        for i in range(len(out)):
            p, q = out[i], out[(i + 1) % len(out)]
            dp, dq = cross(a, b, p), cross(a, b, q)
            if dp >= 0:
                nxt.append(p)
            if (dp > 0) != (dq > 0) and dp != dq:
                t = dp / (dp - dq)
                nxt.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        out = nxt
    return abs(sum(out[i][0] * out[(i + 1) % len(out)][1] - out[(i + 1) % len(out)][0] * out[i][1] for i in range(len(out)))) / 2 if out else 0.0


def test_triangles(spark):
    r = random.Random(2)
    tri = lambda: [(r.uniform(34, 36), r.uniform(31, 33)) for _ in range(3)]
    a, b = [(i, [tri()]) for i in range(20)], [(i, [tri()]) for i in range(20)]
    got = {(x["a_id"], x["b_id"]): x["shared"] for x in P.overlaps(frame(spark, "a_id", a), frame(spark, "b_id", b), 0.25).collect()}
    for i, (ta,) in a:
        for j, (tb,) in b:
            assert got.get((i, j), 0.0) == pytest.approx(clip(ta, tb), abs=1e-7)


def test_text_and_containment(spark):
    rows = [
        (1, "MULTIPOLYGON (((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2)), ((20 20, 22 20, 22 22, 20 20)))", None), (2, None, "[[[0,0],[0,5],[5,5],[5,0],[0,0]],[[1,1],[2,1],[2,2],[1,2]]]"),
        (3, "POINT (1 1)", "oops"), (4, None, None), (5, "POLYGON EMPTY", "[]"), (6, "POLYGON ((0 0, x 1, 2 2, 0 0))", "[[[0,0]]]"), (7, "POLYGON ((0 0, 1 1))", "[null]")]
    df = spark.createDataFrame(rows, "k long, wkt string, js string").select("k", F.coalesce(P.rings_of_wkt(F.col("wkt")), P.rings_of_json(F.col("js"))).alias("rings"))
    sizes = {x["k"]: x["n"] for x in df.select("k", F.when(F.col("rings").isNotNull(), F.size("rings")).alias("n")).collect()}
    assert sizes == {1: 3, 2: 2, 3: None, 4: None, 5: None, 6: None, 7: None}
    points = spark.createDataFrame([(1, 3.0, 3.0), (2, 0.5, 0.5), (3, 21.5, 20.5), (4, 1.5, 1.2), (5, 50.0, 50.0)], "point_id long, lon double, lat double")
    got = {(x["point_id"], x["k"]) for x in P.contained(points, df.filter("rings IS NOT NULL"), 4.0).select("point_id", "k").collect()}
    assert got == {(1, 2), (2, 1), (2, 2), (3, 1), (4, 1)}
    none = df.select(F.col("k").alias("a_id"), "rings")
    assert P.overlaps(none.filter("a_id > 2"), none.withColumnRenamed("a_id", "b_id"), 1.0).count() == 0
