"""Work that grows with distinct values, not with pairs of rows; results stay those of all pairs."""

import datetime as dt
import random

from pyspark.sql import functions as F

from hearthstat.operators import appraisal, comparables, identity, naming, places, polygons, spatial

SHAPE = "array<array<struct<x:double,y:double>>>"


def counted(spark, f, kind):
    """A function of columns that counts the rows that it is asked for."""
    n = spark.sparkContext.accumulator(0)

    @F.udf(kind)
    def seen(x):
        n.add(1)
        return x

    return n, lambda *a: seen(f(*a))


def test_points_meet_equal_shapes_once(spark, monkeypatch):
    n, inside = counted(spark, polygons.in_rings, "boolean")
    monkeypatch.setattr(polygons, "in_rings", inside)
    hole = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]]
    plots = spark.createDataFrame([(i, hole if i else None) for i in range(41)], f"plot_id long, rings {SHAPE}")
    points = spark.createDataFrame([(i, 0.5 + i % 2, 0.5 + i % 2) for i in range(60)] + [(60, None, 1.0), (61, 9.0, 9.0)], "point_id long, lon double, lat double")
    got = polygons.contained(points, plots, 3.0)
    assert got.columns == ["point_id", "lon", "lat", "plot_id", "rings"]
    assert sorted((r["point_id"], r["plot_id"]) for r in got.collect()) == [(i, j) for i in range(0, 60, 2) for j in range(1, 41)]
    assert n.value <= 8, n.value


def test_equal_shapes_overlap_once(spark, monkeypatch):
    seen, plain = [], polygons._overlaps
    monkeypatch.setattr(polygons, "_overlaps", lambda a, b, *more: seen.append((a.count(), b.count())) or plain(a, b, *more))
    square = lambda x: [[(x, 0.0), (x + 2.0, 0.0), (x + 2.0, 2.0), (x, 2.0)]]
    a = spark.createDataFrame([(i, square(float(i % 2))) for i in range(6)], f"a_id long, rings {SHAPE}")
    b = spark.createDataFrame([(10, square(1.0)), (11, square(1.0))], f"b_id long, rings {SHAPE}")
    got = {(r["a_id"], r["b_id"], round(r["shared"], 9), round(r["ratio"], 9)) for r in polygons.overlaps(a, b, 0.7).collect()}
    assert got == {(i, j, 2.0 * (1 + i % 2), 0.5 * (1 + i % 2)) for i in range(6) for j in (10, 11)}
    assert seen == [(2, 1)]


def test_points_and_anchors_of_one_place_meet_once(spark, monkeypatch):
    n, km = counted(spark, spatial.haversine_km, "double")
    monkeypatch.setattr(spatial, "haversine_km", km)
    points = spark.createDataFrame([(i, 34.0 + i % 2, 31.0) for i in range(50)], "point_id long, lon double, lat double")
    anchors = spark.createDataFrame([(i, 34.0, 31.0 + i % 2 * 0.001) for i in range(100, 150)], "anchor_id long, a_lon double, a_lat double")
    assert {(r["point_id"], r["anchor_id"]) for r in spatial.nearest(points, anchors, 5.0).collect()} == {(i, 100) for i in range(0, 50, 2)}
    assert n.value <= 16, n.value


def test_equal_streets_and_rules_meet_once(spark, monkeypatch):
    n, contains = counted(spark, F.contains, "boolean")
    monkeypatch.setattr(F, "contains", contains)
    addresses = spark.createDataFrame([(i, i % 2, ["High Street 4", "old High street, 9", "street", None][i % 4]) for i in range(400)], "listing_id long, city_id int, address string")
    rules = spark.createDataFrame([(0, "high street", i, 0.1 * (i % 10)) for i in range(200)] + [(1, "the street of old high street", 7, None), (1, "high road", 8, 1.0)], "city_id int, street string, neighborhood_id long, confidence double")
    out = naming.resolve_streets(addresses, rules, "listing_id")
    got = {(r["listing_id"] % 4, r["place_id"], r["method"], round(r["confidence"] or -1, 6)) for r in out.collect()}
    assert n.value <= 16, n.value
    assert out.count() == 400
    assert got == {(0, 9, "street", 0.9), (1, 7, "part_of_street", -1), (2, 9, "part_of_street", 0.9), (3, None, None, -1)}


def test_newest_sales_near_an_area(spark):
    """All pairs give the same; a range of areas meets short lists."""
    r = random.Random(5)
    start = dt.date(2000, 1, 1)
    sales = [(r.choice([1, 2, None]), i, start + dt.timedelta(r.randrange(300)) if i % 50 else None, r.choice([50.0, 80.0, 100.0, 120.0, r.uniform(30, 150), 0.0]), 1.0) for i in range(4000)]
    subjects = [(i, r.choice([1, 2, 3]), r.choice([100.0, r.uniform(30, 150), None]), None, None, None) for i in range(120)]
    s = spark.createDataFrame(subjects, "listing_id long, neighborhood_id long, area_sqm double, rooms int, floor int, address string")
    c = spark.createDataFrame(sales, "neighborhood_id long, transaction_id long, deal_date date, area_sqm double, amount double")
    want = set()
    for i, place, area, *_ in subjects:
        near = [x for x in sales if x[0] == place and area and x[3] > 0 and area * (1 - 0.2) <= x[3] <= area * (1 + 0.2)]
        near.sort(key=lambda x: (x[2] is None, -(x[2] or start).toordinal(), x[1]))
        want |= {(i, x[1], n) for n, x in enumerate(near[:20], 1)}
    assert {(x["listing_id"], x["transaction_id"], x["rank"]) for x in appraisal.basic_comparables(s, c).collect()} == want


def test_rows_without_need_of_a_crosswalk_are_dealt_out(spark):
    tx = spark.createDataFrame([(i, 5 if i % 10 else None, i % 7 if i % 3 else None) for i in range(2000)], "transaction_id long, neighborhood_id long, parcel_id long")
    p = spark.createDataFrame([(i, 9, 0.5) for i in range(7)], "parcel_id long, neighborhood_id long, confidence double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = identity.resolve(tx, p)
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 2000 and max(sizes) < 1000, sizes
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {(r["method"], r["place_id"], r["n"]) for r in out.groupBy("method", "place_id").agg(F.count("*").alias("n")).collect()} == {("direct", 5, 1800), ("parcel", 9, 133), ("unresolved", None, 67)}


def test_a_mean_on_the_limit_does_not_hang_on_the_order_of_rows(spark):
    e = spark.range(0, 1000, 1, 1).selectExpr("'p' AS dataset", "id AS place_id", "0.9D AS confidence")
    got = places.source_quality(e).first()
    assert (got["quality"], got["mean_confidence"], got["linked"]) == ("strong", 0.9, 1000)


def test_subjects_of_equal_features_are_valued_once(spark, monkeypatch):
    seen, plain = [], comparables.most_alike
    monkeypatch.setattr(comparables, "most_alike", lambda s, *more: seen.append(s.count()) or plain(s, *more))
    subjects = spark.createDataFrame([(i, 1, ["A 1", None][i % 2], 80.0, None, 2, 34.0, 32.0, 1.0 * i) for i in range(30)], "listing_id long, neighborhood_id long, s_address string, s_area double, s_rooms int, s_floor int, s_lon double, s_lat double, asking_price double")
    sales = spark.createDataFrame([(i, 1, dt.date(2001, 1, 1 + i), 100.0, 80.0 + i, 3, 2, f"A {i}", 1.0, 34.0, 32.0) for i in range(5)], "transaction_id long, neighborhood_id long, deal_date date, amount double, area_sqm double, rooms int, floor int, address string, pp_sqm double, lon double, lat double")
    rows = comparables.valuation_rows(subjects, sales, dt.date(2001, 8, 2)).collect()
    of = {}
    for r in rows:
        of.setdefault(r["listing_id"], set()).add((r["transaction_id"], r["rank"], r["relation"], r["similarity"]))
    assert set(of) == set(range(30)) and all(len(x) == 5 for x in of.values())
    assert all(of[i] == of[i % 2] for i in range(30)) and of[0] != of[1] and seen == [2]
