"""Box medians, medians of others and grouped quantiles against plain ones."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthstat.operators import benchmarks, ranks

SUBJECT = "listing_id long, neighborhood_id long, s_area double, s_rooms double, extra string"
ROW = "neighborhood_id long, area_sqm double, rooms double, value double, cell string"


@pytest.mark.parametrize("seed", [1, 2])
def test_box_medians(spark, seed):
    r = random.Random(seed)
    some = lambda x, p=0.1: None if r.random() < p else x
    subjects = [(i, some(r.choice([1, 2, 3])), some(float(r.randint(20, 220))), some(r.choice([1.0, 2.0, 2.5, 3.0, 4.0])), "x") for i in range(80)] + [(900, 9, 50.0, 2.0, "x"), (901, 1, 0.0, 2.0, "x")]
    rows = [(some(r.choice([1, 1, 2])), some(float(r.randint(15, 260)) + r.choice([0, 0.5])), some(r.choice([1.0, 2.0, 2.5, 3.0, 4.0])), some(r.choice([float(r.randint(1, 50)), r.uniform(500, 900), 0.0, 700.0])), "c") for _ in range(1500)]
    got = {x["listing_id"]: (x["matched_n"], x["matched_median"]) for x in benchmarks.box_medians(spark.createDataFrame(subjects, SUBJECT), spark.createDataFrame(rows, ROW)).collect()}
    for i, place, area, rooms, _ in subjects:
        own = [v for p, a, n, v, _ in rows if place is not None and p == place and (rooms is None or n is None or abs(n - rooms) <= 0.5) and (area is None or (a is not None and area * 0.8 <= a <= area * 1.2))]
        values = [v for v in own if v is not None and v > 0]
        assert got[i][0] == len(own), i
        assert got[i][1] == (pytest.approx(statistics.median(values)) if values else None), i


def test_box_of_one_place_and_many_rows(spark):
    """A place that holds all rows, most of them equal."""
    rows = spark.range(30_000).selectExpr("1L as neighborhood_id", "double(50 + id % 90) as area_sqm", "double(1 + id % 4) as rooms", "double(if(id % 3 = 0, 1000, 800 + id % 700)) as value")
    subjects = spark.range(20).selectExpr("id as listing_id", "1L as neighborhood_id", "double(40 + 7 * id) as s_area", "double(1 + id % 4) as s_rooms")
    got = {x["listing_id"]: tuple(x)[1:] for x in benchmarks.box_medians(subjects, rows).collect()}
    all_rows = rows.toPandas()
    for s in subjects.collect():
        b = all_rows[((all_rows.rooms - s.s_rooms).abs() <= 0.5) & all_rows.area_sqm.between(s.s_area * 0.8, s.s_area * 1.2)]
        assert got[s.listing_id] == (len(b), pytest.approx(b.value.median()) if len(b) else None)


def test_median_of_others(spark):
    r = random.Random(3)
    offers = [(i, p, None if r.random() < 0.15 else float(r.choice([5, 5, 5, r.randint(1, 40)]))) for i, p in enumerate([1] * 31 + [2] * 30 + [3] * 2 + [4] + [5] * 3)]
    got = {x["listing_id"]: (x["others"], x["others_median"]) for x in benchmarks.median_of_others(spark.createDataFrame(offers, "listing_id long, neighborhood_id long, unit double")).collect()}
    for i, p, _ in offers:
        rest = [u for j, q, u in offers if q == p and j != i]
        known = [u for u in rest if u is not None]
        assert got[i] == (len(rest), pytest.approx(statistics.median(known)) if known else None), (i, p)


def test_quantiles(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b"]), None if r.random() < 0.2 else r.uniform(-5, 50), r.randint(0, 3)) for _ in range(300)] + [("c", None, 1)]
    df = spark.createDataFrame(rows, "k string, v double, n int")
    got = {x["k"]: x for x in ranks.quantiles(df, ["k"], {"mid": (F.col("v"), 0.5), "high": (F.col("v"), 0.9), "n_mid": (F.col("n"), 0.5)}, {"rows": F.lit(True), "ones": F.col("n") == 1}).collect()}
    for k in "abc":
        v, n = [x for g, x, _ in rows if g == k and x is not None], [x for g, _, x in rows if g == k]
        assert (got[k]["rows"], got[k]["ones"], got[k]["n_mid"]) == (len(n), n.count(1), statistics.median(n))
        for name, q in (("mid", 0.5), ("high", 0.9)):
            assert got[k][name] == (pytest.approx(float(np.quantile(v, q))) if v else None)
