"""Deals, census profiles, evaluation cases and small column functions on stated cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hearthstat.functions import clean
from hearthstat.operators import census, evaluation, quality, scenarios, scoring, spatial

DEAL = {"purchase_price": 1_500_000.0, "legal_fees": 15_000.0, "renovation": 80_000.0, "loan_amount": 750_000.0, "interest_rate_pct": 4.5, "loan_term_years": 25.0, "monthly_rent": 5_500.0, "vacancy_pct": 5.0,
        "annual_maintenance": 6_000.0, "annual_other_operating": 2_000.0, "exit_years": 5.0, "appreciation_pct": 2.5, "sale_costs_pct": 1.5}


def deal(spark, **changes):
    d = DEAL | changes
    return scenarios.deal_outputs(spark.createDataFrame([tuple(d.values())], ", ".join(f"{k} double" for k in d))).first()


def test_deals(spark):
    one = deal(spark)
    pay = 750_000 * 0.00375 / (1 - 1.00375**-300)
    owed = 750_000 * 1.00375**60 - pay * (1.00375**60 - 1) / 0.00375
    assert (one["total_cost"], one["equity"], one["monthly_debt"], one["effective_rent"], one["operating_costs"]) == (1_595_000, 845_000, round(pay), 62_700, 8_000)
    assert one["owed_at_exit"] == pytest.approx(owed, abs=1) and one["exit_value"] == round(1_500_000 * 1.025**5) and one["gross_yield_pct"] == 4.4
    assert one["break_even_rent"] == pytest.approx((12 * pay + 8_000) / (12 * 0.95), abs=1)
    flows = [-845_000] + [54_700 - 12 * pay] * 4 + [54_700 - 12 * pay + 1_500_000 * 1.025**5 * 0.985 - owed]
    assert sum(f / (1 + one["irr_pct"] / 100) ** i for i, f in enumerate(flows)) == pytest.approx(0, abs=500)
    none = deal(spark, loan_amount=0.0)
    assert (none["monthly_debt"], none["annual_debt"], none["owed_at_exit"]) == (0, 0, 0)
    assert deal(spark, exit_price=2_000_000.0, appreciation_pct=99.0)["exit_value"] == 2_000_000
    assert deal(spark, loan_amount=9e9)["equity"] == 0 and deal(spark, loan_amount=9e9)["cash_on_cash_pct"] is None and deal(spark, purchase_price=0.0)["gross_yield_pct"] is None
    assert deal(spark, loan_term_years=3.0)["owed_at_exit"] == 0


def test_census(spark):
    flags = "exclusive boolean, safe_for_identity boolean, safe_for_polygon boolean, extra int"
    areas = spark.createDataFrame([
        (1, 1, 1.0, "official_crosswalk", 0.9, None, None, None, 0), (1, 2, None, "configured_crosswalk", 0.9, None, None, None, 0), (2, 3, 0.5, "polygon_overlap", 0.7, None, True, None, 0),
        (2, 4, None, "parcel_evidence", 0.86, None, True, None, 0), (3, 5, None, "official_crosswalk", 0.84, None, None, None, 0), (4, 6, 0.8, "polygon_overlap", 0.5, None, None, None, 0), (None, 6, 1.0, "x", 1.0, True, None, None, 0),
        (5, 9, 1.0, "x", 1.0, None, None, None, 0)], f"neighborhood_id long, area_id long, overlap_ratio double, mapping_method string, mapping_confidence double, {flags}")
    c = spark.createDataFrame([(1, 100, 50.0), (2, 900, 10.0), (3, 100, 1.0), (4, 200, None), (5, 10, 1.0), (6, 0, 7.0)], "area_id long, population long, work double")
    got = {(r["neighborhood_id"], r["year"]): r for r in census.profiles(areas, c, spark.createDataFrame([(1, 110), (6, 5)], "area_id long, population long"), ("work",)).collect()}
    assert set(got) == {(1, 2022), (1, 2024), (2, 2022), (4, 2022), (4, 2024)}
    assert (got[1, 2022]["population"], got[1, 2022]["work"], got[1, 2022]["areas"], got[1, 2022]["profile_quality"], got[1, 2022]["growth_pct"]) == (100, 50.0, 1, "validated", None)
    assert (got[1, 2024]["population"], got[1, 2024]["growth_pct"], got[1, 2024]["work"]) == (110, 10.0, 50.0)
    assert (got[2, 2022]["population"], got[2, 2022]["work"], got[2, 2022]["profile_quality"], got[2, 2022]["safe_for_score"]) == (200, None, "provisional", False)
    assert got[4, 2024]["growth_pct"] is None and got[4, 2022]["safe_for_score"]


def test_evaluation_finds_what_is_wrong(spark):
    comps = spark.createDataFrame([("home",), ("shop",)], "nature string")
    rolling = spark.createDataFrame([(1, 0, 5.0, None, None, None), (2, 0, None, 9.0, None, 2.0), (3, 4, 1.0, 1.0, 0.0, 1.0)], "neighborhood_id long, executed_count long, median_pp_sqm double, median_ask_sqm double, premium_pct double, inventory_months double")
    profile = spark.createDataFrame([(1, 10.0, "provisional", True), (2, None, "validated", True)], "neighborhood_id long, population double, profile_quality string, safe_for_score boolean")
    marks = spark.createDataFrame([(1, 0, 3, 0.4, "discount"), (1, 5, 3, 0.9, "neutral"), (1, 5, 3, 0.2, "insufficient")], "neighborhood_id long, executed_n long, others long, confidence double, signal string")
    places = spark.createDataFrame([(1,), (2,), (3,)], "neighborhood_id long")
    got = {r["case"]: (r["rows"], r["violations"], r["passed"]) for r in evaluation.place_cases(comps, rolling, profile, places, marks, {"rolling": rolling, "places": comps}, ("shop",)).collect()}
    assert got == {
        "comparables-residential-only": (2, 1, False), "asking-executed-separate": (3, 0, True), "sparse-places-no-invented-executed": (3, 1, False), "census-provisional-not-score-safe": (2, 1, False), "census-coverage": (3, 2, False),
        "listing-benchmark-grounded": (3, 1, False), "listing-confidence-gates-signal": (3, 1, False), "market-liquidity-consistency": (3, 1, False), "surfaces-exist": (4, 5, False)}
    empty = {r["case"]: r["passed"] for r in evaluation.place_cases(comps.limit(0), rolling.limit(0), profile.limit(0), places.limit(0), marks.limit(0), {"places": places}, ()).collect()}
    assert not empty["census-coverage"] and not empty["listing-benchmark-grounded"] and empty["market-liquidity-consistency"]


def test_columns(spark):
    one = lambda c, *row: spark.createDataFrame([row], ", ".join(f"_{i} string" for i in range(len(row)))).select(c).first()[0]
    assert one(clean.normalize_url(F.col("_0")), "HTTPS://Ex.COM/A?utm_source=x&Q=1#f") == "https://ex.com/A?Q=1"
    assert one(clean.project_address(F.col("_0")), ' רח"ל,  5 ') == "רחל 5"
    assert [one(clean.city_name(F.col("_0")), x) for x in ("קרית  פתח תקוה", "חיפה והקריות", "אילת", None)] == ["פתח תקווה", "חיפה", None, None]
    df = spark.createDataFrame([("Ｓt. ①", 1), ("plain", 2), (None, 3), ("Ｓt. ①", 4)], "a string, k int")
    assert [r["a"] for r in clean.composed(df, "a").orderBy("k").collect()] == ["St. 1", "plain", None, "St. 1"]
    assert [one(scoring.confidence_level(F.col("_0").cast("double")), x) for x in ("80", "60", "35", "34.9", None)] == ["high", "medium", "low", "insufficient", "insufficient"]
    deals = spark.createDataFrame([("a", 150.0, 1.0, 2.0), ("a", -10.0, 1.0, 1.0), ("b", 50.0, 0.0, 1.0)], "k string, score double, freshness double, weight double")
    assert {r["k"]: (r["local"], r["n"]) for r in scoring.weighted_deals(deals, ["k"]).collect()} == {"a": (50.0, 2), "b": (None, 0)}
    t = dt.datetime(2024, 1, 10)
    rows = [(1, False, t, "ok", None), (2, True, None, "ok", None), (3, True, t, "failed", None), (4, True, t - dt.timedelta(days=3), "ok", None), (5, True, t, "ok", "c"), (6, True, t, "ok", None)]
    states = quality.dataset_health(spark.createDataFrame(rows, "k int, enabled boolean, last_checked timestamp, status string, cursor string"), t).orderBy("k").collect()
    assert [r["health"] for r in states] == ["disabled", "never_run", "failed", "stale", "syncing", "healthy"]


def test_nearest_across_the_180th_meridian(spark):
    points = spark.createDataFrame([(1, 179.99, 0.0), (2, -179.99, 60.0), (3, 0.0, 0.0), (4, 180.0, 89.9)], "point_id long, lon double, lat double")
    anchors = spark.createDataFrame([(7, -179.99, 0.0), (8, 179.98, 60.0), (9, -179.0, 89.9)], "anchor_id long, a_lon double, a_lat double")
    assert {(r["point_id"], r["anchor_id"]) for r in spatial.nearest(points, anchors, 5.0).collect()} == {(1, 7), (2, 8), (4, 9)}
