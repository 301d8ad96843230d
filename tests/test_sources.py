"""File and page sources on small literal inputs, prices at a target rate, and streams against their batch twins."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hearthstat.operators import lifecycle, scenarios, spatial
from hearthstat.sources import files, pages
from hearthstat.streaming import changes


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,name\n1,"a, ""b""\nc"\n2,\n')
    assert [tuple(r) for r in files.csv_rows(spark, str(path), "id int, name string").collect()] == [(1, 'a, "b"\nc'), (2, None)]
    path.write_text("id,name\n1,a,b,c\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.csv_rows(spark, str(path), "id int, name string").collect()


def test_series(spark):
    rows = [("A", "2021-12", "1"), ("A", "2022-01", "2.5"), ("B", "2023", "x"), (None, "bad", None)]
    got = files.sdmx_series(spark.createDataFrame(rows, "SERIES_CODE string, TIME_PERIOD string, OBS_VALUE string")).collect()
    assert sorted((r["row_key"], r["value"]) for r in got) == [("A:2022-01", 2.5), ("B:2023", None)]
    assert json.loads(got[0]["attributes"])["OBS_VALUE"] == "2.5"


def test_features(spark, tmp_path):
    path = tmp_path / "f.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "x", "n": 3}, "geometry": {"type": "Point", "coordinates": [34.5, 31.5]}}]}, indent=1))
    (r,) = files.geojson_features(spark, str(path)).collect()
    assert r["properties"] == {"name": "x", "n": "3"} and r["type"] == "Point" and json.loads(r["coordinates"]) == [34.5, 31.5] and len(r["row_hash"]) == 64


def test_embedded_listings(spark):
    feed = {"feed": [{"id": "7", "price": "₪1,200,000", "rooms": "3.5", "area": "80 m", "city": "X", "published_at": "2024-01-05"}, {"id": "8", "promoted": True}]}
    html = f'<html><script type="application/json" id="listing-data">{json.dumps(feed, ensure_ascii=False)}</script></html>'
    got = pages.embedded_listings(spark.createDataFrame([(1, html), (2, "<html></html>"), (3, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert tuple(got[0]) == (1, "7", 1_200_000.0, 3.5, 80.0, "X", dt.date(2024, 1, 5), False)
    assert [(r["page_id"], r["rejected"]) for r in got[1:]] == [(2, True), (3, True)]


def test_price_at_target(spark):
    """The internal rate of return at the price found is the target."""
    row = {"rent": 4000.0, "rate_pct": 4.5, "years": 25.0, "hold_years": 10.0, "vacancy_pct": 5.0, "cost_pct": 10.0, "growth_pct": 2.0, "acquisition_pct": 6.0, "target_pct": 8.0}
    s = spark.createDataFrame([{**row, "loan_pct": v} for v in (0.0, 50.0, 70.0)])
    priced = scenarios.cash_flow(scenarios.max_purchase_price(s).withColumnRenamed("max_price", "price"))
    got = priced.select(scenarios.irr("equity", F.col("noi") - 12 * F.col("payment"), "exit_equity", "hold_years")).collect()
    assert all(abs(r[0] - 0.08) < 1e-6 for r in got)
    assert scenarios.max_purchase_price(s.withColumn("rent", F.lit(0.0))).filter("max_price IS NOT NULL").count() == 0


def test_missing_cycles(spark):
    seen = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 1, 5), ("a", 2, 2), ("c", 3, 5), ("a", 9, 5)], "scope string, listing_id int, cycle int")
    cycles = spark.createDataFrame([(s, c) for s in "abc" for c in range(1, 6)], "scope string, cycle int")
    got = lifecycle.missing_cycles(seen, cycles, spark.createDataFrame([("a",), ("b",)], "scope string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, False), (2, 3, True), (9, 0, False)]


def test_simplify(spark):
    ring = spark.sql("SELECT array(struct(1.00001D AS x, 2.0D AS y), struct(1.00002D AS x, 2.0D AS y), struct(1.1D AS x, 2.0D AS y)) AS ring")
    assert [tuple(p) for p in ring.select(spatial.simplify(F.col("ring"))).first()[0]] == [(1.0, 2.0), (1.1, 2.0)]


def test_composite(spark):
    """Components present share the weight; below 60 per cent of it there is no score."""
    from hearthstat.operators import scoring

    names = list(scoring.WEIGHTS)
    rows = [tuple([50.0] * 7), (80.0, None, 40.0, 60.0, None, None, None), (80.0, None, 40.0, None, None, None, None)]
    got = scoring.composite(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))).collect()
    assert [r["coverage"] for r in got] == [100.0, 60.0, 45.0]
    assert got[0]["score"] == 50.0 and abs(got[1]["score"] - (80 * 25 + 40 * 20 + 60 * 15) / 60) < 1e-9 and got[2]["score"] is None


def test_dedupe_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t), ("a", t + dt.timedelta(hours=1)), ("b", t)], "h string, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = changes.dedupe_stream(stream, ["h"], "ts").writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["h"] for r in spark.table("deduped").collect()) == ["a", "b"]
