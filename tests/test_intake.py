"""Column functions and intake on literal rows: nulls, empty texts, forms that do not parse."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hearthstat.functions import clean
from hearthstat.operators import intake
from hearthstat.sources import documents


def values(spark, col, *rows):
    schema = "k int, x string"
    return [r[0] for r in spark.createDataFrame(list(enumerate(rows)), schema).orderBy("k").select(col).collect()]


def test_text_columns(spark):
    x = F.col("x")
    assert values(spark, clean.year_of(x), "3/4/2020", "2021", "2022-05-06T10:00", "20", "about 2020", None) == [2020, 2021, 2022, None, None, None]
    assert values(spark, clean.digits_number(x), "1,234.5 sqm", "none", "", None) == [1234.5, None, None, None]
    assert values(spark, clean.normalize_address(x), "Elm-St.  12,", "", None) == ["elm st 12", "", None]
    assert values(spark, clean.street_key(x), "Elm St. 12b apt 4", "12", None) == ["elm st", "", None]
    assert values(spark, clean.url_kind(x), "https://x/item/a1", "https://x/search", "https://x/about", None) == ["item", "search", "unknown", "unknown"]
    assert values(spark, documents.deep_find(x, ("price", "ask")), '{"a":{"ask":"1,200"}}', '{"ask":3,"price":{"ask":4}}', '{"price":null}', "", None) == [1200.0, 3.0, None, None, None]


def test_collections(spark):
    row = spark.sql("SELECT array('b', ' a', '', NULL, 'b') AS s, map('x', true, 'y', false, 'w', true) AS m, CAST(NULL AS array<string>) AS e")
    assert row.select(clean.strings(F.col("s")), clean.set_flags(F.col("m")), clean.strings(F.col("e"))).first()[:] == (["a", "b"], ["w", "x"], None)


def test_location(spark):
    rows = [(34.8, 32.0, "site", "exact"), (34.8, None, "site", "exact"), (200.0, 32.0, "guess", None), (None, None, "site", "exact")]
    df = spark.createDataFrame(rows, "lon double, lat double, source string, accuracy string")
    got = [r[0] for r in df.select(clean.location_problems(F.col("lon"), F.col("lat"), F.col("source"), F.col("accuracy"), ["site"], ["exact"])).collect()]
    assert got == [[], ["incomplete_pair"], ["out_of_range", "unknown_source", "unknown_accuracy"], []]


def test_in_filters(spark):
    df = spark.range(5)
    assert intake.in_filters(df, {"id"}, {"id": [1, 9]}).count() == 1
    with pytest.raises(ValueError, match="no filter"):
        intake.in_filters(df, {"id"}, {"other": [1]})


def test_recent(spark):
    got = values(spark, intake.recent_listing(F.col("x"), F.lit("a"), dt.date(2024, 1, 31), 7, ["a"]), "2024-01-24", "2024-01-23", "2024-02-01", "31/01/2024", None)
    assert got == [True, False, False, False, False]


def test_unwrap(spark):
    rows = ['{"data":[{"id":1}]}', '{"items":[{"id":2},{"id":3}]}', '[{"id":4}]', '{"data":[]}', "not json", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "k int, p string")
    assert sorted(tuple(r) for r in documents.unwrap_records(df, "p", ("data", "items"), "struct<id:int>").collect()) == [(0, 1), (1, 2), (1, 3), (2, 4)]


def test_rings(spark):
    assert values(spark, F.size(documents.points_of_wkt(F.col("x"))), "POLYGON((0 0, 1 0, 1 1, 0 0),(5 5, 6 6, 5 5))", "POINT(1 1)", "", None)[0] == 3
    assert values(spark, documents.points_of_wkt(F.col("x")).isNull(), "POINT(1 1)", None) == [True, True]
    assert values(spark, F.size(documents.points_of_rings(F.col("x"))), "[[[0,0],[1,0],[1,1],[0,0]]]", "[[[0,0]]]") == [3, 1]


def test_chained_streams(spark, tmp_path):
    """Details land as Parquet in one stream and get their state in a second one that reads what the first wrote."""
    schema = "source_listing_id long, at long, failed boolean, price double"
    spark.createDataFrame([(1, 1, False, 500_000.0), (2, 1, True, None), (3, 1, False, 10.0), (4, 1, None, None)], schema).write.parquet(str(tmp_path / "in"))
    out = lambda df, name: df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start().awaitTermination(120)
    out(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "landed")
    staged = intake.stage_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "landed")), F.col("price").between(300_000, 15_000_000))
    out(staged, "staged")
    out(staged, "staged")  # a second run finds nothing new
    got = sorted((r["source_listing_id"], r["state"], r["reason"]) for r in spark.read.parquet(str(tmp_path / "staged")).collect())
    assert got == [(1, "ready", None), (2, "error", "detail_failed"), (3, "filtered", "not_wanted"), (4, "filtered", "not_wanted")]
