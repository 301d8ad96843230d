"""Typed datasets, counted appends and page cursors on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hearthstat.sources import cursors, datasets

RAW = "slug string, row_hash string, payload string, loaded_at timestamp"
T = dt.datetime(2024, 1, 10)


def at(h):
    return T + dt.timedelta(hours=h)


def test_catalogue():
    assert len(datasets.DATASETS) == 48 and sum(d.adapter == "blocked" for d in datasets.DATASETS.values()) == 2
    one = datasets.from_catalogue('[{"slug": "x", "adapter": "archive", "keys": ["a"], "fields": [{"name": "a"}, {"name": "n", "source": "N o", "type": "integer"}, {"name": "u", "constant": 2022}, {"name": "ok", "type": "boolean"}]}]')["x"]
    assert one.keys == ("a",) and [f.kind for f in one.fields] == ["text", "number", "constant", "flag"] and one.fields[1].source == "N o"


def test_corrections_types_and_codes(spark):
    fields = (datasets.Field("municipality"), datasets.Field("year", kind="number"), datasets.Field("wage", "avg 'wage'", "number"), datasets.Field("block"), datasets.Field("note"), datasets.Field("shape", kind="json"),
              datasets.Field("safe", kind="flag"), datasets.Field("day", kind="date"), datasets.Field("boundary", kind="constant", constant=2022))
    d = datasets.Dataset("m", "archive", ("municipality", "year"), fields)
    rows = [
        ("m", "h1", """{"municipality": "A", "year": 2023, "avg 'wage'": "10,000", "first_seen": "2024-01-01", "block": "4000.0", "note": "", "shape": {"b": [1, 2]}, "safe": "true", "day": "2023"}""", at(0)),
        ("m", "h2", """{"municipality": "A", "year": 2023, "avg 'wage'": " 12,000 ", "first_seen": "2024-02-01", "block": 514.0, "safe": false, "day": "5/3/2023"}""", at(-9)),
        ("m", "h3", """{"municipality": "", "year": 2023, "avg 'wage'": "n/a"}""", at(0)), ("m", "h4", """{"municipality": "", "year": 2023}""", at(0)), ("m", "h5", None, at(0)), ("m", "h6", "no json", at(0)),
        ("m", "h7", """{"municipality": "B", "year": "2,023", "avg 'wage'": "-3.5%", "safe": true}""", at(0)), ("m", "h8", """{"municipality": "B", "year": "2023", "avg 'wage'": "1e3"}""", at(0)), ("other", "h9", "{}", at(0)),
    ]
    got = {r["record_id"]: r for r in datasets.compiled(spark.createDataFrame(rows, RAW), d).collect()}
    assert set(got) == {"h2", "h3", "h4", "h8"}  # a correction wins, equal load times go by hash, incomplete keys stay apart
    assert (got["h2"]["wage"], got["h2"]["block"], got["h2"]["day"], got["h2"]["safe"], got["h2"]["boundary"]) == (12000.0, "514", dt.date(2023, 3, 5), False, 2022)
    assert got["h3"]["municipality"] is None and got["h3"]["wage"] is None and got["h8"]["wage"] is None and got["h3"]["safe"] is False
    first = datasets.compiled(spark.createDataFrame(rows[:1], RAW), d).first()
    assert (first["wage"], first["block"], first["note"], first["shape"], first["safe"], first["day"]) == (10000.0, "4000", None, '{"b":[1,2]}', True, dt.date(2023, 1, 1))
    assert datasets.compiled(spark.createDataFrame([], RAW), d).count() == 0


def test_unknown_fields(spark):
    raw = spark.createDataFrame([("parcels", "a", '{"parcel_id": "7", "שם רחוב": "x"}', at(0)), ("parcels", "b", '{"parcel_id": "7", "area": 3}', at(1)), ("brt_routes", "c", "{}", at(0))], RAW)
    d = datasets.discovered(raw, "parcels")
    assert [f.name for f in d.fields] == ["area", "parcel_id", "שם רחוב"] and d.keys == ("parcel_id",)
    assert [tuple(r)[2:] for r in datasets.compiled(raw, d).collect()] == [("3", "7", None)]
    every = datasets.compile_all(raw)
    assert len(every) == 46 and every["brt_routes"].count() == 1 and every["sale_listings"].count() == 0


def test_counted_append(spark, tmp_path):
    stored = spark.createDataFrame([("a",)], "row_hash string")
    page = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", None)], "row_hash string, v int")
    new, fetched, inserted = datasets.append_counted(page, stored, ["row_hash"])
    new.write.parquet(str(tmp_path / "t"))
    assert (fetched.get["rows"], inserted.get["rows"]) == (4, 2) and {tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("b", 2), ("c", None)}


def test_cursor(spark):
    rows = [(at(i // 3), f"k{i % 3}", i) for i in range(20)]
    df = spark.createDataFrame(rows, "ts timestamp, k string, v int").repartition(5)
    cursor, seen, totals = cursors.begin(df, "ts", "k"), [], []
    later = df.unionByName(spark.createDataFrame([(at(50), "k0", 99)], df.schema))  # rows that come after the run began are not its own
    while cursor:
        p = cursors.page(later, "ts", "k", cursors.Cursor.of_token(cursor.token()), 6)
        seen += [r["v"] for r in p.rows]
        totals.append(p.total)
        assert p.more == (p.cursor is not None)
        cursor = p.cursor
    assert seen == list(range(20)) and totals == [20, 14, 8, 2]
    mark = (at(6), "k1")  # what was read up to here; late rows came two hours and five hours before it
    late = later.unionByName(spark.createDataFrame([(at(4), "k9", 100), (at(1), "k9", 101)], df.schema))
    c = cursors.begin(late, "ts", "k", mark, dt.timedelta(hours=3), now=at(6))
    got = cursors.page(late, "ts", "k", c, 100)
    assert c.upper == (at(50), "k0") and not got.more
    assert {r["v"] for r in got.rows} == {r[2] for r in rows if r[0] >= at(3)} | {99, 100}
    assert cursors.begin(df.limit(0), "ts", "k") is None


def test_order(spark):
    df = spark.createDataFrame([(1, "stale", None), (2, "failed", 3.0), (3, "what", 1.0), (4, "failed", 5.0)], "id int, status string, v double")
    ranked = df.withColumn("step", cursors.ladder(F.col("status"), "failed", "stale"))
    got = cursors.page_with_total(ranked, [("step", "asc"), ("v", "desc")], {"step", "v"}, "id", 2, 1).collect()
    assert [(r["id"], r["total"], r["more"]) for r in got] == [(2, 4, True), (1, 4, True)]
    assert [r["id"] for r in cursors.sorted_by(df, [("v", "asc")], {"v"}, "id").collect()] == [3, 2, 4, 1]
    with pytest.raises(ValueError):
        cursors.sorted_by(df, [("id; drop", "asc")], {"v"}, "id")
