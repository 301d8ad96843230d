"""Streams with keyed state, replayed in several batches, against their batch twins."""

import datetime as dt

import pytest

from hearthstat.operators import lifecycle
from hearthstat.streaming import changes

T = dt.datetime(2024, 1, 10)
SNAP = "listing_id long, observed_at timestamp, sequence long, asking_price double, status string"


@pytest.fixture()
def replay(spark, tmp_path):
    """Feeds batches one by one into ``build(streams)`` and returns all rows it wrote."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    changes.use_state(spark)

    def run(schemas, steps, build, idle=False):
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(idle).lower())  # with a time to live they never end
        out = str(tmp_path / "out")
        for step in steps:
            for name, rows in step.items():
                spark.createDataFrame(rows, schemas[name]).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            streams = {n: spark.readStream.schema(s).parquet(str(tmp_path / n)) for n, s in schemas.items()}
            q = build(streams).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
            assert q.awaitTermination(60)
        return spark.read.parquet(out)

    yield run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def snap(i, hours, price, status="active"):
    return (i, T + dt.timedelta(hours=hours), hours, float(price), status)


def test_changes(spark, replay):
    steps = [[snap(1, 0, 100), snap(1, 1, 90), snap(2, 1, 50)], [snap(1, 2, 90), snap(1, 3, 95, "inactive"), snap(3, 3, 7)], [snap(1, 4, 80, "active"), snap(1, 5, 120), snap(2, 5, 50), snap(3, 6, 6)]]
    got = replay({"s": SNAP}, [{"s": s} for s in steps], lambda x: changes.listing_changes_stream(x["s"]))
    want = lifecycle.listing_changes(spark.createDataFrame(sum(steps, []), SNAP))
    rows = lambda df: sorted((tuple(r) for r in df.select("listing_id", "sequence", "observed_at", "change", "old_price", "new_price").collect()), key=str)
    assert rows(got) == rows(want) and len(rows(got)) == 8


def test_inactive_without_a_row(spark, replay):
    day = 24
    steps = [[snap(1, 0, 1), snap(2, 0, 1), snap(2, 5, 1)], [snap(9, 3 * day, 1)], [snap(9, 4 * day, 1)], [snap(1, 4 * day + 1, 1), snap(9, 9 * day, 1)], [snap(9, 9 * day + 1, 1)]]
    got = replay({"s": SNAP}, [{"s": s} for s in steps], lambda x: changes.inactive_after_stream(x["s"].select("listing_id", "observed_at")), idle=True)
    rows = sorted((r["listing_id"], r["last_seen"], r["inactive"]) for r in got.collect())
    h = lambda n: T + dt.timedelta(hours=n)
    assert rows[:4] == [(1, h(0), False), (1, h(0), True), (1, h(4 * day + 1), False), (1, h(4 * day + 1), True)]
    assert rows[4:6] == [(2, h(0 + 5), False), (2, h(5), True)] and (9, h(9 * day + 1), True) not in rows
    batch = lifecycle.inactive_after(spark.createDataFrame(sum(steps, []), SNAP), h(9 * day + 1)).collect()
    last = {}
    for i, at, off in rows:
        last[i] = off
    assert {r["listing_id"]: r["inactive"] for r in batch} == last


def test_missing_cycles(spark, replay):
    seen, done = "scope string, listing_id long, cycle long", "scope string, cycle long"
    steps = [
        {"seen": [("country", 1, 1), ("city", 1, 1), ("country", 2, 1), ("off", 3, 1)], "done": [("country", 1), ("city", 1)]},
        {"seen": [("country", 2, 3)], "done": [("country", 2), ("country", 3), ("country", 4), ("off", 2), ("off", 3), ("off", 4)]},
        {"seen": [("city", 4, 4)], "done": [("city", 2), ("city", 3)]},  # 1 has missed three in one scope, two in the other
        {"seen": [("country", 5, 9)], "done": [("city", 4)]},  # now three in both; 5 is seen in an open cycle
        {"seen": [("city", 1, 5)], "done": [("city", 5), ("country", 5), ("country", 6)]},
    ]
    got = replay({"seen": seen, "done": done}, steps, lambda x: changes.missing_cycles_stream(x["seen"], x["done"], ["country", "city"], buckets=4))
    rows = sorted((r["listing_id"], r["cycle"], r["missing_cycles"], r["inactive"]) for r in got.collect())
    assert rows == [(1, 4, 3, True), (1, 6, 0, False), (2, 6, 3, True)]
    enabled = spark.createDataFrame([("country",), ("city",)], "scope string")
    frame = lambda name, schema: spark.createDataFrame([r for s in steps for r in s[name]], schema)
    batch = {r["listing_id"]: (r["missing_cycles"], r["inactive"]) for r in lifecycle.missing_cycles(frame("seen", seen), frame("done", done), enabled).collect()}
    assert batch == {1: (0, False), 2: (3, True), 4: (1, False), 5: (0, False)}
