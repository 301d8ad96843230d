"""Pages written once through a rerun batch, late rows inside and outside the bound, and SQL names of column functions."""

import datetime as dt
import shutil

from pyspark.sql import functions as F

from hearthstat.functions import clean, register
from hearthstat.operators import scoring
from hearthstat.streaming import pages

T = dt.datetime(2024, 1, 10)


def test_pages_once(spark, tmp_path):
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    schema = "h string, v int"
    run = lambda: pages.write_pages(spark.readStream.schema(schema).parquet(source), out, check, ["h"]).awaitTermination(120)
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], schema).write.parquet(source)
    run()
    spark.createDataFrame([("b", 9), ("c", 1)], schema).write.mode("append").parquet(source)
    run()
    want = [("a", 1, 0), ("b", 1, 0), ("c", 1, 1)]
    assert sorted(tuple(r) for r in pages.read_pages(spark, out, ["h"]).collect()) == want
    shutil.rmtree(f"{check}/commits/1", ignore_errors=True)
    (tmp_path / "ck/commits/1").unlink(missing_ok=True)  # as if the driver was lost after writing, before the commit
    (tmp_path / "ck/commits/.1.crc").unlink(missing_ok=True)
    run()
    assert sorted(tuple(r) for r in pages.read_pages(spark, out, ["h"]).collect()) == want
    assert spark.read.parquet(out).count() == 4


def test_late_rows(spark, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "ck")
    day = dt.timedelta(days=1)

    def run(*at):
        spark.createDataFrame([(t,) for t in at], "ts timestamp").write.mode("append").parquet(source)
        s = spark.readStream.schema("ts timestamp").parquet(source)
        pages.counts_within(s, "ts").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination(120)

    run(T, T + day)
    run(T + 4 * day)  # closes windows that end by two days before
    run(T + 3 * day, T)  # the first is within the bound, the second too late
    run(T + 9 * day)
    got = {r["start"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {T: 1, T + day: 1, T + 3 * day: 1, T + 4 * day: 1}


def test_sql_names(spark):
    register.register_all(spark)
    df = spark.createDataFrame([("₪ 1,200", "3/4/2020", "Old-Town 1", 8, 34.8, 32.0), ("x", "2020-05-06", "", 90, 35.0, 31.0), (None, None, None, None, None, None)], "a string, d string, s string, n int, lon double, lat double")
    got = df.selectExpr("hs_number(a)", "hs_date(d)", "hs_name(s)", "hs_address(s)", "hs_freshness(n)", "hs_km(lon, lat, 34.9D, 32.1D)", "hs_shrink(lon, n, 30.0D, 5.0D)").collect()
    c = F.col
    want = df.select(clean.to_number(c("a")), clean.to_iso_date(c("d")), clean.normalize_name(c("s")), clean.normalize_address(c("s")), clean.freshness_weight(c("n")), clean.haversine_km(c("lon"), c("lat"), F.lit(34.9), F.lit(32.1)), scoring.bayesian_adjust(c("lon"), c("n"), F.lit(30.0))).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
