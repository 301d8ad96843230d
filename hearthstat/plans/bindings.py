"""The canonical property tables, bound to the driver's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TX_AS_OF = dt.date(2001, 8, 2)
LISTING_AS_OF = dt.datetime(2024, 1, 31)


class Tables:
    """Lazily read tables of one data folder; only the columns a query uses are read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def transactions(self) -> DataFrame:
        key = F.col("o_orderkey")
        return (
            self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .select(
                key.alias("transaction_id"), F.when(key % 17 != 0, F.col("c_nationkey")).alias("neighborhood_id"), F.col("c_nationkey").alias("home_id"), F.col("o_custkey").alias("parcel_id"),
                F.col("o_orderdate").cast("date").alias("deal_date"), F.col("o_totalprice").alias("amount"), (10 + (key * 37) % 400).cast("double").alias("area_sqm"),
                F.when(key % 11 != 0, 1 + key % 5).alias("rooms"), (key % 12).alias("floor"), F.col("o_orderpriority").alias("nature"),
                F.when(F.col("o_orderstatus") == "P", 0.5).when(F.col("o_orderstatus") == "F", 1.0).alias("ownership_fraction"),
            )
            .withColumn("pp_sqm", F.col("amount") / F.col("area_sqm"))
        )

    def neighborhoods(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").alias("neighborhood_id"), F.col("n_regionkey").alias("city_id"), F.col("n_name").alias("name"))

    def snapshots(self) -> DataFrame:
        return self.raw("events").select(
            F.col("user_id").alias("listing_id"), F.col("ts").alias("observed_at"), F.col("event_id").alias("sequence"), F.floor((F.col("value") + 50) * 2000).cast("double").alias("asking_price"),
            F.when(F.col("event_type") == "error", "inactive").otherwise("active").alias("status"),
        )

    def listings(self) -> DataFrame:
        key = F.col("c_custkey")
        seen = self.raw("events").select(F.col("user_id").alias("c_custkey")).distinct()
        return self.raw("customer").join(seen, "c_custkey", "left_semi").select(
            key.alias("listing_id"), F.col("c_nationkey").alias("neighborhood_id"), F.when(key % 7 == 0, "inactive").otherwise("active").alias("status"),
            (40 + (key * 7) % 120).cast("double").alias("area_sqm"), (1 + key % 5).alias("rooms"), (key % 12).alias("floor"),
        )

    def rents(self) -> DataFrame:
        return self.raw("events").filter("event_type = 'view'").select(
            F.col("user_id").alias("listing_id"), F.col("ts").alias("observed_at"), F.col("event_id").alias("sequence"), F.floor((F.col("value") + 50) * 40).cast("double").alias("asking_rent"))

    def crosswalk(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.raw("supplier").select(
            key.alias("stat_area_id"), F.col("s_nationkey").alias("neighborhood_id"), F.when(key % 3 == 0, 1.0).when(key % 3 == 1, 0.85).alias("overlap_ratio"), (0.70 + (key % 4) * 0.09).alias("confidence"),
            (1000 + key * 13).alias("population"), F.when(key % 5 != 0, 40 + key % 40).cast("double").alias("employment_pct"), (60000 + (key * 97) % 50000).cast("double").alias("wage"),
            (1000 + key * 13 + (key * 29) % 200 - 50).alias("population_2024"),
        )

    def points(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(key.alias("point_id"), (34 + ((key * 7919) % 1000) / 1000.0).alias("lon"), (31 + ((key * 104729) % 1000) / 1000.0).alias("lat"))

    def projects(self) -> DataFrame:
        key = F.col("s_suppkey")
        units = F.when(key % 13 == 0, 0).otherwise(10 + key % 90)
        return self.raw("supplier").select(key.alias("project_id"), F.col("s_nationkey").alias("neighborhood_id"), units.alias("existing_units"), (units * (2 + key % 4)).alias("planned_units"), (key % 3 == 0).alias("in_execution"), (key % 4).alias("permits_count"))


#: The same tables as DuckDB common table expressions.
SQL = """
tx AS (SELECT *, amount / area_sqm AS pp_sqm FROM (SELECT o_orderkey AS transaction_id, CASE WHEN o_orderkey % 17 <> 0 THEN c_nationkey END AS neighborhood_id, c_nationkey AS home_id, o_custkey AS parcel_id,
  CAST(o_orderdate AS DATE) AS deal_date, o_totalprice AS amount, CAST(10 + (o_orderkey * 37) % 400 AS DOUBLE) AS area_sqm, CASE WHEN o_orderkey % 11 <> 0 THEN 1 + o_orderkey % 5 END AS rooms,
  o_orderkey % 12 AS floor, o_orderpriority AS nature, CASE o_orderstatus WHEN 'P' THEN CAST(0.5 AS DOUBLE) WHEN 'F' THEN CAST(1 AS DOUBLE) END AS ownership_fraction
  FROM orders JOIN customer ON o_custkey = c_custkey)),
comps AS (SELECT * FROM tx WHERE deal_date IS NOT NULL AND amount > 0 AND area_sqm BETWEEN 15 AND 400 AND pp_sqm BETWEEN 100 AND 20000
  AND (ownership_fraction IS NULL OR ownership_fraction >= CAST(0.9 AS DOUBLE)) AND nature <> '4-NOT SPECIFIED'),
hoods AS (SELECT n_nationkey AS neighborhood_id, n_regionkey AS city_id, n_name AS name FROM nation),
snaps AS (SELECT user_id AS listing_id, ts AS observed_at, event_id AS sequence, CAST(floor((value + 50) * 2000) AS DOUBLE) AS asking_price,
  CASE WHEN event_type = 'error' THEN 'inactive' ELSE 'active' END AS status FROM events),
rents AS (SELECT user_id AS listing_id, ts AS observed_at, event_id AS sequence, CAST(floor((value + 50) * 40) AS DOUBLE) AS asking_rent FROM events WHERE event_type = 'view'),
listings AS (SELECT c_custkey AS listing_id, c_nationkey AS neighborhood_id, CASE WHEN c_custkey % 7 = 0 THEN 'inactive' ELSE 'active' END AS status, CAST(40 + (c_custkey * 7) % 120 AS DOUBLE) AS area_sqm,
  1 + c_custkey % 5 AS rooms, c_custkey % 12 AS floor FROM customer WHERE c_custkey IN (SELECT user_id FROM events)),
xwalk AS (SELECT s_suppkey AS stat_area_id, s_nationkey AS neighborhood_id, CASE s_suppkey % 3 WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN CAST(0.85 AS DOUBLE) END AS overlap_ratio,
  CAST(0.70 AS DOUBLE) + (s_suppkey % 4) * CAST(0.09 AS DOUBLE) AS confidence, 1000 + s_suppkey * 13 AS population, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(40 + s_suppkey % 40 AS DOUBLE) END AS employment_pct,
  CAST(60000 + (s_suppkey * 97) % 50000 AS DOUBLE) AS wage, 1000 + s_suppkey * 13 + (s_suppkey * 29) % 200 - 50 AS population_2024 FROM supplier),
projects AS (SELECT *, existing_units * (2 + project_id % 4) AS planned_units FROM (SELECT s_suppkey AS project_id, s_nationkey AS neighborhood_id, CASE WHEN s_suppkey % 13 = 0 THEN 0 ELSE 10 + s_suppkey % 90 END AS existing_units,
  s_suppkey % 3 = 0 AS in_execution, s_suppkey % 4 AS permits_count FROM supplier)),
points AS (SELECT c_custkey AS point_id, 34 + ((c_custkey * 7919) % 1000) / CAST(1000 AS DOUBLE) AS lon, 31 + ((c_custkey * 104729) % 1000) / CAST(1000 AS DOUBLE) AS lat FROM customer),
latest AS (SELECT listing_id, arg_max(asking_price, sequence) AS asking_price, max(observed_at) AS last_seen, min(observed_at) AS first_seen, count(*) AS n_snapshots FROM snaps GROUP BY 1),
latest_rent AS (SELECT listing_id, arg_max(asking_rent, sequence) AS asking_rent FROM rents GROUP BY 1)
"""
