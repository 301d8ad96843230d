"""File sources: strict CSV, statistical series, feature collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted fields may hold commas and ends of lines; a ragged row fails the read."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST")


def sdmx_series(df: DataFrame, since: int = 2022) -> DataFrame:
    """Series, period and value of observations from a year on; the key is ``series:period``, all columns stay as JSON."""
    year = F.regexp_extract("TIME_PERIOD", r"^(\d{4})", 1).try_cast("int")
    return df.filter(year >= since).select(
        F.concat_ws(":", "SERIES_CODE", "TIME_PERIOD").alias("row_key"), F.col("SERIES_CODE").alias("series"), F.col("TIME_PERIOD").alias("period"), F.col("OBS_VALUE").try_cast("double").alias("value"), F.to_json(F.struct(*sorted(df.columns))).alias("attributes"))


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """One row a feature: properties, geometry type, coordinates as JSON, and a hash of them."""
    f = spark.read.json(path, schema=FEATURES, multiLine=True).select(F.explode("features").alias("f"))
    g = f.select(F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"))
    return g.withColumn("row_hash", F.sha2(F.concat_ws("|", F.to_json("properties"), "type", "coordinates"), 256))
