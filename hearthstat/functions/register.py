"""Column functions under names of their own in SQL: temporary SQL functions, so they stay inside the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name: (parameters, type, body)
FUNCTIONS = {
    "hs_number": ("t STRING", "DOUBLE", r"try_cast(regexp_replace(t, r'[₪$€,%\s]', '') AS DOUBLE)"),
    "hs_date": ("t STRING", "DATE", "coalesce(CAST(try_to_timestamp(trim(t), 'd/M/yyyy') AS DATE), CAST(try_to_timestamp(trim(t), 'd.M.yyyy') AS DATE), CAST(try_to_timestamp(trim(t), 'yyyy-MM-dd') AS DATE))"),
    "hs_name": ("t STRING", "STRING", r"lower(regexp_replace(t, r'[\s\p{P}\p{S}]', ''))"),
    "hs_address": ("t STRING", "STRING", r"trim(regexp_replace(lower(t), r'[\s\p{P}\p{S}]+', ' '))"),
    "hs_freshness": ("days INT", "DOUBLE", "CASE WHEN days <= 7 THEN 1.0D WHEN days <= 14 THEN 0.9D WHEN days <= 30 THEN 0.75D WHEN days <= 60 THEN 0.5D ELSE 0.0D END"),
    "hs_km": ("lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE", "DOUBLE", "12742.0D * asin(sqrt(least(1.0D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"),
    "hs_shrink": ("local DOUBLE, n BIGINT, prior DOUBLE, k DOUBLE", "DOUBLE", "CASE WHEN local IS NULL THEN prior WHEN prior IS NULL THEN local ELSE (n * local + k * prior) / (n + k) END"),
}


def register_all(spark: SparkSession) -> list[str]:
    """Make every function known to ``spark.sql`` for this session."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
