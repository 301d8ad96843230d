"""Queries of typed datasets and of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthstat.plans.catalog import query
from hearthstat.sources import cursors, datasets


def _raw(t):
    """Payloads of three datasets as sources write them: yearly wages with a correction, series, census areas; a broken one."""
    k, row = F.col("s_suppkey"), lambda *c: F.to_json(F.struct(*c))
    s = t.raw("supplier")
    year, price = (2015 + k % 9).cast("string"), F.concat(F.lit(" "), F.floor(9 + k % 7).cast("string"), F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("%"))
    wage = lambda more, part: row(F.when(k % 11 != 0, F.concat(F.lit("m"), k % 40)).otherwise("").alias("municipality"), year.alias("observation_year"), part.alias("average_wage"), F.concat(F.lit(f"2024-0{more}-"), F.lpad((1 + k % 28).cast("string"), 2, "0")).alias("first_seen"))
    series = row(F.concat(F.lit("S"), k % 5).alias("series_code"), F.concat(F.lit("2023-"), k % 12).alias("observation_period"), F.when(k % 6 == 0, "n/a").otherwise((k * 0.5).cast("string")).alias("value"), F.struct(F.lit("ILS").alias("unit"), (k % 2 == 0).alias("final")).alias("attributes"))
    area = row(F.concat((4000 + k % 3).cast("string"), F.lit(".0")).alias("locality_code"), F.when(k % 13 != 0, (k % 17).cast("string")).alias("statistical_area_code"))
    of = lambda slug, payload: s.select(F.lit(slug).alias("slug"), payload.alias("payload"), F.timestamp_seconds(1_700_000_000 + k % 50).alias("loaded_at"))
    parts = [of("municipal_wages", wage(1, price)), of("municipal_wages", wage(2, F.when(k % 3 == 0, "").otherwise(F.lit("10,500")))), of("policy_interest_rates", series), of("census_2022", area), of("census_2022", F.lit("{oops"))]
    raw = parts[0]
    for p in parts[1:]:
        raw = raw.unionByName(p)
    return raw.withColumn("row_hash", F.sha2("payload", 256))


_PAYLOADS = """k AS (SELECT s_suppkey AS k, to_timestamp(1700000000 + s_suppkey % 50)::TIMESTAMP AS loaded FROM supplier),
w AS (SELECT nullif(CASE WHEN k % 11 <> 0 THEN 'm' || k % 40 ELSE '' END, '') AS municipality, CAST(2015 + k % 9 AS DOUBLE) AS y, v, CASE v WHEN 1 THEN CAST((9 + k % 7) * 1000 + k % 1000 AS DOUBLE) ELSE CASE WHEN k % 3 <> 0 THEN 10500::DOUBLE END END AS wage, '2024-0' || v || '-' || lpad(CAST(1 + k % 28 AS VARCHAR), 2, '0') AS seen, loaded,
  '{"municipality":"' || CASE WHEN k % 11 <> 0 THEN 'm' || k % 40 ELSE '' END || '","observation_year":"' || (2015 + k % 9) || '","average_wage":"' || CASE v WHEN 1 THEN ' ' || (9 + k % 7) || ',' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || '%' ELSE CASE WHEN k % 3 = 0 THEN '' ELSE '10,500' END END || '","first_seen":"2024-0' || v || '-' || lpad(CAST(1 + k % 28 AS VARCHAR), 2, '0') || '"}' AS payload
  FROM k, (VALUES (1), (2)) t(v))"""


@query(f"""WITH {{B}}, {_PAYLOADS}, h AS (SELECT *, sha256(payload) AS hash FROM w) SELECT hash AS record_id, municipality, y AS observation_year, wage AS average_wage FROM h
  QUALIFY row_number() OVER (PARTITION BY CASE WHEN municipality IS NULL THEN hash ELSE municipality || '/' || y END ORDER BY seen DESC, loaded DESC, hash DESC) = 1""")
def dataset_wages(t):
    return datasets.compiled(_raw(t), datasets.DATASETS["municipal_wages"]).drop("loaded_at")


@query("""SELECT series_code, observation_period, value, attributes FROM (SELECT 'S' || s_suppkey % 5 AS series_code, '2023-' || s_suppkey % 12 AS observation_period, CASE WHEN s_suppkey % 6 <> 0 THEN s_suppkey * 0.5::DOUBLE END AS value, '{"final":' || (s_suppkey % 2 = 0) || ',"unit":"ILS"}' AS attributes, s_suppkey % 50 AS loaded,
  sha256('{"series_code":"S' || s_suppkey % 5 || '","observation_period":"2023-' || s_suppkey % 12 || '","value":"' || CASE WHEN s_suppkey % 6 = 0 THEN 'n/a' ELSE CAST(s_suppkey * 0.5::DOUBLE AS VARCHAR) END || '","attributes":{"unit":"ILS","final":' || (s_suppkey % 2 = 0) || '}}') AS hash FROM supplier)
  QUALIFY row_number() OVER (PARTITION BY series_code, observation_period ORDER BY loaded DESC, hash DESC) = 1""")
def dataset_series(t):
    return datasets.compiled(_raw(t), datasets.DATASETS["policy_interest_rates"]).drop("loaded_at", "record_id")


@query("""SELECT locality_code, statistical_area_code, count(*) AS n FROM (SELECT DISTINCT CAST(4000 + s_suppkey % 3 AS VARCHAR) AS locality_code, CASE WHEN s_suppkey % 13 <> 0 THEN CAST(s_suppkey % 17 AS VARCHAR) END AS statistical_area_code FROM supplier) GROUP BY 1, 2""")
def dataset_areas(t):
    return datasets.compiled(_raw(t), datasets.DATASETS["census_2022"]).groupBy("locality_code", "statistical_area_code").agg(F.count("*").alias("n"))


@query("""WITH {B}, f AS (SELECT listing_id, neighborhood_id, asking_price, CASE status WHEN 'active' THEN 0 WHEN 'inactive' THEN 1 ELSE 2 END AS step FROM listings LEFT JOIN latest USING (listing_id) WHERE rooms >= 2)
  SELECT listing_id, neighborhood_id, asking_price, step, total, total > 45 AS more FROM (SELECT * FROM f ORDER BY step, asking_price DESC NULLS LAST, listing_id LIMIT 25 OFFSET 20), (SELECT count(*) AS total FROM f)""")
def listing_page(t):
    last = t.snapshots().groupBy("listing_id").agg(F.max_by("asking_price", "sequence").alias("asking_price"))
    rows = t.listings().filter("rooms >= 2").join(last, "listing_id", "left").select("listing_id", "neighborhood_id", "asking_price", cursors.ladder(F.col("status"), "active", "inactive").alias("step"))
    return cursors.page_with_total(rows, [("step", "asc"), ("asking_price", "desc")], {"step", "asking_price"}, "listing_id", 25, 20)
