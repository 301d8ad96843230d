"""Queries of census profiles and of the evaluation of finished marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthstat.operators import benchmarks, census, evaluation, market, periods
from hearthstat.plans.bindings import TX_AS_OF
from hearthstat.plans.catalog import comps, query, sql_of

#: Mappings of every method; every third place (by number) has no safe one.
_AREAS = """areas AS (SELECT neighborhood_id, stat_area_id AS area_id, CASE WHEN neighborhood_id % 3 <> 0 THEN CASE stat_area_id % 5 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.85::DOUBLE WHEN 2 THEN 0.6::DOUBLE END END AS overlap_ratio,
  CASE stat_area_id % 4 WHEN 0 THEN 'official_crosswalk' WHEN 1 THEN 'polygon_overlap' WHEN 2 THEN 'configured_crosswalk' ELSE 'parcel_evidence' END AS mapping_method, confidence AS mapping_confidence,
  neighborhood_id % 3 <> 0 AND stat_area_id % 7 = 0 AS exclusive, stat_area_id % 6 = 0 AS identity, population, employment_pct, wage, population_2024 FROM xwalk)"""
_PROFILES = f"""{_AREAS}, f AS (SELECT *, coalesce(overlap_ratio = 1, false) OR (mapping_method = 'polygon_overlap' AND coalesce(overlap_ratio >= 0.8::DOUBLE, false)) OR exclusive AS safe,
  mapping_confidence >= 0.85::DOUBLE AND (identity OR mapping_method IN ('configured_crosswalk', 'official_crosswalk')) AS reviewed FROM areas),
  q AS (SELECT *, 'validated' AS quality FROM f WHERE safe UNION ALL SELECT *, 'provisional' FROM f WHERE reviewed AND neighborhood_id NOT IN (SELECT neighborhood_id FROM f WHERE safe)),
  g AS (SELECT neighborhood_id, quality, count(*) AS areas, CAST(sum(population) AS DOUBLE) AS p22, CAST(sum(population_2024) FILTER (WHERE area_id % 9 <> 0) AS DOUBLE) AS p24, avg(mapping_confidence) AS mc, sum(population * employment_pct) / sum(population) FILTER (WHERE employment_pct IS NOT NULL) AS e, sum(population * wage) / sum(population) AS w FROM q GROUP BY 1, 2),
  profiles AS (SELECT neighborhood_id, year, CASE year WHEN 2022 THEN p22 ELSE p24 END AS population, CASE WHEN year = 2024 THEN round(100 * (p24 / p22 - 1), 6) END AS growth_pct, round(e, 6) AS employment_pct, round(w, 6) AS wage, areas, round(mc, 6) AS mapping_confidence, quality AS profile_quality,
  quality = 'validated' AS safe_for_score, CASE quality WHEN 'validated' THEN 'safe_stat_area_crosswalk' ELSE 'reviewed_crosswalk' END AS crosswalk_method FROM g, (SELECT unnest([2022, 2024]) AS year) WHERE year = 2022 OR p24 IS NOT NULL)"""


def _profiles(t):
    k, place = F.col("stat_area_id"), F.col("neighborhood_id")
    x = t.crosswalk()
    known = place % 3 != 0
    areas = x.select(
        "neighborhood_id", k.alias("area_id"), F.when(known, F.when(k % 5 == 0, 1.0).when(k % 5 == 1, 0.85).when(k % 5 == 2, 0.6)).alias("overlap_ratio"),
        F.when(k % 4 == 0, "official_crosswalk").when(k % 4 == 1, "polygon_overlap").when(k % 4 == 2, "configured_crosswalk").otherwise("parcel_evidence").alias("mapping_method"), F.col("confidence").alias("mapping_confidence"),
        (known & (k % 7 == 0)).alias("exclusive"), (k % 6 == 0).alias("safe_for_identity"), F.lit(None).cast("boolean").alias("safe_for_polygon"))
    return census.profiles(areas, x.select(k.alias("area_id"), "population", "employment_pct", "wage"), x.filter(k % 9 != 0).select(k.alias("area_id"), F.col("population_2024").alias("population")), ("employment_pct", "wage"))


@query(f"WITH {{B}}, {_PROFILES} SELECT * FROM profiles")
def census_profiles(t):
    return _profiles(t)


def evaluation_cases(t):
    rolling = periods.rolling(comps(t), t.snapshots(), t.rents(), t.listings(), TX_AS_OF)
    marks = benchmarks.listing_benchmarks(t.listings(), t.snapshots(), comps(t), market.place_trend(comps(t), TX_AS_OF), TX_AS_OF)
    own, places = _profiles(t), t.neighborhoods()
    return evaluation.place_cases(comps(t), rolling, own, places, marks, {"rolling": rolling, "benchmarks": marks, "census": own, "places": places}, ("4-NOT SPECIFIED",))


evaluation_cases = query(f"""WITH {{B}}, {_PROFILES}, rolling AS ({sql_of('market_periods_rolling')}), marks AS ({sql_of('listing_benchmarks')}), c AS (
  SELECT 'comparables-residential-only' AS "case", 'data-quality' AS category, 'critical' AS severity, count(*) AS rows, count(*) FILTER (WHERE nature = '4-NOT SPECIFIED') AS violations, false AS needs FROM comps
  UNION ALL SELECT 'asking-executed-separate', 'semantics', 'critical', 3, 0, false UNION ALL SELECT 'sparse-places-no-invented-executed', 'grounding', 'critical', count(*), count(*) FILTER (WHERE executed_count = 0 AND (median_pp_sqm IS NOT NULL OR premium_pct IS NOT NULL)), false FROM rolling
  UNION ALL SELECT 'census-provisional-not-score-safe', 'census', 'critical', count(*), count(*) FILTER (WHERE profile_quality = 'provisional' AND safe_for_score), false FROM profiles
  UNION ALL SELECT 'census-coverage', 'census', 'high', count(*), count(*) FILTER (WHERE neighborhood_id NOT IN (SELECT neighborhood_id FROM profiles)), true FROM hoods
  UNION ALL SELECT 'listing-benchmark-grounded', 'listing-benchmark', 'high', count(*), count(*) FILTER (WHERE executed_n <= 0 OR others <= 0 OR confidence <= 0), true FROM marks
  UNION ALL SELECT 'listing-confidence-gates-signal', 'listing-benchmark', 'high', count(*), count(*) FILTER (WHERE confidence < 0.5::DOUBLE AND signal IS DISTINCT FROM 'insufficient'), false FROM marks
  UNION ALL SELECT 'market-liquidity-consistency', 'market', 'medium', count(*), count(*) FILTER (WHERE executed_count = 0 AND inventory_months IS NOT NULL), false FROM rolling UNION ALL SELECT 'surfaces-exist', 'semantics', 'critical', 4, 0, false)
  SELECT "case", category, severity, rows, violations, violations = 0 AND (rows > 0 OR NOT needs) AS passed FROM c""")(evaluation_cases)
