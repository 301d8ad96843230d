"""Queries of the products of places on the canonical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthstat.operators import identity, lifecycle, market, opportunities, places
from hearthstat.plans.bindings import TX_AS_OF
from hearthstat.plans.catalog import comps, query, sql_of


@query("""WITH {B}, r AS (SELECT c_nationkey AS settlement, CAST(o_orderdate AS DATE) AS d, o_totalprice AS p, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders WHERE o_orderkey % 23 <> 0) AS a FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 23 <> 0),
  m AS (SELECT settlement, count(*) FILTER (WHERE d > a - INTERVAL 12 MONTH) AS n, count(*) FILTER (WHERE d <= a - INTERVAL 12 MONTH) AS k, quantile_cont(p, 0.5) FILTER (WHERE d > a - INTERVAL 12 MONTH) AS x, quantile_cont(p, 0.5) FILTER (WHERE d <= a - INTERVAL 12 MONTH) AS y FROM r WHERE d > a - INTERVAL 24 MONTH GROUP BY 1)
  SELECT settlement, n AS sales, k AS prior_sales, round(x, 4) AS median_price, round(y, 4) AS prior_median, round(100 * (x / y - 1), 4) AS change_pct FROM m""")
def city_trend(t):
    o = t.raw("orders").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
    date = F.when(F.col("o_orderkey") % 23 == 0, "n/a").when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "d/M/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    price = F.concat(F.lit("₪ "), F.format_string("%,.2f", "o_totalprice"))
    return places.settlement_trend(o.select(F.col("c_nationkey").alias("settlement"), date.alias("date"), price.alias("price")))


_METRICS = [("median_pp_sqm", "trend", "m0", "n0"), ("change_1y", "trend", "change_1y", "n0"), ("gross_yield_pct", "yields", "gross_yield_pct", "sample_count"), ("expansion", "renewals", "expansion", "projects"), ("employment_pct", "census", "employment_pct", "areas"), ("growth_pct", "census", "growth_pct", "areas")]
_LONG = f"""trend AS ({sql_of('place_trend')}), yields AS ({sql_of('gross_yield')}), renewals AS ({sql_of('renewal_summary')}), census AS ({sql_of('census_profile')}), long AS (SELECT neighborhood_id, metric, CAST(value AS DOUBLE) AS value, CAST(n AS BIGINT) AS sample_count, source,
  round(least(n / 20, 1.0::DOUBLE), 6) AS confidence FROM ({' UNION ALL '.join(f"SELECT neighborhood_id, '{m}' AS metric, {v} AS value, {n} AS n, '{f}' AS source FROM {f}" for m, f, v, n in _METRICS)}) WHERE value IS NOT NULL)"""


@query(f"WITH {{B}}, {_LONG} SELECT * FROM long")
def long_metrics(t):
    return places.long_metrics([
        (market.place_trend(comps(t), TX_AS_OF).withColumnRenamed("m0", "median_pp_sqm"), {"median_pp_sqm": "n0", "change_1y": "n0"}, "trend"), (market.gross_yield(t.snapshots(), t.rents(), t.listings()), {"gross_yield_pct": "sample_count"}, "yields"),
        (opportunities.renewal_summary(t.projects()), {"expansion": "projects"}, "renewals"), (market.census_profile(t.crosswalk()), {"employment_pct": "areas", "growth_pct": "areas"}, "census"),
    ])


_SCORED = f"""{_LONG}, ranked AS (SELECT *, 100 * (rank() OVER (PARTITION BY metric ORDER BY value) - 1 + 0.5::DOUBLE * count(*) OVER (PARTITION BY metric, value)) / count(*) OVER (PARTITION BY metric) AS s FROM long),
  parts AS (SELECT neighborhood_id, CASE metric WHEN 'change_1y' THEN 'market' WHEN 'gross_yield_pct' THEN 'rental' WHEN 'expansion' THEN 'renewal' WHEN 'median_pp_sqm' THEN 'supply' ELSE 'demographics' END AS part, avg(CASE WHEN metric = 'median_pp_sqm' THEN 100 - s ELSE s END) AS p, sum(confidence) AS c, count(*) AS n FROM ranked GROUP BY 1, 2),
  weighed AS (SELECT *, CASE part WHEN 'market' THEN 15 WHEN 'rental' THEN 10 WHEN 'renewal' THEN 20 WHEN 'supply' THEN 5 ELSE 15 END AS w FROM parts),
  scored AS (SELECT neighborhood_id, round(CAST(sum(w) AS DOUBLE), 4) AS coverage, round(CASE WHEN sum(w) >= 60 THEN sum(w * p) / sum(w) END, 6) AS score, round(sum(c) / sum(n), 6) AS confidence FROM weighed GROUP BY 1)"""


@query(f"WITH {{B}}, {_SCORED} SELECT * FROM scored")
def score_places(t):
    return places.score_places(long_metrics(t))


@query(f"WITH {{B}}, {_SCORED}, wide AS (SELECT neighborhood_id, {', '.join(f'''max(value) FILTER (WHERE metric = '{m}') AS {m}''' for m, *_ in _METRICS)} FROM long GROUP BY 1) SELECT * FROM wide FULL JOIN scored USING (neighborhood_id)")
def serving_cache(t):
    m = long_metrics(t)
    return places.serving_cache(m, places.score_places(m), [name for name, *_ in _METRICS])


_CITY = """city_values AS (SELECT city_id, year(deal_date) AS year, CAST(nullif(count(*) FILTER (WHERE ownership_fraction = 0.5), 0) AS DOUBLE) AS value FROM tx JOIN hoods ON home_id = hoods.neighborhood_id GROUP BY 1, 2),
  inherited AS (SELECT neighborhood_id, 'shared_sales' AS metric, value, year, 0.55::DOUBLE AS confidence, 'city_level_value' AS warning FROM hoods JOIN (SELECT city_id, arg_max(value, year) AS value, max(year) AS year FROM city_values WHERE value IS NOT NULL GROUP BY 1) USING (city_id))"""


@query(f"WITH {{B}}, {_CITY} SELECT * FROM inherited")
def municipal_inherit(t):
    shared = F.count_if(F.col("ownership_fraction") == 0.5)
    tx = t.transactions().select("home_id", "deal_date", "ownership_fraction").join(t.neighborhoods(), F.col("home_id") == F.col("neighborhood_id"))
    yearly = tx.groupBy("city_id", F.year("deal_date").alias("year")).agg(F.nullif(shared, F.lit(0)).cast("double").alias("value")).withColumn("metric", F.lit("shared_sales"))
    return places.municipal_inherit(yearly, t.neighborhoods())


_LINKS = f"""resolved AS ({sql_of('resolve_transactions')}), links AS (SELECT 'transactions' AS dataset, transaction_id AS record_id, place_id, method, confidence FROM resolved UNION ALL SELECT 'listings', listing_id, neighborhood_id, 'direct', 1.0::DOUBLE FROM listings
  UNION ALL SELECT 'projects', project_id, neighborhood_id, 'direct', 0.9::DOUBLE FROM projects UNION ALL SELECT 'areas', stat_area_id, neighborhood_id, 'crosswalk', coalesce(overlap_ratio, 0.5::DOUBLE) * confidence FROM xwalk)"""


def _links(t):
    tx = t.transactions()
    direct = lambda df, key, sure: df.select(F.col(key).alias("record_id"), F.col("neighborhood_id").alias("place_id"), F.lit("direct").alias("method"), F.lit(sure).alias("confidence"))
    areas = t.crosswalk().select(F.col("stat_area_id").alias("record_id"), F.col("neighborhood_id").alias("place_id"), F.lit("crosswalk").alias("method"), (F.coalesce("overlap_ratio", F.lit(0.5)) * F.col("confidence")).alias("confidence"))
    resolved = identity.resolve(tx, identity.parcel_evidence(tx)).withColumnRenamed("transaction_id", "record_id")
    return places.link_evidence({"transactions": resolved, "listings": direct(t.listings(), "listing_id", 1.0), "projects": direct(t.projects(), "project_id", 0.9), "areas": areas})


@query(f"WITH {{B}}, {_LINKS} SELECT * REPLACE (round(confidence, 6) AS confidence) FROM links")
def link_evidence(t):
    return _links(t).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {{B}}, {_LINKS} SELECT dataset, rows, linked, places, round(mean, 6) AS mean_confidence, CASE WHEN linked / rows >= 0.9 AND mean >= 0.9 THEN 'strong' WHEN linked / rows >= 0.5 AND mean >= 0.6 THEN 'usable' ELSE 'limited' END AS quality
  FROM (SELECT dataset, count(*) AS rows, count(place_id) AS linked, count(DISTINCT place_id) AS places, avg(confidence) AS mean FROM links GROUP BY 1)""")
def source_quality(t):
    return places.source_quality(_links(t))


@query("SELECT c_custkey AS parcel_id, count(transaction_id) AS transactions, max(deal_date) AS latest_deal FROM customer LEFT JOIN tx ON parcel_id = c_custkey GROUP BY 1")
def parcel_activity(t):
    return places.parcel_activity(t.raw("customer").select(F.col("c_custkey").alias("parcel_id")), t.transactions())


_SECTIONS = """sections AS (SELECT neighborhood_id, count(*) AS rows, max(deal_date) AS newest, 'transactions' AS section FROM tx WHERE neighborhood_id IS NOT NULL GROUP BY 1 UNION ALL SELECT neighborhood_id, count(*), CAST(max(last_seen) AS DATE), 'listings' FROM listings JOIN latest USING (listing_id) GROUP BY 1
  UNION ALL SELECT neighborhood_id, count(*), CAST(max(observed_at) AS DATE), 'rentals' FROM listings JOIN rents USING (listing_id) GROUP BY 1 UNION ALL SELECT neighborhood_id, count(*), NULL, 'supply' FROM projects GROUP BY 1 UNION ALL SELECT neighborhood_id, count(*), NULL, 'demographics' FROM xwalk GROUP BY 1)"""


@query(f"WITH {{B}}, {_SECTIONS} SELECT * FROM sections")
def place_dashboard(t):
    live = t.listings().select("listing_id", "neighborhood_id")
    seen = t.snapshots().groupBy("listing_id").agg(F.max("observed_at").alias("seen"))
    return places.sections({
        "transactions": (t.transactions(), F.col("deal_date")), "listings": (live.join(seen, "listing_id"), F.col("seen")), "rentals": (live.join(t.rents(), "listing_id"), F.col("observed_at")), "supply": (t.projects(), None), "demographics": (t.crosswalk(), None),
    })


@query(f"WITH {{B}}, {_SECTIONS} SELECT stat_area_id, section, CAST(sum(rows) AS BIGINT) AS rows, max(newest) AS newest, count(*) AS places, min(overlap_ratio) AS least_overlap FROM xwalk JOIN sections USING (neighborhood_id) GROUP BY 1, 2")
def area_dashboard(t):
    return places.area_sections(place_dashboard(t), t.crosswalk())


@query(f"""WITH {{B}}, {_CITY}, trend AS ({sql_of('place_trend')}), rent AS ({sql_of('rent_metrics')}), conf AS ({sql_of('market_confidence')})
  SELECT h.neighborhood_id, h.city_id, h.name, m0, change_1y, supply, median_rent, sample_count, conf.confidence, i.value AS city_value, i.year AS city_year
  FROM hoods h LEFT JOIN trend USING (neighborhood_id) LEFT JOIN rent USING (neighborhood_id) LEFT JOIN conf USING (neighborhood_id) LEFT JOIN inherited i USING (neighborhood_id)""")
def area_overview(t):
    return places.area_overview(t.neighborhoods(), market.place_trend(comps(t), TX_AS_OF), market.rent_metrics(t.rents(), t.listings()), market.market_confidence(comps(t), TX_AS_OF), municipal_inherit(t))


@query("""SELECT neighborhood_id, date_trunc('day', observed_at) - to_days(CAST(k AS INT)) AS start, count(*) AS n, round(avg(asking_price), 4) AS mean_price FROM snaps JOIN listings USING (listing_id), range(7) r(k) GROUP BY 1, 2""")
def sliding_stats(t):
    return lifecycle.sliding_stats(t.snapshots(), t.listings())
