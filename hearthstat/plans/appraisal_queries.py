"""Queries of what stands around each listing: similar offers and sales, markets, trends, contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthstat.operators import appraisal, comparables
from hearthstat.plans.bindings import LISTING_AS_OF, TX_AS_OF
from hearthstat.plans.catalog import comps, query, sql_of

_OFFERS = """offers AS (SELECT l.listing_id, neighborhood_id, area_sqm, rooms, floor, l.listing_id % 9 AS street, (l.listing_id // 9) % 30 AS house, l.listing_id % 7 AS row, asking_price, date_diff('day', CAST(first_seen AS DATE), DATE '2024-01-31') AS days
  FROM listings l LEFT JOIN latest USING (listing_id) WHERE status = 'active')"""
#: Sales of five years, equal ones once (fingerprint: place, date, amount, area, rooms, floor).
_SALES = """sales AS (SELECT * EXCLUDE (n), transaction_id % 9 AS street, (transaction_id // 9) % 30 AS house, transaction_id % 7 AS row FROM (SELECT *, row_number() OVER (PARTITION BY neighborhood_id, deal_date, amount, area_sqm, rooms, floor ORDER BY transaction_id) AS n
  FROM comps WHERE deal_date >= DATE '1996-08-02') WHERE n = 1 AND neighborhood_id IS NOT NULL)"""


def _address(key, form):
    """Addresses that normalise alike: a street of nine, a house of thirty."""
    street, house = F.chr(65 + key % 9), (1 + F.floor(key / 9) % 30).cast("string")
    return F.concat(F.lit("Street "), street, F.lit(" "), house) if form == "offer" else F.concat(F.lit("STREET-"), street, F.lit(", "), house)


def _offers(t):
    s = t.snapshots().groupBy("listing_id").agg(F.max_by("asking_price", "sequence").alias("asking_price"), F.min("observed_at").alias("first_seen"))
    days, key = F.datediff(F.lit(LISTING_AS_OF.date()), F.col("first_seen").cast("date")), F.col("listing_id")
    return t.listings().filter("status = 'active'").join(s, "listing_id", "left").select("listing_id", "neighborhood_id", "area_sqm", "rooms", "floor", _address(key, "offer").alias("address"), F.lit(34.8).alias("lon"), (32 + (key % 7) * 0.01).alias("lat"), "asking_price", days.alias("days"))


def _subjects(t):
    return appraisal.as_subjects(_offers(t)).join(_offers(t).select("listing_id", F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat"), "asking_price"), "listing_id")


def _sales(t):
    key = F.col("transaction_id")
    return comps(t).withColumn("address", _address(key, "sale")).withColumn("lon", F.lit(34.8)).withColumn("lat", 32 + (key % 7) * 0.01)


#: Parts of a similarity, each between 0 and 1, from a subject s and another row o.
_PART = {
    "area": "1 - abs(s.area_sqm - o.area_sqm) / greatest(s.area_sqm, 1)", "rooms": "1 - abs(s.rooms - o.rooms) / greatest(s.rooms, 1)",
    "floor": "1 - abs(s.floor - o.floor) / 10.0::DOUBLE", "recency": "exp(-greatest(0, date_diff('day', o.deal_date, DATE '2001-08-02')) / (365.0::DOUBLE * 3))",
}


def _similarity(score, **weights):
    """The weighted mean as SQL; a part with a NULL side counts on neither side of the ratio."""
    parts = {"relation": score} | {k: _PART[k] for k in weights if k != "relation"}
    top = " + ".join(f"CASE WHEN {parts[k]} IS NULL THEN 0 ELSE {w}::DOUBLE * greatest(0, {parts[k]}) END" for k, w in weights.items())
    return f"round(({top}) / ({' + '.join(f'CASE WHEN {parts[k]} IS NULL THEN 0 ELSE {w}::DOUBLE END' for k, w in weights.items())}), 12)"


def _relation(street, near=None):
    mid = f"WHEN abs(s.row - o.row) <= 1 THEN {near}::DOUBLE " if near else ""
    return f"CASE WHEN s.street = o.street AND s.house = o.house THEN 1.0::DOUBLE WHEN s.street = o.street THEN {street}::DOUBLE {mid}ELSE 0.68::DOUBLE END"


_NAMES = "CASE WHEN s.street = o.street AND s.house = o.house THEN 'same_building' WHEN s.street = o.street THEN 'same_street' {0}ELSE 'same_neighborhood' END"
_NEAR = "WHEN abs(s.row - o.row) <= 1 THEN 'nearby' "  # a hundredth of a degree of latitude is 1.11 km


@query("""SELECT min(transaction_id) AS transaction_id, neighborhood_id, deal_date, amount, area_sqm, rooms, floor, count(*) AS copies FROM (SELECT * FROM comps UNION ALL SELECT * REPLACE (transaction_id + 1000000000 AS transaction_id) FROM comps WHERE transaction_id % 3 = 0)
  GROUP BY neighborhood_id, deal_date, amount, area_sqm, rooms, floor""")
def sale_once(t):
    c = comps(t)
    return appraisal.sale_once(c.unionByName(c.filter("transaction_id % 3 = 0").withColumn("transaction_id", F.col("transaction_id") + 1000000000)))


@query(f"""WITH {{B}}, {_OFFERS}, o AS (SELECT *, transaction_id % 9 AS street, (transaction_id // 9) % 30 AS house, transaction_id % 7 AS row FROM comps)
  SELECT listing_id, relation, CASE relation WHEN 'same_building' THEN 1.0::DOUBLE WHEN 'same_street' THEN 0.92::DOUBLE WHEN 'nearby' THEN 0.82::DOUBLE WHEN 'same_neighborhood' THEN 0.68::DOUBLE END AS relation_score, count(*) AS n
  FROM (SELECT s.listing_id, {_NAMES.format(_NEAR)} AS relation FROM offers s JOIN o USING (neighborhood_id)) GROUP BY 1, 2""")
def address_relation(t):
    return comparables.relation_counts(_subjects(t), _sales(t))


_ACTIVE = f"""p AS (SELECT s.listing_id, o.listing_id AS other_id, {_NAMES.format('')} AS relation, {_similarity(_relation('0.9'), relation='0.25', area='0.40', rooms='0.25', floor='0.10')} AS similarity, o.asking_price, o.area_sqm, o.days
  FROM offers s JOIN offers o ON s.neighborhood_id = o.neighborhood_id AND s.listing_id <> o.listing_id WHERE o.area_sqm / s.area_sqm BETWEEN 0.75::DOUBLE AND 1.25::DOUBLE AND abs(o.rooms - s.rooms) <= 1 AND o.asking_price > 0),
  a AS (SELECT listing_id, other_id, row_number() OVER (PARTITION BY listing_id ORDER BY similarity DESC, other_id) AS rank, relation, similarity, asking_price, area_sqm, days FROM p WHERE similarity >= 0.55::DOUBLE)"""


@query(f"WITH {{B}}, {_OFFERS}, {_ACTIVE} SELECT * FROM a WHERE rank <= 20")
def similar_active(t):
    return appraisal.similar_active(_offers(t))


@query(f"""WITH {{B}}, {_OFFERS}, {_ACTIVE}, m AS (SELECT a.listing_id, count(*) AS n, avg(similarity) AS mean, quantile_cont(a.asking_price, 0.5) AS ask_mid, quantile_cont(a.asking_price / a.area_sqm, 0.5) AS unit_mid, quantile_cont(a.days, 0.5) AS days_mid,
  count(*) FILTER (WHERE a.asking_price <= o.asking_price) AS up_to FROM a JOIN offers o ON o.listing_id = a.listing_id WHERE rank <= 20 GROUP BY 1)
  SELECT o.listing_id, coalesce(n, 0) AS inventory, round(ask_mid, 2) AS median_ask, round(unit_mid, 4) AS median_ask_sqm, round(days_mid, 2) AS median_days, floor(100 * up_to / n * 10 + 0.5) / 10 AS percentile, floor(100 * (asking_price - ask_mid) / ask_mid * 100 + 0.5) / 100 AS delta_pct,
  CASE WHEN n >= 5 AND mean >= 0.7::DOUBLE THEN 'supported' WHEN n > 0 THEN 'provisional' ELSE 'insufficient_evidence' END AS status, CASE WHEN n > 0 THEN floor(least(0.82::DOUBLE, 0.18::DOUBLE + least(n, 10) * 0.055::DOUBLE + mean * 0.18::DOUBLE) * 1000 + 0.5) / 1000 END AS confidence
  FROM offers o LEFT JOIN m USING (listing_id)""")
def similar_market(t):
    return appraisal.similar_market(_offers(t), appraisal.similar_active(_offers(t)))


_REJECTED = """x AS (SELECT * REPLACE (CASE WHEN listing_id % 10 = 3 THEN NULL ELSE asking_price END AS asking_price, CASE WHEN listing_id % 10 = 4 THEN NULL ELSE area_sqm END AS area_sqm, CASE WHEN listing_id % 10 = 5 THEN NULL ELSE rooms END AS rooms) FROM offers),
  p AS (SELECT s.listing_id, o.listing_id AS other_id, abs(o.area_sqm - s.area_sqm) AS gap, concat_ws(',',
  CASE WHEN s.area_sqm > 0 THEN CASE WHEN o.area_sqm IS NULL THEN 'missing_area' WHEN o.area_sqm / s.area_sqm NOT BETWEEN 0.75::DOUBLE AND 1.25::DOUBLE THEN 'area_outside_25pct_band' END END,
  CASE WHEN s.rooms IS NOT NULL THEN CASE WHEN o.rooms IS NULL THEN 'missing_rooms' WHEN abs(o.rooms - s.rooms) > 1 THEN 'rooms_outside_1_room_band' END END, CASE WHEN o.asking_price IS NULL THEN 'missing_asking_price' END) AS reasons
  FROM x s JOIN x o ON s.neighborhood_id = o.neighborhood_id AND s.listing_id <> o.listing_id)"""


def _gappy(t):
    gap = lambda n, c: F.when(F.col("listing_id") % 10 != n, F.col(c)).alias(c)
    return _offers(t).select("listing_id", "neighborhood_id", gap(4, "area_sqm"), gap(5, "rooms"), "floor", "address", gap(3, "asking_price"), "days")


@query(f"WITH {{B}}, {_OFFERS}, {_REJECTED} SELECT * FROM (SELECT listing_id, other_id, row_number() OVER (PARTITION BY listing_id ORDER BY gap NULLS LAST, other_id) AS rank, reasons FROM p WHERE reasons <> '') WHERE rank <= 20")
def rejected_offers(t):
    return appraisal.rejected_offers(_gappy(t))


@query(f"WITH {{B}}, {_OFFERS}, {_REJECTED} SELECT listing_id, reasons, count(*) AS n FROM p WHERE reasons <> '' GROUP BY 1, 2")
def rejection_counts(t):
    return appraisal.rejection_counts(_gappy(t))


@query(f"""WITH {{B}}, {_OFFERS}, o AS (SELECT *, asking_price / area_sqm AS unit FROM offers WHERE asking_price > 0), m AS (SELECT neighborhood_id, count(*) AS inventory, quantile_cont(asking_price, 0.5) AS a, quantile_cont(unit, 0.5) AS u, quantile_cont(days, 0.5) AS d FROM o GROUP BY 1)
  SELECT listing_id, o.neighborhood_id, inventory, round(a, 2) AS median_ask, round(u, 4) AS median_ask_sqm, round(d, 2) AS median_days, round(100 * count(*) OVER (PARTITION BY o.neighborhood_id ORDER BY unit) / inventory, 6) AS percentile, round(100 * (unit / u - 1), 6) AS delta_pct
  FROM o JOIN m ON o.neighborhood_id = m.neighborhood_id""")
def active_market_summary(t):
    return appraisal.active_market_summary(_offers(t))


@query(f"""WITH {{B}}, {_OFFERS}, {_SALES}, p AS (SELECT s.listing_id, transaction_id, {_NAMES.format('')} AS relation, deal_date, pp_sqm, {_similarity(_relation('0.92'), relation='0.35', area='0.35', rooms='0.20', floor='0.10')} AS similarity
  FROM offers s JOIN sales o ON s.neighborhood_id = o.neighborhood_id WHERE o.area_sqm / s.area_sqm BETWEEN 0.75::DOUBLE AND 1.25::DOUBLE AND abs(o.rooms - s.rooms) <= 1)
  SELECT listing_id, transaction_id, rank, relation, similarity, deal_date, round(pp_sqm, 6) AS pp_sqm FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY similarity DESC, deal_date DESC, transaction_id) AS rank FROM p WHERE similarity >= 0.6::DOUBLE) WHERE rank <= 24""")
def historical_similar_sales(t):
    return appraisal.similar_sales(_offers(t), _sales(t), TX_AS_OF).withColumn("pp_sqm", F.round("pp_sqm", 6))


_VALUED = f"""q AS (SELECT s.listing_id, transaction_id, {_NAMES.format(_NEAR)} AS relation, s.area_sqm AS s_area, s.rooms AS s_rooms, o.deal_date, o.amount, o.pp_sqm, o.area_sqm, o.rooms, o.floor, {_similarity(_relation('0.92', '0.82'), relation='0.35', area='0.30', rooms='0.15', floor='0.05', recency='0.15')} AS similarity
  FROM offers s JOIN sales o ON s.neighborhood_id = o.neighborhood_id), r AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY similarity DESC, deal_date DESC, transaction_id) AS rank FROM q),
  v AS (SELECT *, similarity >= 0.55::DOUBLE AND rank <= 12 AS selected, count(*) FILTER (WHERE similarity >= 0.55::DOUBLE AND rank <= 12) OVER (PARTITION BY listing_id) AS n FROM r)"""


@query(f"""WITH {{B}}, {_OFFERS}, {_SALES}, {_VALUED} SELECT listing_id, transaction_id, rank, selected, relation, similarity, CASE WHEN selected THEN round(similarity * similarity, 4) ELSE 0 END AS weight,
  CASE WHEN selected THEN concat_ws(',', replace(relation, '_', ' '), CASE WHEN abs(s_area - area_sqm) / s_area <= 0.2::DOUBLE THEN 'similar area' END, CASE WHEN abs(s_rooms - rooms) <= 1 THEN 'similar room count' END) ELSE '' END AS selection_reasons,
  CASE WHEN similarity < 0.55::DOUBLE THEN 'similarity below selection threshold' ELSE '' END AS rejection_reasons FROM v WHERE rank <= n + 20""")
def valuation_rows(t):
    rows = comparables.valuation_rows(_subjects(t), _sales(t), TX_AS_OF)
    joined = [F.array_join(c, ",").alias(c) for c in ("selection_reasons", "rejection_reasons")]
    return rows.select("listing_id", "transaction_id", "rank", "selected", "relation", "similarity", "weight", *joined)


@query(f"""WITH {{B}}, {_OFFERS}, {_SALES}, {_VALUED}, g AS (SELECT listing_id, count(*) AS n, quantile_cont(pp_sqm, 0.25) AS p25, quantile_cont(pp_sqm, 0.5) AS p50, quantile_cont(pp_sqm, 0.75) AS p75, avg(similarity) AS mean,
  count(*) FILTER (WHERE relation IN ('same_building', 'same_street')) AS close, arg_min(deal_date, rank) AS observed_at FROM v WHERE selected GROUP BY 1)
  SELECT o.listing_id, coalesce(n, 0) AS sample_count, floor(p25 * area_sqm + 0.5) AS low, floor(p50 * area_sqm + 0.5) AS base, floor(p75 * area_sqm + 0.5) AS high, floor(p50 + 0.5) AS base_sqm, floor(100 * (p50 * area_sqm - asking_price) / (p50 * area_sqm) * 100 + 0.5) / 100 AS discount_pct,
  CASE WHEN n > 0 THEN floor(least(0.92::DOUBLE, least(n, 10) / 10.0::DOUBLE * 0.55::DOUBLE + mean * 0.25::DOUBLE + least(close, 3) * 0.04::DOUBLE) * 1000 + 0.5) / 1000 END AS confidence, CASE WHEN n >= 3 THEN 'supported' WHEN n > 0 THEN 'provisional' ELSE 'insufficient_evidence' END AS status, observed_at
  FROM offers o LEFT JOIN g USING (listing_id)""")
def valuation_range(t):
    s = _subjects(t)
    return comparables.valuation_range(s, comparables.valuation_rows(s, _sales(t), TX_AS_OF))


@query("""WITH {B}, m AS (SELECT neighborhood_id, date_trunc('month', deal_date)::DATE AS month, quantile_cont(pp_sqm, 0.5) AS m, count(*) AS n FROM comps WHERE neighborhood_id IS NOT NULL GROUP BY 1, 2)
  SELECT a.neighborhood_id, a.month, a.n AS sample_count, round(a.m, 4) AS median_pp_sqm, b.month AS past_month, round(100 * (a.m / b.m - 1), 4) AS change_12m_pct FROM m a ASOF LEFT JOIN m b ON a.neighborhood_id = b.neighborhood_id AND (a.month - INTERVAL 12 MONTH)::DATE >= b.month""")
def historical_trend(t):
    return appraisal.historical_trend(comps(t))


@query(f"""WITH {{B}}, {_OFFERS} SELECT listing_id, transaction_id, rank, deal_date, amount, strftime(deal_date, '%m/%Y') AS label FROM (SELECT s.listing_id, transaction_id, deal_date, amount, row_number() OVER (PARTITION BY s.listing_id ORDER BY deal_date DESC, transaction_id) AS rank
  FROM offers s JOIN comps c ON s.neighborhood_id = c.neighborhood_id WHERE c.area_sqm BETWEEN s.area_sqm * 0.8::DOUBLE AND s.area_sqm * 1.2::DOUBLE) WHERE rank <= 20""")
def basic_comparables(t):
    return appraisal.basic_comparables(_offers(t), comps(t))


_AREA = """area_rows AS (SELECT neighborhood_id, metric, round(m, 4) AS value, CASE WHEN n < 3 THEN 'provisional' ELSE 'supported' END AS status, least(n / "full", 1.0::DOUBLE) AS confidence, n AS sample_count, seen AS observed_at, source FROM
  (SELECT neighborhood_id, 'median_pp_sqm' AS metric, quantile_cont(pp_sqm, 0.5) AS m, count(*) AS n, max(deal_date) AS seen, 20 AS "full", 'transactions' AS source FROM comps WHERE deal_date > DATE '2000-08-02' AND deal_date <= DATE '2001-08-02' AND neighborhood_id IS NOT NULL GROUP BY 1
  UNION ALL SELECT neighborhood_id, 'median_rent', quantile_cont(asking_rent, 0.5), count(*), CAST(max(observed_at) AS DATE), 10, 'rents' FROM rents JOIN listings USING (listing_id) GROUP BY 1))"""
_PLANS = """plan_rows AS (SELECT neighborhood_id, metric, CAST(value AS DOUBLE) AS value, CASE WHEN n < 2 THEN 'provisional' ELSE 'supported' END AS status, 0.7::DOUBLE AS confidence, n AS sample_count, CAST(NULL AS DATE) AS observed_at, 'projects' AS source
  FROM (SELECT neighborhood_id, count(*) AS n, unnest(['projects', 'new_units', 'executing']) AS metric, unnest([count(*), CAST(sum(planned_units - existing_units) AS BIGINT), count(*) FILTER (WHERE in_execution)]) AS value FROM projects GROUP BY 1))"""


def _area(t):
    return appraisal.area_context(comps(t), t.rents().join(t.listings().select("listing_id", "neighborhood_id"), "listing_id"), TX_AS_OF)


@query(f"WITH {{B}}, {_AREA} SELECT * FROM area_rows")
def area_context(t):
    return _area(t)


@query(f"WITH {{B}}, {_PLANS} SELECT * FROM plan_rows")
def planning_context(t):
    return appraisal.planning_context(t.projects())


_COMBINED = f"""{_AREA}, {_PLANS}, known AS (SELECT neighborhood_id, CASE WHEN count(*) FILTER (WHERE status = 'provisional') > 0 THEN 'provisional' ELSE 'supported' END AS status, round(avg(confidence), 6) AS confidence, CAST(sum(sample_count) AS BIGINT) AS sample_count,
  max(observed_at) AS observed_at, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS metrics FROM (SELECT * FROM area_rows UNION ALL SELECT * FROM plan_rows) GROUP BY 1)"""


@query(f"WITH {{B}}, {_COMBINED} SELECT * FROM known")
def combine_evidence(t):
    return appraisal.combine_evidence(_area(t).unionByName(planning_context(t)), ["neighborhood_id"])


def asset_context(t):
    return appraisal.asset_context(t.listings().filter("status = 'active'"), valuation_range(t), active_market_summary(t), _area(t).unionByName(planning_context(t)))


def _asset_sql() -> str:
    """The valuation's and the market's own SQL beside the combined evidence."""
    return f"""WITH {{B}}, {_COMBINED}, value AS ({sql_of('valuation_range')}), market AS ({sql_of('active_market_summary')})
  SELECT l.listing_id, l.neighborhood_id, base, v.sample_count AS comp_count, inventory, percentile, coalesce(k.status, 'insufficient') AS status, k.confidence, metrics, sources
  FROM listings l LEFT JOIN value v ON v.listing_id = l.listing_id LEFT JOIN market m ON m.listing_id = l.listing_id LEFT JOIN known k ON k.neighborhood_id = l.neighborhood_id WHERE l.status = 'active'"""


asset_context = query(_asset_sql())(asset_context)
