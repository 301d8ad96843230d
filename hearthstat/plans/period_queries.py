"""Queries of market periods and of each offer's benchmarks."""

from __future__ import annotations

from hearthstat.operators import benchmarks, market, periods
from hearthstat.plans.bindings import TX_AS_OF
from hearthstat.plans.catalog import comps, query

_SOLD = """count(*) AS executed_count, quantile_cont(amount, 0.5) FILTER (WHERE amount > 0) AS median_price, quantile_cont(pp_sqm, 0.5) FILTER (WHERE pp_sqm > 0) AS median_pp_sqm, quantile_cont(pp_sqm, 0.25) FILTER (WHERE pp_sqm > 0) AS p25_pp_sqm,
  quantile_cont(pp_sqm, 0.75) FILTER (WHERE pp_sqm > 0) AS p75_pp_sqm, quantile_cont(area_sqm, 0.5) FILTER (WHERE area_sqm > 0) AS median_area, quantile_cont(CAST(rooms AS DOUBLE), 0.5) FILTER (WHERE rooms > 0) AS median_rooms"""
_ASKED = "count(*) AS {0}_count, quantile_cont({1}, 0.5) FILTER (WHERE {1} > 0) AS median_{2}, quantile_cont({1} / area_sqm, 0.5) FILTER (WHERE {1} > 0 AND area_sqm > 0) AS median_{2}_sqm"
_ROUNDED = ", ".join(f"round({c}, 4) AS {c}" for c in (*periods.SOLD, "median_ask", "median_ask_sqm", "median_rent", "median_rent_sqm"))
_SHARED = f"""coalesce(executed_count, 0) AS executed_count, coalesce(listing_count, 0) AS listing_count, coalesce(rent_count, 0) AS rent_count, {_ROUNDED},
  round(CASE WHEN median_pp_sqm > 0 AND median_ask_sqm > 0 THEN 100 * (median_ask_sqm / median_pp_sqm - 1) END, 6) AS premium_pct, round(least(1, coalesce(listing_count, 0) / 10), 6) AS listing_confidence"""


@query(f"""WITH {{B}}, x AS (SELECT neighborhood_id, CAST(date_trunc('month', deal_date) AS DATE) AS month, {_SOLD} FROM comps WHERE neighborhood_id IS NOT NULL GROUP BY 1, 2),
  sm AS (SELECT DISTINCT ON (listing_id, date_trunc('month', observed_at)) listing_id, CAST(date_trunc('month', observed_at) AS DATE) AS month, asking_price FROM snaps ORDER BY listing_id, date_trunc('month', observed_at), observed_at DESC, sequence DESC),
  rm AS (SELECT DISTINCT ON (listing_id, date_trunc('month', observed_at)) listing_id, CAST(date_trunc('month', observed_at) AS DATE) AS month, asking_rent FROM rents ORDER BY listing_id, date_trunc('month', observed_at), observed_at DESC, sequence DESC),
  s AS (SELECT neighborhood_id, month, {_ASKED.format('listing', 'asking_price', 'ask')} FROM sm JOIN listings USING (listing_id) GROUP BY 1, 2), r AS (SELECT neighborhood_id, month, {_ASKED.format('rent', 'asking_rent', 'rent')} FROM rm JOIN listings USING (listing_id) GROUP BY 1, 2),
  k AS (SELECT neighborhood_id, month FROM x UNION SELECT neighborhood_id, month FROM s UNION SELECT neighborhood_id, month FROM r)
  SELECT neighborhood_id, month, {_SHARED}, round(least(1, coalesce(executed_count, 0) / 15), 6) AS transaction_confidence FROM k LEFT JOIN x USING (neighborhood_id, month) LEFT JOIN s USING (neighborhood_id, month) LEFT JOIN r USING (neighborhood_id, month)""")
def market_periods_monthly(t):
    return periods.monthly(comps(t), t.snapshots(), t.rents(), t.listings())


@query(f"""WITH {{B}}, x AS (SELECT neighborhood_id, {_SOLD}, count(*) FILTER (WHERE deal_date >= DATE '2001-05-02') AS n3 FROM comps WHERE neighborhood_id IS NOT NULL AND deal_date >= DATE '2000-08-02' AND deal_date <= DATE '2001-08-02' GROUP BY 1),
  s AS (SELECT neighborhood_id, {_ASKED.format('listing', 'asking_price', 'ask')} FROM listings JOIN latest USING (listing_id) WHERE status = 'active' GROUP BY 1), r AS (SELECT neighborhood_id, {_ASKED.format('rent', 'asking_rent', 'rent')} FROM listings JOIN latest_rent USING (listing_id) WHERE status = 'active' GROUP BY 1),
  k AS (SELECT neighborhood_id FROM x UNION SELECT neighborhood_id FROM s UNION SELECT neighborhood_id FROM r)
  SELECT neighborhood_id, {_SHARED}, coalesce(n3, 0) AS executed_count_3m, round(least(1, coalesce(executed_count, 0) / 20), 6) AS transaction_confidence, round(coalesce(listing_count, 0) / (executed_count / 12), 6) AS inventory_months, round(coalesce(listing_count, 0) / executed_count, 6) AS listing_ratio
  FROM k LEFT JOIN x USING (neighborhood_id) LEFT JOIN s USING (neighborhood_id) LEFT JOIN r USING (neighborhood_id)""")
def market_periods_rolling(t):
    return periods.rolling(comps(t), t.snapshots(), t.rents(), t.listings(), TX_AS_OF)


_GAP = "CASE WHEN {0} > 0 AND unit > 0 THEN 100 * (unit / {0} - 1) END"
_FIRST = f"coalesce({', '.join(_GAP.format(c) for c in ('matched_median', 'executed_median', 'others_median'))})"


@query(f"""WITH {{B}}, life AS (SELECT listing_id, count(*) AS snapshot_count, (epoch(max(observed_at)) - epoch(min(observed_at))) / 86400 AS span, (array_agg(asking_price ORDER BY observed_at, sequence) FILTER (WHERE asking_price > 0))[1] AS first_price FROM snaps GROUP BY 1),
  x AS (SELECT l.listing_id, l.neighborhood_id, l.area_sqm AS s_area, l.rooms AS s_rooms, asking_price, CASE WHEN l.area_sqm > 0 THEN asking_price / l.area_sqm END AS unit FROM listings l JOIN latest USING (listing_id) WHERE status = 'active' AND asking_price > 0),
  h AS (SELECT x.listing_id, count(transaction_id) AS executed_n, quantile_cont(pp_sqm, 0.5) AS executed_median, count(transaction_id) FILTER (WHERE ok) AS matched_n, quantile_cont(pp_sqm, 0.5) FILTER (WHERE ok) AS matched_median,
    quantile_cont(pp_sqm, 0.5) FILTER (WHERE deal_date >= DATE '2001-02-02') AS recent_median, count(*) FILTER (WHERE pp_sqm <= unit) AS below FROM x
    LEFT JOIN (SELECT x.listing_id, c.*, (s_rooms IS NULL OR c.rooms IS NULL OR c.rooms BETWEEN s_rooms - 0.5 AND s_rooms + 0.5) AND (s_area IS NULL OR c.area_sqm BETWEEN s_area * 0.8::DOUBLE AND s_area * 1.2::DOUBLE) AS ok FROM x JOIN comps c USING (neighborhood_id)
      WHERE deal_date >= DATE '2000-08-02' AND deal_date <= DATE '2001-08-02') c ON c.listing_id = x.listing_id GROUP BY 1),
  a AS (SELECT x.listing_id, count(o.listing_id) AS others, quantile_cont(o.unit, 0.5) AS others_median FROM x LEFT JOIN x o ON o.neighborhood_id = x.neighborhood_id AND o.listing_id <> x.listing_id GROUP BY 1),
  w AS (SELECT neighborhood_id, round(100 * (quantile_cont(pp_sqm, 0.5) FILTER (WHERE deal_date > DATE '2000-08-02') / quantile_cont(pp_sqm, 0.5) FILTER (WHERE deal_date <= DATE '2000-08-02') - 1), 4) AS change_1y FROM comps WHERE deal_date > DATE '1999-08-02' AND deal_date <= DATE '2001-08-02' GROUP BY 1),
  j AS (SELECT *, span >= 1 AND snapshot_count >= 2 AS seen, coalesce(recent_median, matched_median, executed_median) AS adjusted, round(least(1, CASE WHEN matched_n >= 5 THEN 0.55::DOUBLE WHEN executed_n >= 8 THEN 0.35::DOUBLE WHEN executed_n >= 3 THEN 0.2::DOUBLE ELSE 0.05::DOUBLE END
    + CASE WHEN others >= 5 THEN 0.25::DOUBLE WHEN others >= 2 THEN 0.15::DOUBLE ELSE 0.05::DOUBLE END + CASE WHEN unit > 0 THEN 0.2::DOUBLE ELSE 0 END), 6) AS confidence FROM x JOIN life USING (listing_id) JOIN h USING (listing_id) JOIN a USING (listing_id) LEFT JOIN w USING (neighborhood_id))
  SELECT listing_id, neighborhood_id, asking_price, round(unit, 4) AS asking_sqm, snapshot_count, CASE WHEN seen THEN floor(span) END AS days_on_market, CASE WHEN seen THEN first_price END AS first_price, round(CASE WHEN seen AND first_price > 0 THEN 100 * (asking_price / first_price - 1) END, 6) AS change_since_first_pct,
  executed_n, matched_n, others, round(executed_median, 4) AS executed_median, round(matched_median, 4) AS matched_median, round(recent_median, 4) AS recent_median, round(others_median, 4) AS others_median, round({_GAP.format('executed_median')}, 6) AS executed_discount_pct,
  round({_GAP.format('matched_median')}, 6) AS matched_discount_pct, round({_GAP.format('others_median')}, 6) AS others_discount_pct, round({_GAP.format('adjusted')}, 6) AS adjusted_discount_pct, round(adjusted, 4) AS adjusted_median, change_1y,
  round(CASE WHEN executed_n > 0 THEN 100 * below / executed_n END, 6) AS executed_percentile, confidence, CASE WHEN confidence < 0.5::DOUBLE THEN 'insufficient' WHEN {_FIRST} <= -10 THEN 'discount' WHEN {_FIRST} >= 10 THEN 'premium' ELSE 'neutral' END AS signal,
  CASE WHEN matched_n >= 5 THEN 'matched_rooms_area_12m' WHEN executed_n >= 8 THEN 'neighborhood_12m' ELSE 'limited_neighborhood_evidence' END AS method, CASE WHEN seen THEN 'supported' ELSE 'provisional' END AS lifecycle_status FROM j""")
def listing_benchmarks(t):
    return benchmarks.listing_benchmarks(t.listings(), t.snapshots(), comps(t), market.place_trend(comps(t), TX_AS_OF), TX_AS_OF)
