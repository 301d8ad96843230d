"""Queries of the market, lifecycle, scoring, spatial, identity and scenario operators on the canonical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthstat.functions import clean
from hearthstat.operators import appraisal, identity, lifecycle, market, quality, scenarios, scoring, spatial
from hearthstat.plans.bindings import LISTING_AS_OF, TX_AS_OF
from hearthstat.plans.catalog import BOUNDS, comps, query
from hearthstat.sources import landing

@query("SELECT transaction_id, neighborhood_id, deal_date, amount, area_sqm, round(pp_sqm, 6) AS pp_sqm FROM comps")
def comparable_surface(t):
    return comps(t).select("transaction_id", "neighborhood_id", "deal_date", "amount", "area_sqm", F.round("pp_sqm", 6).alias("pp_sqm"))


@query("""SELECT transaction_id, r AS exclusion_reason, r IS NULL AS is_comparable FROM (SELECT transaction_id, CASE WHEN ownership_fraction < 0.9 THEN 'partial_ownership'
  WHEN nature = '4-NOT SPECIFIED' THEN 'non_residential' WHEN NOT (area_sqm BETWEEN 15 AND 400 AND pp_sqm BETWEEN 100 AND 20000) OR amount <= 0 OR deal_date IS NULL THEN 'implausible' END AS r FROM tx)""")
def flag_comparable(t):
    return market.flag_comparable(t.transactions(), BOUNDS).select("transaction_id", "exclusion_reason", "is_comparable")


@query("""SELECT neighborhood_id, count(*) AS sample_count, round(quantile_cont(pp_sqm, 0.5), 4) AS median_pp_sqm, max(deal_date) AS latest_deal,
  CASE WHEN count(*) >= 20 THEN 'high' WHEN count(*) >= 8 THEN 'medium' WHEN count(*) >= 3 THEN 'low' ELSE 'insufficient' END AS confidence
  FROM comps WHERE deal_date > DATE '2000-08-02' AND deal_date <= DATE '2001-08-02' AND neighborhood_id IS NOT NULL GROUP BY 1""")
def market_confidence(t):
    return market.market_confidence(comps(t), TX_AS_OF)


_TREND = ", ".join(f"quantile_cont(pp_sqm, 0.5) FILTER (WHERE deal_date > DATE '{2000 - k}-08-02' AND deal_date <= DATE '{2001 - k}-08-02') AS m{k}, count(*) FILTER (WHERE deal_date > DATE '{2000 - k}-08-02' AND deal_date <= DATE '{2001 - k}-08-02') AS n{k}" for k in range(3))


@query(f"""SELECT neighborhood_id, round(m0, 4) AS m0, round(m1, 4) AS m1, round(m2, 4) AS m2, n0, n1, n2, round(CASE WHEN m1 > 0 THEN 100 * (m0 / m1 - 1) END, 4) AS change_1y, round(CASE WHEN m2 > 0 THEN 100 * (m0 / m2 - 1) END, 4) AS change_2y
  FROM (SELECT neighborhood_id, {_TREND} FROM comps WHERE neighborhood_id IS NOT NULL GROUP BY 1)""")
def place_trend(t):
    return market.place_trend(comps(t), TX_AS_OF)


@query("""SELECT city_id, count(transaction_id) AS transactions, round(quantile_cont(amount, 0.5), 4) AS median_price, round(quantile_cont(pp_sqm, 0.5), 4) AS median_pp_sqm
  FROM hoods LEFT JOIN (SELECT * FROM comps WHERE deal_date > DATE '2000-08-02' AND deal_date <= DATE '2001-08-02') USING (neighborhood_id) GROUP BY 1""")
def city_market_12m(t):
    return market.city_market(comps(t), t.neighborhoods(), TX_AS_OF)


@query("""SELECT neighborhood_id, count(*) AS supply, round(quantile_cont(asking_rent, 0.5), 2) AS median_rent, round(quantile_cont(asking_rent / area_sqm, 0.5), 4) AS median_rent_sqm,
  round(quantile_cont(asking_rent, 0.5) FILTER (WHERE rooms = 3), 2) AS median_rent_3_rooms FROM latest_rent JOIN listings USING (listing_id) WHERE status = 'active' GROUP BY 1""")
def rent_metrics(t):
    return market.rent_metrics(t.rents(), t.listings())


@query("""SELECT neighborhood_id, round(CASE WHEN ask > 0 THEN 1200 * rent / ask END, 6) AS gross_yield_pct, sample_count FROM (SELECT neighborhood_id, quantile_cont(asking_price, 0.5) AS ask, quantile_cont(asking_rent, 0.5) AS rent,
  least(count(asking_price), count(asking_rent)) AS sample_count FROM listings LEFT JOIN latest USING (listing_id) LEFT JOIN latest_rent USING (listing_id) WHERE status = 'active' GROUP BY 1)""")
def gross_yield(t):
    return market.gross_yield(t.snapshots(), t.rents(), t.listings())


@query("""SELECT neighborhood_id, count(*) AS areas, CAST(sum(population) AS BIGINT) AS population, round(sum(w * employment_pct) / sum(w) FILTER (WHERE employment_pct IS NOT NULL), 6) AS employment_pct,
  round(sum(w * wage) / sum(w), 4) AS wage, round(100 * (sum(population_2024) / sum(population) - 1), 6) AS growth_pct, round(avg(confidence), 6) AS confidence
  FROM (SELECT *, population * coalesce(overlap_ratio, 0.5::DOUBLE) AS w FROM xwalk) GROUP BY 1""")
def census_profile(t):
    return market.census_profile(t.crosswalk())


@query("""SELECT listing_id, arg_min(asking_price, struct_pack(o := observed_at, s := sequence)) AS first_price, arg_max(asking_price, struct_pack(o := observed_at, s := sequence)) AS last_price,
  count(*) FILTER (WHERE asking_price < before) AS reductions, count(*) AS snapshots, round(100 * (arg_max(asking_price, struct_pack(o := observed_at, s := sequence)) / arg_min(asking_price, struct_pack(o := observed_at, s := sequence)) - 1), 6) AS change_pct,
  CASE WHEN count(*) >= 2 AND floor(epoch(max(observed_at))) - floor(epoch(min(observed_at))) >= 86400 THEN CAST(floor((floor(epoch(max(observed_at))) - floor(epoch(min(observed_at)))) / 86400) AS BIGINT) END AS supported_days
  FROM (SELECT *, lag(asking_price) OVER (PARTITION BY listing_id ORDER BY observed_at, sequence) AS before FROM snaps) GROUP BY 1""")
def listing_seller_signals(t):
    return lifecycle.seller_signals(t.snapshots())


@query("""SELECT listing_id, sequence, observed_at, change, old_price, asking_price AS new_price FROM (SELECT *, CASE WHEN n = 1 THEN 'created' WHEN status <> old_status THEN status WHEN asking_price < old_price THEN 'price_drop'
  WHEN asking_price > old_price THEN 'price_increase' END AS change FROM (SELECT *, row_number() OVER w AS n, lag(asking_price) OVER w AS old_price, lag(status) OVER w AS old_status FROM snaps
  WINDOW w AS (PARTITION BY listing_id ORDER BY observed_at, sequence))) WHERE change IS NOT NULL""")
def listing_changes(t):
    return lifecycle.listing_changes(t.snapshots())


@query("""SELECT listing_id, observed_at, sequence, asking_price, status FROM (SELECT *, lag(asking_price) OVER w AS p, lag(status) OVER w AS s, row_number() OVER w AS n FROM snaps WINDOW w AS (PARTITION BY listing_id ORDER BY observed_at, sequence))
  WHERE n = 1 OR p IS DISTINCT FROM asking_price OR s IS DISTINCT FROM status""")
def snapshot_on_change(t):
    return lifecycle.snapshot_on_change(t.snapshots())


@query("SELECT listing_id, last_seen, last_seen < TIMESTAMP '2024-01-29 00:00:00' AS inactive FROM latest")
def inactive_after(t):
    return lifecycle.inactive_after(t.snapshots(), LISTING_AS_OF)


@query("SELECT date_trunc('day', observed_at) AS start, count(*) AS n, max(asking_price) AS max_price FROM snaps GROUP BY 1")
def tumbling_counts(t):
    return lifecycle.tumbling_counts(t.snapshots()).withColumn("start", F.col("start").cast("timestamp"))


@query("""SELECT listing_id, min(observed_at) AS first_seen, max(observed_at) AS last_seen, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY listing_id ORDER BY observed_at, sequence) AS g FROM
  (SELECT *, CASE WHEN observed_at - lag(observed_at) OVER (PARTITION BY listing_id ORDER BY observed_at, sequence) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM snaps)) GROUP BY listing_id, g""")
def listing_sessions(t):
    return lifecycle.listing_sessions(t.snapshots())


def _runs(t):
    return t.raw("events").select(F.col("event_type").alias("source_id"), F.col("ts").alias("started_at"), F.when(F.col("user_id") % 5 == 0, "failed").when(F.col("user_id") % 5 == 1, "partial").otherwise("success").alias("status"))


@query("""SELECT *, CASE WHEN last_success IS NULL THEN 'never_run' WHEN last_failure > last_success THEN 'failed' WHEN last_success < TIMESTAMP '2024-01-29 00:00:00' THEN 'stale' ELSE 'healthy' END AS health FROM
  (SELECT event_type AS source_id, max(ts) FILTER (WHERE user_id % 5 > 1) AS last_success, max(ts) FILTER (WHERE user_id % 5 = 0) AS last_failure, count(*) FILTER (WHERE user_id % 5 = 0 AND ts > TIMESTAMP '2024-01-24 00:00:00') AS failures_7d FROM events GROUP BY 1)""")
def source_health(t):
    return quality.source_health(quality.source_freshness(_runs(t), LISTING_AS_OF), LISTING_AS_OF)


def _deals(t):
    """Asking prices against the place's executed median, as scores of 50 plus the discount."""
    base = comps(t).groupBy("neighborhood_id").agg(clean.median_of(F.col("pp_sqm")).alias("base"))
    last = t.snapshots().groupBy("listing_id").agg(F.max_by("asking_price", "sequence").alias("ask"), F.max("observed_at").alias("seen"))
    days = F.datediff(F.lit(LISTING_AS_OF.date()), F.col("seen").cast("date"))
    return t.listings().join(last, "listing_id").join(base, "neighborhood_id").join(t.neighborhoods(), "neighborhood_id").select(
        "listing_id", "neighborhood_id", "city_id", (50 + clean.clamp(clean.discount_pct(F.col("ask") / F.col("area_sqm"), F.col("base")), -50, 50)).alias("score"), clean.freshness_weight(days).alias("freshness"), ((1 + F.col("listing_id") % 3) / 4 + 0.4).alias("weight"))


_DEALS = """deals AS (SELECT listing_id, neighborhood_id, city_id, 50 + least(greatest(100 * (base - ask / area_sqm) / base, -50), 50) AS score,
  CASE WHEN d <= 7 THEN 1.0::DOUBLE WHEN d <= 14 THEN 0.9::DOUBLE WHEN d <= 30 THEN 0.75::DOUBLE WHEN d <= 60 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS freshness, least(greatest(CAST(1 + listing_id % 3 AS DOUBLE) / 4 + 0.4::DOUBLE, 0), 1) AS weight
  FROM (SELECT l.*, h.city_id, a.asking_price AS ask, base, date_diff('day', CAST(last_seen AS DATE), DATE '2024-01-31') AS d FROM listings l JOIN latest a USING (listing_id)
  JOIN (SELECT neighborhood_id, quantile_cont(pp_sqm, 0.5) AS base FROM comps GROUP BY 1) b USING (neighborhood_id) JOIN hoods h USING (neighborhood_id)))"""


@query(f"""WITH {{B}}, {_DEALS}, c AS (SELECT city_id, sum(score * freshness * weight) / sum(freshness * weight) AS prior FROM deals GROUP BY 1),
  p AS (SELECT city_id, neighborhood_id, sum(score * freshness * weight) / sum(freshness * weight) AS local, count(*) FILTER (WHERE freshness * weight > 0) AS n FROM deals GROUP BY 1, 2)
  SELECT neighborhood_id, n, round(local, 6) AS local, round(prior, 6) AS prior, round((n * local + 5 * prior) / (n + 5), 6) AS heat FROM p JOIN c USING (city_id)""")
def deal_heat(t):
    return scoring.deal_heat(_deals(t))


@query("""WITH {B}, x AS (SELECT h.neighborhood_id, city_id, quantile_cont(pp_sqm, 0.5) AS m FROM comps JOIN hoods h USING (neighborhood_id) GROUP BY 1, 2)
  SELECT neighborhood_id, city_id, round(m, 4) AS median_pp_sqm, round(100 * ((SELECT count(*) FROM x b WHERE b.m < a.m) + 0.5 * (SELECT count(*) FROM x b WHERE b.m = a.m)) / (SELECT count(*) FROM x), 6) AS percentile FROM x a""")
def place_percentiles(t):
    m = comps(t).filter(F.col("neighborhood_id").isNotNull()).groupBy("neighborhood_id").agg(clean.median_of(F.col("pp_sqm")).alias("m")).join(t.neighborhoods(), "neighborhood_id")
    return scoring.percentile_rank(m.withColumn("peers", F.lit(1)), "m", ["peers"]).select("neighborhood_id", "city_id", F.round("m", 4).alias("median_pp_sqm"), F.round("percentile", 6).alias("percentile"))


def _polygons(t):
    n = F.col("n_nationkey")
    x, y = F.lit(34.0) + 0.2 * (n % 5), F.lit(31.0) + 0.2 * F.floor(n / 5)
    p = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    square = F.array(p(0, 0), p(0.2, 0), p(0.2, 0.2), p(0, 0.2))
    corner = F.array(p(0, 0), p(0.2, 0), p(0.2, 0.1), p(0.1, 0.1), p(0.1, 0.2), p(0, 0.2))
    return t.raw("nation").select(n.alias("neighborhood_id"), F.when(n % 2 == 1, corner).otherwise(square).alias("ring"))


@query("""SELECT neighborhood_id, count(*) AS points FROM (SELECT n_nationkey AS neighborhood_id, p.lon - (34.0::DOUBLE + 0.2::DOUBLE * (n_nationkey % 5)) AS dx, p.lat - (31.0::DOUBLE + 0.2::DOUBLE * (n_nationkey // 5)) AS dy,
  n_nationkey % 2 = 1 AS l FROM points p, nation) WHERE dx > 1e-9 AND dy > 1e-9 AND dx < 0.2 - 1e-9 AND dy < 0.2 - 1e-9 AND (abs(dx - 0.1) > 1e-9 AND abs(dy - 0.1) > 1e-9) AND NOT (l AND dx > 0.1 AND dy > 0.1) GROUP BY 1""")
def points_in_places(t):
    inside = spatial.contained(t.points(), _polygons(t), 0.2)
    dx, dy = F.col("lon") - F.element_at("ring", 1)["x"], F.col("lat") - F.element_at("ring", 1)["y"]
    edge = lambda d: (F.abs(d) > 1e-9) & (F.abs(d - 0.1) > 1e-9) & (F.abs(d - 0.2) > 1e-9)  # noqa: E731  edges belong to neither side here
    return inside.filter(edge(dx) & edge(dy)).groupBy("neighborhood_id").agg(F.count("*").alias("points"))


_KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(a_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(a_lat)) * pow(sin(radians(a_lon - lon) / 2), 2))))"


@query(f"""WITH {{B}}, a AS (SELECT point_id AS anchor_id, lon AS a_lon, lat AS a_lat FROM points WHERE point_id % 50 = 0),
  d AS (SELECT point_id, anchor_id, {_KM} AS km FROM points, a) SELECT point_id, anchor_id, round(km, 6) AS km FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(km, 6), anchor_id) AS n FROM d WHERE km <= 5) WHERE n = 1""")
def nearest_anchor(t):
    anchors = t.points().filter(F.col("point_id") % 50 == 0).select(F.col("point_id").alias("anchor_id"), F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat"))
    return spatial.nearest(t.points(), anchors, 5.0)


@query("""SELECT event_type AS source_id, user_id AS external_id, sha256(props) AS hash, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS observations FROM events GROUP BY 1, 2, 3""")
def land_raw(t):
    e = t.raw("events").select(F.col("event_type").alias("source_id"), F.col("user_id").alias("external_id"), F.sha2("props", 256).alias("hash"), "ts")
    return landing.land_raw(e, ["source_id", "external_id"], "hash", "ts")


@query("""SELECT source_id, external_id, event_id, k FROM (SELECT event_type AS source_id, user_id AS external_id, event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_version(t):
    e = t.raw("events").select(F.col("event_type").alias("source_id"), F.col("user_id").alias("external_id"), "event_id", "ts", "props").withColumn("h", F.sha2("props", 256))
    newest = landing.latest_version(e, ["source_id", "external_id"], [F.col("ts").desc_nulls_last(), F.col("event_id").desc()], "h")
    return landing.typed_fields(newest, "props", {"k": "k"}).select("source_id", "external_id", "event_id", "k")


@query("""SELECT listing_id, asking_price, first_seen, n_snapshots FROM (SELECT coalesce(a.listing_id, b.listing_id) AS listing_id, coalesce(b.p, a.p) AS asking_price, coalesce(a.f, b.f) AS first_seen, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS n_snapshots FROM
  (SELECT listing_id, arg_max(asking_price, sequence) AS p, min(observed_at) AS f, count(*) AS n FROM snaps WHERE observed_at < TIMESTAMP '2024-01-16' GROUP BY 1) a FULL JOIN
  (SELECT listing_id, arg_max(asking_price, sequence) AS p, min(observed_at) AS f, count(*) AS n FROM snaps WHERE observed_at >= TIMESTAMP '2024-01-16' GROUP BY 1) b USING (listing_id))""")
def upsert_listings(t):
    half = lambda c: t.snapshots().filter(c).groupBy("listing_id").agg(F.max_by("asking_price", "sequence").alias("asking_price"), F.min("observed_at").alias("first_seen"), F.count("*").alias("n_snapshots"))
    policy = {"asking_price": "new_or_old", "first_seen": "old_or_new", "n_snapshots": "greatest"}
    return landing.upsert(half("observed_at < '2024-01-16'"), half("observed_at >= '2024-01-16'"), ["listing_id"], policy)


@query("SELECT event_id, ts, user_id FROM events WHERE (ts > TIMESTAMP '2024-01-10' OR (ts = TIMESTAMP '2024-01-10' AND event_id > 100)) AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 500")
def keyset_page(t):
    import datetime as dt

    return landing.keyset_scan(t.raw("events").select("event_id", "ts", "user_id"), "ts", "event_id", (dt.datetime(2024, 1, 10), 100), F.lit(dt.datetime(2024, 1, 20)), 500)


@query("""WITH {B}, p AS (SELECT parcel_id, neighborhood_id, count(DISTINCT transaction_id) AS sales FROM tx WHERE neighborhood_id IS NOT NULL GROUP BY 1, 2),
  b AS (SELECT *, CASE WHEN sales >= 5 THEN 0.98::DOUBLE WHEN sales >= 2 THEN 0.90::DOUBLE ELSE 0.72::DOUBLE END AS c FROM p)
  SELECT transaction_id, coalesce(tx.neighborhood_id, b.neighborhood_id) AS place_id, CASE WHEN tx.neighborhood_id IS NOT NULL THEN 'direct' WHEN b.neighborhood_id IS NOT NULL THEN 'parcel' ELSE 'unresolved' END AS method,
  CASE WHEN tx.neighborhood_id IS NOT NULL THEN 1.0::DOUBLE ELSE c END AS confidence FROM tx LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY c DESC, neighborhood_id) AS n FROM b) b
  ON tx.neighborhood_id IS NULL AND tx.parcel_id = b.parcel_id AND n = 1""")
def resolve_transactions(t):
    tx = t.transactions()
    return identity.resolve(tx, identity.parcel_evidence(tx))


@query("""SELECT stat_area_id, neighborhood_id, mapping_method, confidence FROM (SELECT *, row_number() OVER (PARTITION BY stat_area_id, neighborhood_id ORDER BY p) AS n, max(c) OVER (PARTITION BY stat_area_id, neighborhood_id) AS confidence FROM
  (SELECT stat_area_id, neighborhood_id, confidence AS c, CASE stat_area_id % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'official' WHEN 2 THEN 'configured' ELSE 'evidence' END AS mapping_method, stat_area_id % 4 AS p FROM xwalk
  UNION ALL SELECT stat_area_id, neighborhood_id, coalesce(overlap_ratio, 0.5::DOUBLE), 'overlap', 5 FROM xwalk)) WHERE n = 1""")
def merge_crosswalks(t):
    x = t.crosswalk()
    names = F.array(*map(F.lit, identity.PRECEDENCE))
    own = x.select("stat_area_id", "neighborhood_id", "confidence", F.get(names, (F.col("stat_area_id") % 4).cast("int")).alias("mapping_method"))
    over = x.select("stat_area_id", "neighborhood_id", F.coalesce("overlap_ratio", F.lit(0.5)).alias("confidence"), F.lit("overlap").alias("mapping_method"))
    return identity.merge_crosswalks(own.unionByName(over), ["stat_area_id", "neighborhood_id"]).select("stat_area_id", "neighborhood_id", "mapping_method", "confidence")


@query("""SELECT 's' || s_suppkey AS node, 'n' || s_nationkey AS ancestor, 1 AS depth FROM supplier UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1 FROM nation""")
def place_closure(t):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    up = t.raw("supplier").select(name("s", "s_suppkey").alias("child"), name("n", "s_nationkey").alias("parent")).union(t.raw("nation").select(name("n", "n_nationkey"), name("r", "n_regionkey")))
    return identity.closure(up)


def _scenarios(t):
    ask = t.snapshots().groupBy("listing_id").agg(F.max_by("asking_price", "sequence").alias("price"))
    grid = F.array(*[F.struct(F.lit(float(r)).alias("rate_pct"), F.lit(float(s)).alias("loan_pct")) for r in (3, 4.5, 6) for s in (0, 50, 70)])
    s = ask.withColumn("g", F.explode(grid)).select("listing_id", "price", "g.rate_pct", "g.loan_pct", (F.col("price") * 0.003).alias("rent"))
    fixed = {"years": 25.0, "hold_years": 10.0, "vacancy_pct": 5.0, "cost_pct": 10.0, "growth_pct": 2.0, "acquisition_pct": 6.0}
    return scenarios.cash_flow(s.withColumns({k: F.lit(v) for k, v in fixed.items()}))


@query("""WITH {B}, s AS (SELECT listing_id, asking_price AS price, r AS rate_pct, l AS loan_pct, asking_price * l / 100 AS loan, r / 1200 AS m, asking_price * 0.003::DOUBLE AS rent FROM latest,
  (SELECT unnest([3.0::DOUBLE, 4.5::DOUBLE, 6.0::DOUBLE]) AS r), (SELECT unnest([0.0::DOUBLE, 50.0::DOUBLE, 70.0::DOUBLE]) AS l)),
  f AS (SELECT *, price * 1.06::DOUBLE - loan AS equity, CASE WHEN loan <= 0 THEN 0 ELSE loan * m / (1 - pow(1 + m, -300)) END AS payment, 12 * rent * 0.95::DOUBLE * 0.9::DOUBLE AS noi,
  price * pow(1.02::DOUBLE, 10) - CASE WHEN loan <= 0 THEN 0 ELSE loan * (pow(1 + m, 300) - pow(1 + m, 120)) / (pow(1 + m, 300) - 1) END AS exit_equity FROM s)
  SELECT listing_id, rate_pct, loan_pct, round(payment, 4) AS payment, round(100 * noi / price, 6) AS net_yield_pct, round(100 * (noi - 12 * payment) / equity, 6) AS cash_on_cash_pct, round(exit_equity, 2) AS exit_equity,
  round(exit_equity + 10 * (noi - 12 * payment) - equity, 2) AS profit FROM f""")
def scenario_grid(t):
    r = lambda c, n: F.round(c, n).alias(c)
    return _scenarios(t).select("listing_id", "rate_pct", "loan_pct", r("payment", 4), r("net_yield_pct", 6), r("cash_on_cash_pct", 6), r("exit_equity", 2), r("profit", 2))


@query("""WITH {B}, s AS (SELECT listing_id, asking_price AS p, asking_price * (listing_id % 4) / 4 AS l0, 1.5::DOUBLE * (listing_id % 4) AS rate, 10 + listing_id % 21 AS term, asking_price * 0.004::DOUBLE AS rent, listing_id % 5 * 4 AS vac, 1 + listing_id % 12 AS hold, CASE WHEN listing_id % 3 = 0 THEN asking_price * 1.2::DOUBLE END AS given FROM latest),
  a AS (SELECT *, p + 15000 + p * 0.02::DOUBLE + 8000 AS total, least(l0, p + 15000 + p * 0.02::DOUBLE + 8000) AS loan, term * 12 AS months, rate / 1200 AS m, 12 * rent * (1 - vac / 100) AS er, 6000 + 2000 AS costs FROM s),
  b AS (SELECT *, CASE WHEN loan <= 0 THEN 0 WHEN m = 0 THEN loan / months ELSE loan * m / (1 - pow(1 + m, -months)) END AS pay, coalesce(given, p * pow(1.025::DOUBLE, hold)) AS value FROM a),
  d AS (SELECT *, er - costs AS noi, er - costs - 12 * pay AS cash, greatest(0, total - loan) AS eq, CASE WHEN loan <= 0 OR hold * 12 >= months THEN 0 WHEN m = 0 THEN loan * (1 - hold * 12 / months) ELSE greatest(0, loan * pow(1 + m, hold * 12) - pay * (pow(1 + m, hold * 12) - 1) / m) END AS owed FROM b),
  e AS (SELECT *, greatest(0, value - value * 0.015::DOUBLE - owed) AS ex FROM d)
  SELECT listing_id, floor(total + 0.5) AS total_cost, floor(eq + 0.5) AS equity, floor(pay + 0.5) AS monthly_debt, floor(er + 0.5) AS effective_rent, floor(100 * 12 * rent / p * 100 + 0.5) / 100 AS gross_yield_pct, floor(100 * noi / total * 100 + 0.5) / 100 AS net_yield_pct,
  floor(cash + 0.5) AS annual_cash, CASE WHEN eq > 0 THEN floor(100 * cash / eq * 100 + 0.5) / 100 END AS cash_on_cash_pct, floor(value + 0.5) AS exit_value, floor(owed + 0.5) AS owed_at_exit, floor(ex + 0.5) AS exit_equity, floor(ex + cash * hold - eq + 0.5) AS profit, floor((12 * pay + costs) / (12 * greatest(0.0001::DOUBLE, 1 - vac / 100)) + 0.5) AS break_even_rent FROM e""")
def deal_outputs(t):
    k = F.col("listing_id")
    s = t.snapshots().groupBy("listing_id").agg(F.max_by("asking_price", "sequence").alias("purchase_price")).withColumns({
        "loan_amount": F.col("purchase_price") * (k % 4) / 4, "interest_rate_pct": 1.5 * (k % 4), "loan_term_years": 10 + k % 21, "monthly_rent": F.col("purchase_price") * 0.004, "vacancy_pct": k % 5 * 4, "exit_years": 1 + k % 12,
        "exit_price": F.when(k % 3 == 0, F.col("purchase_price") * 1.2), "legal_fees": F.lit(15000), "purchase_tax": F.col("purchase_price") * 0.02, "renovation": F.lit(8000), "annual_maintenance": F.lit(6000), "annual_other_operating": F.lit(2000), "sale_costs_pct": F.lit(1.5)})
    names = "total_cost equity monthly_debt effective_rent gross_yield_pct net_yield_pct annual_cash cash_on_cash_pct exit_value owed_at_exit exit_equity profit break_even_rent".split()
    return scenarios.deal_outputs(s).select("listing_id", *names)


@query()
def scenario_irr(t):
    s = _scenarios(t)
    return s.select("listing_id", "rate_pct", "loan_pct", F.round(scenarios.irr("equity", F.col("noi") - 12 * F.col("payment"), "exit_equity", "hold_years"), 8).alias("irr"))


@query("SELECT 'transactions' AS entity, count(*) AS n FROM tx UNION ALL SELECT 'comparables', count(*) FROM comps UNION ALL SELECT 'listings', count(*) FROM listings UNION ALL SELECT 'snapshots', count(*) FROM snaps")
def entity_counts(t):
    return quality.entity_counts({"transactions": t.transactions(), "comparables": comps(t), "listings": t.listings(), "snapshots": t.snapshots()})


@query("""SELECT 'whole ownership' AS "case", count(*) AS rows, count(*) FILTER (WHERE NOT coalesce(ownership_fraction >= 0.9, true)) AS violations, count(*) FILTER (WHERE NOT coalesce(ownership_fraction >= 0.9, true)) = 0 AS passed FROM comps
  UNION ALL SELECT 'known place', count(*), count(*) FILTER (WHERE neighborhood_id IS NULL), count(*) FILTER (WHERE neighborhood_id IS NULL) = 0 FROM tx
  UNION ALL SELECT 'confidence in range', count(*), count(*) FILTER (WHERE NOT confidence BETWEEN 0 AND 1), count(*) FILTER (WHERE NOT confidence BETWEEN 0 AND 1) = 0 FROM xwalk""")
def evidence_checks(t):
    return quality.checks({
        "whole ownership": (comps(t), F.coalesce(F.col("ownership_fraction") >= 0.9, F.lit(True))), "known place": (t.transactions(), F.col("neighborhood_id").isNotNull()), "confidence in range": (t.crosswalk(), F.col("confidence").between(0, 1)),
    })


@query("SELECT neighborhood_id, count(*) AS n, round(quantile_cont(amount, 0.5), 4) AS median_amount FROM tx WHERE rooms >= 3 AND nature IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def structured_query(t):
    spec = {"filters": [{"field": "rooms", "op": "gte", "value": 3}, {"field": "nature", "op": "in", "value": ["1-URGENT", "2-HIGH"]}], "group_by": ["neighborhood_id"], "measures": [{"agg": "count", "as": "n"}, {"agg": "median", "field": "amount", "as": "median_amount"}]}
    return quality.structured_query(t.transactions(), spec).withColumn("median_amount", F.round("median_amount", 4))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_[a-z]+|fbclid|gclid)=[^&]*', '\1', 'g'), '[?&]+$', ''), '/$', '') AS url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def page_metadata(t):
    return t.raw("pages").select("page_id", clean.normalize_url(F.col("url")).alias("url"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
