"""Queries of opportunities, deals, crosswalks, cell geometry and file-shaped sources on the canonical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthstat.operators import deals, identity, lifecycle, market, opportunities, scenarios, spatial
from hearthstat.plans.bindings import TX_AS_OF
from hearthstat.plans.catalog import comps, query
from hearthstat.sources import files, pages

_RENEWAL = """renewal AS (SELECT neighborhood_id, count(*) AS projects, count(*) FILTER (WHERE in_execution) AS executing, max(permits_count) AS permits,
  round(sum(planned_units) / nullif(sum(existing_units), 0), 6) AS expansion FROM projects GROUP BY 1)"""


@query(f"WITH {{B}}, {_RENEWAL} SELECT * FROM renewal")
def renewal_summary(t):
    return opportunities.renewal_summary(t.projects())


_SCORES = f"""{_RENEWAL}, signals AS (SELECT listing_id, count(*) FILTER (WHERE asking_price < before) AS reductions, round(100 * (arg_max(asking_price, struct_pack(o := observed_at, s := sequence)) / arg_min(asking_price, struct_pack(o := observed_at, s := sequence)) - 1), 6) AS change_pct,
    CASE WHEN count(*) >= 2 AND floor(epoch(max(observed_at))) - floor(epoch(min(observed_at))) >= 86400 THEN CAST(floor((floor(epoch(max(observed_at))) - floor(epoch(min(observed_at)))) / 86400) AS BIGINT) END AS supported_days
    FROM (SELECT *, lag(asking_price) OVER (PARTITION BY listing_id ORDER BY observed_at, sequence) AS before FROM snaps) GROUP BY 1),
  base AS (SELECT neighborhood_id, quantile_cont(pp_sqm, 0.5) AS m, count(*) AS n FROM comps WHERE deal_date >= DATE '2000-02-02' AND deal_date <= DATE '2001-08-02' AND neighborhood_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 3),
  parts AS (SELECT l.listing_id, n, 100 * (area_sqm * m - asking_price) / (area_sqm * m) AS d, least(18.0::DOUBLE, coalesce(projects, 0) * 2.0::DOUBLE + CASE WHEN executing > 0 THEN 5 ELSE 0 END + CASE WHEN permits > 0 THEN 3 ELSE 0 END) AS r,
    least(14.0::DOUBLE, coalesce(supported_days, 0) / 18.0::DOUBLE + coalesce(reductions, 0) * 3.0::DOUBLE) AS s, CASE WHEN n >= 20 THEN 10.0::DOUBLE WHEN n >= 8 THEN 7.0::DOUBLE ELSE 5.0::DOUBLE END AS c, CASE WHEN n < 8 THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END AS k,
    CASE WHEN supported_days IS NOT NULL THEN 'supported' ELSE 'unknown' END AS e
    FROM listings l JOIN latest USING (listing_id) JOIN base USING (neighborhood_id) LEFT JOIN renewal USING (neighborhood_id) LEFT JOIN signals USING (listing_id) WHERE status = 'active' AND asking_price > 0 AND area_sqm > 0),
  scores AS (SELECT listing_id, round(d, 6) AS discount_pct, n AS comp_count, round(least(greatest(d * 1.5::DOUBLE, -10), 25), 6) AS price_score, r AS renewal_score, round(s, 6) AS seller_score, c AS comp_score, k AS risk, e AS seller_evidence,
    CAST(greatest(1, least(99, floor(least(greatest(d * 1.5::DOUBLE, -10), 25) + r + s + c - k + 50.5))) AS INT) AS score, 'edge-v0.3' AS model_version FROM parts)"""


def _asked(t, active: bool):
    listings = t.listings().filter("status = 'active'") if active else t.listings()
    return listings.join(market.latest(t.snapshots(), "asking_price"), "listing_id").select("listing_id", "neighborhood_id", "area_sqm", "asking_price")


@query(f"WITH {{B}}, {_SCORES} SELECT * FROM scores")
def opportunity_score(t):
    return opportunities.opportunity_score(_asked(t, True), comps(t), opportunities.renewal_summary(t.projects()), lifecycle.seller_signals(t.snapshots()), TX_AS_OF)


_UNIVERSE = f"""{_SCORES}, universe AS (SELECT l.listing_id, city_id, l.neighborhood_id, status, asking_price, score, discount_pct, comp_count, supported_days, change_pct, coalesce(reductions > 0, false) AS price_dropped, coalesce(projects > 0, false) AS has_renewal
  FROM listings l LEFT JOIN latest USING (listing_id) LEFT JOIN signals USING (listing_id) LEFT JOIN scores USING (listing_id) LEFT JOIN hoods h ON h.neighborhood_id = l.neighborhood_id LEFT JOIN renewal r ON r.neighborhood_id = l.neighborhood_id)"""


@query(f"WITH {{B}}, {_UNIVERSE} SELECT * FROM universe")
def research_universe(t):
    return opportunities.research_universe(t.listings(), _asked(t, False), lifecycle.seller_signals(t.snapshots()), opportunity_score(t), opportunities.renewal_summary(t.projects()), t.neighborhoods())


@query(f"WITH {{B}}, {_UNIVERSE} SELECT * FROM universe WHERE status = 'active' AND score IS NOT NULL ORDER BY score DESC, discount_pct DESC NULLS LAST, listing_id LIMIT 20")
def best_opportunities(t):
    return opportunities.best(research_universe(t), 20)


@query("""SELECT city_id, count(*) AS listings, count(*) FILTER (WHERE status = 'active') AS active FROM listings JOIN hoods USING (neighborhood_id) GROUP BY 1""")
def facets(t):
    return t.listings().join(t.neighborhoods(), "neighborhood_id").groupBy("city_id").agg(F.count("*").alias("listings"), F.count_if(F.col("status") == "active").alias("active"))


@query("""SELECT listing_id, min(missed) AS missing_cycles, min(missed) >= 3 AS inactive FROM (SELECT event_type AS scope, user_id AS listing_id, max(CAST(ts AS DATE)) AS cycle FROM events WHERE event_type <> 'signup' GROUP BY 1, 2)
  JOIN (SELECT scope, cycle, row_number() OVER (PARTITION BY scope ORDER BY cycle DESC) - 1 AS missed FROM (SELECT DISTINCT event_type AS scope, CAST(ts AS DATE) AS cycle FROM events)) USING (scope, cycle) GROUP BY 1""")
def missing_cycles(t):
    seen = t.raw("events").select(F.col("event_type").alias("scope"), F.col("user_id").alias("listing_id"), F.col("ts").cast("date").alias("cycle"))
    return lifecycle.missing_cycles(seen, seen.select("scope", "cycle"), seen.select("scope").distinct().filter("scope <> 'signup'"))


_OFFICIAL = """official AS (SELECT stat_area_id, neighborhood_id, CASE WHEN count(*) OVER w = 1 THEN 1.0::DOUBLE END AS overlap_ratio, 'official' AS mapping_method, CASE WHEN count(*) OVER w = 1 THEN 0.98::DOUBLE ELSE 0.85::DOUBLE END AS confidence
  FROM (SELECT s_suppkey AS stat_area_id, s_nationkey AS neighborhood_id FROM supplier UNION SELECT s_suppkey, b.n_nationkey FROM supplier JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = (s_nationkey + 5) % 25 AND a.n_regionkey = b.n_regionkey
    WHERE s_suppkey % 4 = 0) WINDOW w AS (PARTITION BY stat_area_id)),
  curated AS (SELECT s_suppkey AS stat_area_id, (s_nationkey + 5 * (s_suppkey % 2)) % 25 AS neighborhood_id, CASE WHEN s_suppkey % 5 = 0 THEN 1.0::DOUBLE END AS overlap_ratio, 'configured' AS mapping_method, 0.6::DOUBLE + (s_suppkey % 4) * 0.1::DOUBLE AS confidence
  FROM supplier WHERE s_suppkey % 3 <> 0)"""


def _official(t):
    s = t.raw("supplier").join(t.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    names = F.concat(F.upper("n_name"), F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("; 'Old' nation-"), ((F.col("n_nationkey") + 5) % 25).cast("string"))).otherwise(""))
    keys = s.select(F.col("n_regionkey").alias("city_id"), F.col("s_suppkey").alias("stat_area_id"), names.alias("names"))
    hoods = t.neighborhoods()
    return identity.official_crosswalk(keys, hoods, hoods.select("neighborhood_id", F.concat(F.lit("Old "), "name").alias("alias")))


def _curated(t):
    k = F.col("s_suppkey")
    return identity.curated_crosswalk(t.raw("supplier").select(
        k.alias("stat_area_id"), ((F.col("s_nationkey") + 5 * (k % 2)) % 25).alias("neighborhood_id"), (k % 3 != 0).alias("safe_for_identity"), (k % 5 == 0).alias("safe_for_analytics"), (0.6 + (k % 4) * 0.1).alias("confidence")))


@query(f"WITH {{B}}, {_OFFICIAL} SELECT * FROM official")
def official_crosswalk(t):
    return _official(t)


@query(f"""WITH {{B}}, {_OFFICIAL} SELECT stat_area_id, neighborhood_id, CASE WHEN o.mapping_method IS NOT NULL THEN o.overlap_ratio ELSE c.overlap_ratio END AS overlap_ratio, coalesce(o.mapping_method, c.mapping_method) AS mapping_method,
  greatest(o.confidence, c.confidence) AS confidence FROM official o FULL JOIN curated c USING (stat_area_id, neighborhood_id)""")
def curated_crosswalk(t):
    return identity.merge_crosswalks(_official(t).unionByName(_curated(t)), ["stat_area_id", "neighborhood_id"])


@query(f"""WITH {{B}}, {_OFFICIAL}, x AS (SELECT neighborhood_id, count(*) FILTER (WHERE o.confidence IS NOT NULL AND c.confidence IS NOT NULL) AS matched, count(*) FILTER (WHERE c.confidence IS NULL) AS only_first, count(*) FILTER (WHERE o.confidence IS NULL) AS only_second
  FROM official o FULL JOIN curated c USING (stat_area_id, neighborhood_id) GROUP BY 1) SELECT *, CASE WHEN only_first = 0 AND only_second = 0 THEN 'exact_match' WHEN matched = 0 AND (only_first = 0 OR only_second = 0) THEN 'one_sided' ELSE 'conflict' END AS result FROM x""")
def crosswalk_validation(t):
    return identity.crosswalk_validation(_official(t), _curated(t))


@query("""SELECT user_id AS entity_id, count(*) AS attempts, arg_min(event_id % 25, ts) FILTER (WHERE event_type = 'purchase') AS place_id, min(ts) FILTER (WHERE event_type = 'purchase') AS resolved_at, max(ts) AS last_attempt,
  CASE WHEN min(ts) FILTER (WHERE event_type = 'purchase') IS NOT NULL THEN 'resolved' ELSE 'pending' END AS state FROM events GROUP BY 1""")
def resolution_queue(t):
    return identity.resolution_queue(t.raw("events").select(F.col("user_id").alias("entity_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", F.col("event_id") % 25).alias("place_id")))


@query("""WITH {B}, p AS (SELECT s_suppkey % 60 AS street, s_suppkey % 7 AS house, min(struct_pack(r := s_suppkey % 2, p := s_suppkey)) AS m FROM supplier GROUP BY 1, 2)
  SELECT c_custkey AS listing_id, m.p AS project_id, CASE m.r WHEN 0 THEN 'verified' WHEN 1 THEN 'documented' ELSE 'unverified' END AS membership FROM customer LEFT JOIN p ON c_custkey % 70 = street AND c_custkey % 7 = house""")
def address_membership(t):
    at = lambda street, house: F.concat(F.lit("Elm St. "), street.cast("string"), F.lit(" no. "), F.chr(97 + house))
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    documented = t.raw("supplier").select(k.alias("project_id"), at(k % 60, k % 7).alias("address"), F.when(k % 2 == 0, "verified").otherwise("documented").alias("membership"))
    return identity.address_membership(t.raw("customer").select(c.alias("listing_id"), F.upper(at(c % 70, c % 7)).alias("address")), documented).select("listing_id", "project_id", "membership")


@query("""SELECT s_suppkey AS project_id, count(event_id) AS claims, count(event_id) FILTER (WHERE value >= 10) AS verified, CASE WHEN count(event_id) = 0 THEN 'insufficient' WHEN count(event_id) FILTER (WHERE value >= 10) < count(event_id) THEN 'provisional' ELSE 'supported' END AS state
  FROM supplier LEFT JOIN events ON user_id = s_suppkey * 2 GROUP BY 1""")
def claims_status(t):
    claims = t.raw("events").filter(F.col("user_id") % 2 == 0).select((F.col("user_id") / 2).cast("long").alias("project_id"), F.when(F.col("value") >= 10, "verified").otherwise("forecast").alias("evidence_status"))
    return identity.claims_status(t.projects(), claims)


@query("SELECT nature, count(*) AS rows, count(neighborhood_id) AS resolved, round(100 * count(neighborhood_id) / count(*), 4) AS rate_pct FROM tx GROUP BY 1")
def mapping_rates(t):
    return identity.mapping_rates(t.transactions(), "nature", "neighborhood_id")


_STAYS = """stays AS (SELECT deal_id, seq, stage, ts AS entered_at, lead(ts) OVER w AS left_at, CAST(floor(epoch(lead(ts) OVER w)) - floor(epoch(ts)) AS BIGINT) AS seconds FROM (SELECT user_id AS deal_id, event_id AS seq, ts, event_type AS stage,
  lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS DISTINCT FROM stage WINDOW w AS (PARTITION BY deal_id ORDER BY ts, seq))"""


def _stays(t):
    return deals.timeline(t.raw("events").select(F.col("user_id").alias("deal_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.col("event_type").alias("stage")))


@query(f"WITH {{B}}, {_STAYS} SELECT * FROM stays")
def deal_timeline(t):
    return _stays(t)


@query(f"WITH {{B}}, {_STAYS} SELECT stage, count(*) AS deals, sum(asking_price) AS asked FROM stays LEFT JOIN latest ON listing_id = deal_id WHERE left_at IS NULL AND stage <> 'error' GROUP BY 1")
def deal_pipeline(t):
    price = market.latest(t.snapshots(), "asking_price").select(F.col("listing_id").alias("deal_id"), F.col("asking_price").alias("price"))
    primary = t.listings().select(F.col("listing_id").alias("deal_id"), F.lit(4.5).alias("rate_pct"))
    return deals.stage_counts(deals.pipeline(_stays(t), price, primary, ("error",)))


@query("""SELECT deal_id, count(*) AS items, count(*) FILTER (WHERE e = 'purchase') AS verified, count(*) FILTER (WHERE e = 'error') AS issues, round(100 * count(*) FILTER (WHERE e = 'purchase') / count(*), 4) AS complete_pct
  FROM (SELECT user_id AS deal_id, event_id % 12 AS item, arg_max(event_type, ts) AS e FROM events GROUP BY 1, 2) WHERE e <> 'signup' GROUP BY 1""")
def deal_completeness(t):
    e = F.col("event_type")
    status = F.when(e == "purchase", "verified").when(e == "error", "issue").when(e == "signup", "not_applicable").otherwise("in_progress")
    return deals.completeness(t.raw("events").select(F.col("user_id").alias("deal_id"), (F.col("event_id") % 12).alias("item_key"), status.alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("seq")))


@query("""WITH {B}, s AS (SELECT listing_id, l / 100 AS l, (asking_price * 0.003::DOUBLE * 12) * 0.95::DOUBLE * 0.9::DOUBLE AS income, 4.5::DOUBLE / 1200 AS m, l AS loan_pct FROM latest, (SELECT unnest([0.0::DOUBLE, 50.0::DOUBLE, 70.0::DOUBLE]) AS l)),
  f AS (SELECT *, (1 - pow(1.08::DOUBLE, -10)) / 0.08::DOUBLE AS a, 1.06::DOUBLE - l + 12 * CASE WHEN l <= 0 THEN 0 ELSE l * m / (1 - pow(1 + m, -300)) END * (1 - pow(1.08::DOUBLE, -10)) / 0.08::DOUBLE
    - (pow(1.02::DOUBLE, 10) - CASE WHEN l <= 0 THEN 0 ELSE l * (pow(1 + m, 300) - pow(1 + m, 120)) / (pow(1 + m, 300) - 1) END) * pow(1.08::DOUBLE, -10) AS each FROM s)
  SELECT listing_id, loan_pct, round(CASE WHEN each > 0 AND income > 0 THEN income * a / each END, 2) AS max_price FROM f""")
def scenario_max_price(t):
    fixed = {"rate_pct": 4.5, "years": 25.0, "hold_years": 10.0, "vacancy_pct": 5.0, "cost_pct": 10.0, "growth_pct": 2.0, "acquisition_pct": 6.0, "target_pct": 8.0}
    s = market.latest(t.snapshots(), "asking_price").select("listing_id", (F.col("asking_price") * 0.003).alias("rent"), F.explode(F.array(*map(F.lit, (0.0, 50.0, 70.0)))).alias("loan_pct"))
    return scenarios.max_purchase_price(s.withColumns({k: F.lit(v) for k, v in fixed.items()})).select("listing_id", "loan_pct", F.round("max_price", 2).alias("max_price"))


def _box(x, y, name):
    p = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    return F.array(p(0, 0), p(0.2, 0), p(0.2, 0.2), p(0, 0.2)).alias(name)


@query("""WITH {B}, a AS (SELECT n_nationkey AS neighborhood_id, 20 * (n_nationkey % 5) AS x, 20 * (n_nationkey // 5) AS y FROM nation), b AS (SELECT s_suppkey AS stat_area_id, 10 * (s_suppkey % 8) AS x, 10 * (s_suppkey % 7) AS y FROM supplier),
  r AS (SELECT stat_area_id, neighborhood_id, greatest(0, least(a.x, b.x) + 20 - greatest(a.x, b.x)) * greatest(0, least(a.y, b.y) + 20 - greatest(a.y, b.y)) / 400.0::DOUBLE AS r FROM a, b)
  SELECT stat_area_id, neighborhood_id, round(r, 6) AS overlap_ratio, CASE WHEN r >= 0.8 THEN 0.95::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM r WHERE r >= 0.2""")
def overlap_ratio(t):
    n, s = F.col("n_nationkey"), F.col("s_suppkey")
    places = t.raw("nation").select(n.alias("neighborhood_id"), _box(34 + 0.2 * (n % 5), 31 + 0.2 * F.floor(n / 5), "ring"))
    areas = t.raw("supplier").select(s.alias("stat_area_id"), _box(34 + 0.1 * (s % 8), 31 + 0.1 * (s % 7), "ring"))
    return spatial.overlap_ratio(spatial.cells(areas, 0.02), spatial.cells(places, 0.02), "stat_area_id", "neighborhood_id")


@query("""WITH {B}, m AS (SELECT s_nationkey AS neighborhood_id, s_suppkey AS s, s_suppkey % 9 <> 0 AS safe FROM supplier), k AS (SELECT neighborhood_id FROM m GROUP BY 1 HAVING avg(safe::INT) >= 0.8)
  SELECT neighborhood_id, count(DISTINCT (x + dx) * 10000 + y + dy) AS cells FROM (SELECT neighborhood_id, 5 * (s % 8) AS x, 5 * (s % 7) AS y FROM m JOIN k USING (neighborhood_id)), range(10) a(dx), range(10) b(dy) GROUP BY 1""")
def dissolved_cells(t):
    s = F.col("s_suppkey")
    areas = t.raw("supplier").select(F.col("s_nationkey").alias("neighborhood_id"), s.alias("member"), (s % 9 != 0).alias("safe"), _box(34 + 0.1 * (s % 8), 31 + 0.1 * (s % 7), "ring"))
    return spatial.dissolve(spatial.cells(areas, 0.02), "neighborhood_id").groupBy("neighborhood_id").agg(F.count("*").alias("cells"))


_TILE = (9, 304, 208)
_WEST, _EAST, _NORTH, _SOUTH = spatial.tile_box(*_TILE)


@query(f"SELECT point_id, lon, lat FROM points WHERE lon >= {_WEST!r}::DOUBLE AND lon < {_EAST!r}::DOUBLE AND lat > {_SOUTH!r}::DOUBLE AND lat <= {_NORTH!r}::DOUBLE")
def map_tile_features(t):
    return spatial.tile_features(t.points(), *_TILE)


@query("""SELECT o_orderpriority || ':' || strftime(o_orderdate, '%Y-%m-%d') || '/' || o_orderkey AS row_key, o_orderpriority AS series, strftime(o_orderdate, '%Y-%m-%d') || '/' || o_orderkey AS period, o_totalprice AS value FROM orders WHERE year(o_orderdate) >= 2000""")
def sdmx_series(t):
    o = t.raw("orders").select(F.col("o_orderpriority").alias("SERIES_CODE"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("/"), F.col("o_orderkey").cast("string")).alias("TIME_PERIOD"), F.col("o_totalprice").cast("string").alias("OBS_VALUE"))
    return files.sdmx_series(o, 2000).drop("attributes")


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script>', ' ', 'gsi'), '<style\b.*?</style>', ' ', 'gsi'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs'), '[ \t\n\r]+', ' ', 'g')) AS text FROM pages""")
def page_text(t):
    return t.raw("pages").select("page_id", pages.page_text(F.col("html")).alias("text"))


@query("""SELECT page_id, href, count(*) AS times FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1, 2""")
def page_links(t):
    return pages.page_links(t.raw("pages"))
