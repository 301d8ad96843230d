"""Queries of names, streets, sibling parcels, rings and health on the canonical tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from hearthstat.functions import grid
from hearthstat.operators import identity, naming, quality, scenarios
from hearthstat.plans.bindings import LISTING_AS_OF
from hearthstat.plans.catalog import comps, query, sql_of
from hearthstat.plans.market_queries import _polygons


def _aliases(t):
    h = t.neighborhoods()
    return naming.build_aliases(h, h.select("neighborhood_id", F.concat(F.lit("Old "), F.col("name")).alias("source_name"), F.lit(0.8).alias("confidence")))


@query("SELECT n_regionkey AS city_id, n_nationkey AS neighborhood_id, p || regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS key, c AS confidence FROM nation, (VALUES ('', 1.0::DOUBLE), ('old', 0.8::DOUBLE)) v(p, c)")
def build_aliases(t):
    return _aliases(t)


@query("""SELECT c_custkey AS listing_id, CASE WHEN c_custkey % 10 = 0 THEN 99 WHEN c_custkey % 3 < 2 THEN c_nationkey END AS place_id, CASE WHEN c_custkey % 10 = 0 THEN 'earlier' WHEN c_custkey % 3 = 0 THEN 'name' WHEN c_custkey % 3 = 1 THEN 'alias' ELSE 'unresolved' END AS method FROM customer""")
def resolve_names(t):
    k = F.col("c_custkey")
    named = t.raw("customer").join(t.neighborhoods(), F.col("c_nationkey") == F.col("neighborhood_id")).select(
        k.alias("listing_id"), "city_id", F.when(k % 3 == 0, F.upper("name")).when(k % 3 == 1, F.concat(F.lit("'Old' "), F.col("name"))).otherwise("nowhere").alias("place_name"), F.when(k % 10 == 0, F.lit(99).cast("long")).alias("neighborhood_id"))
    return naming.resolve_names(named, _aliases(t), "listing_id")


@query("""SELECT c_custkey AS listing_id, place_id, CASE WHEN place_id IS NULL THEN NULL WHEN exact THEN 'street' ELSE 'part_of_street' END AS method, confidence FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY k ORDER BY NOT exact, confidence DESC, place_id) AS n FROM
  (SELECT c_custkey AS k, s_nationkey AS place_id, 0.6::DOUBLE + (s_suppkey % 4) * 0.1::DOUBLE AS confidence, c_custkey % 3 = 0 AND s_suppkey % 7 <> 0 AS exact FROM customer JOIN supplier ON c_custkey % 2 = s_suppkey % 2 AND c_custkey % 80 = s_suppkey % 100 AND c_custkey % 3 < 2 AND (s_suppkey % 7 <> 0 OR c_custkey % 3 = 0)))
  ON k = c_custkey AND n = 1""")
def resolve_streets(t):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    street = F.concat(F.lit("St"), (k % 80).cast("string"))
    at = F.when(k % 3 == 0, F.concat(street, F.lit(" 7b"))).when(k % 3 == 1, F.concat(F.lit("old "), street, F.lit(" road, 9"))).otherwise(F.concat(F.lit("lane"), (k % 80).cast("string")))
    rules = t.raw("supplier").select((s % 2).alias("city_id"), F.concat(F.lit("st"), (s % 100).cast("string"), F.when(s % 7 == 0, " North").otherwise("")).alias("street"), F.col("s_nationkey").alias("neighborhood_id"), (0.6 + (s % 4) * 0.1).alias("confidence"))
    return naming.resolve_streets(t.raw("customer").select(k.alias("listing_id"), (k % 2).alias("city_id"), at.alias("address")), rules, "listing_id")


@query("SELECT s_suppkey AS project_id, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS neighborhood_id FROM supplier")
def project_places(t):
    p = t.raw("supplier").join(t.neighborhoods(), F.col("s_nationkey") == F.col("neighborhood_id"))
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Renewal "), F.upper("name"), F.lit(" East"))).otherwise("Renewal")
    return naming.project_places(p.select(F.col("s_suppkey").alias("project_id"), "city_id", name.alias("project_name")), t.neighborhoods())


@query("SELECT s_suppkey AS project_id, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey WHEN s_suppkey % 3 = 1 THEN s_nationkey + 100 END AS neighborhood_id FROM supplier")
def project_streets(t):
    """Every third project names its place (and a street elsewhere), every third a street of its own."""
    k = F.col("s_suppkey")
    p = t.raw("supplier").join(t.neighborhoods(), F.col("s_nationkey") == F.col("neighborhood_id"))
    name = F.when(k % 3 == 0, F.concat(F.lit("Renewal at '"), F.upper("name"), F.lit("', Street"), F.col("s_nationkey").cast("string"), F.lit(" Road"))).when(k % 3 == 1, F.concat(F.lit("Complex street"), F.col("s_nationkey").cast("string"), F.lit(" road - B"))).otherwise("Renewal road")
    streets = t.neighborhoods().select("city_id", F.concat(F.lit("Street"), F.col("neighborhood_id").cast("string"), F.lit(" road 12")).alias("street"), (F.col("neighborhood_id") + 100).alias("neighborhood_id"))
    return naming.project_places(p.select(k.alias("project_id"), "city_id", name.alias("project_name")), t.neighborhoods(), streets)


@query("""WITH {B}, p AS (SELECT c_custkey AS parcel_id, c_custkey % 50 AS block, c_custkey % 7 AS parcel, CASE WHEN c_custkey % 3 > 0 THEN CAST(100 + CASE WHEN c_custkey % 7 = 3 THEN c_custkey ELSE c_custkey % 50 END AS DOUBLE) END AS a, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 50 % 25 END AS h FROM customer)
  SELECT parcel_id, coalesce(a, CASE WHEN min(a) OVER w = max(a) OVER w THEN min(a) OVER w END) AS area_sqm, coalesce(h, min(h) OVER w) AS neighborhood_id, a IS NULL AND coalesce(min(a) OVER w = max(a) OVER w, false) AS borrowed FROM p WINDOW w AS (PARTITION BY block, parcel)""")
def parcel_enrich(t):
    k = F.col("c_custkey")
    area = F.when(k % 3 > 0, (100 + F.when(k % 7 == 3, k).otherwise(k % 50)).cast("double"))
    return naming.parcel_enrich(t.raw("customer").select(k.alias("parcel_id"), (k % 50).alias("block"), (k % 7).alias("parcel"), area.alias("area_sqm"), F.when(k % 4 > 0, k % 50 % 25).alias("neighborhood_id"))).drop("block", "parcel")


@query("""SELECT transaction_id, coalesce(neighborhood_id, via) AS place_id FROM tx LEFT JOIN (SELECT parcel_id, min(neighborhood_id) AS via FROM tx GROUP BY 1 HAVING count(DISTINCT neighborhood_id) = 1) USING (parcel_id)""")
def inherit_place(t):
    tx = t.transactions().select("transaction_id", "parcel_id", "neighborhood_id")
    return naming.inherit_place(tx, tx.select("parcel_id", "neighborhood_id")).select("transaction_id", "place_id")


@query("""SELECT c_custkey AS listing_id, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey WHEN c_custkey % 3 = 0 THEN c_nationkey + 100 WHEN c_custkey % 2 = 0 THEN c_nationkey + 200 END AS place_id,
  CASE WHEN c_custkey % 4 = 0 THEN 'parcel' WHEN c_custkey % 3 = 0 THEN 'coordinates' WHEN c_custkey % 2 = 0 THEN 'name' ELSE 'unresolved' END AS method FROM customer""")
def resolve_external(t):
    c = t.raw("customer").select(F.col("c_custkey").alias("listing_id"), "c_nationkey")
    by = lambda k, more: c.filter(F.col("listing_id") % k == 0).select("listing_id", (F.col("c_nationkey") + more).alias("place_id"))
    return naming.resolve_external(c, by(4, 0), by(3, 100), by(2, 200), "listing_id")


@query("""SELECT n_nationkey AS neighborhood_id, CASE WHEN n_nationkey % 2 = 1 THEN 0.03::DOUBLE ELSE 0.04::DOUBLE END AS area, round(34 + 0.2 * (n_nationkey % 5) + CASE WHEN n_nationkey % 2 = 1 THEN 0.0025 / 0.03 ELSE 0.1 END, 5)::DOUBLE AS x,
  round(31 + 0.2 * (n_nationkey // 5) + CASE WHEN n_nationkey % 2 = 1 THEN 0.0025 / 0.03 ELSE 0.1 END, 5)::DOUBLE AS y FROM nation""")
def place_centroids(t):
    p = _polygons(t).filter(grid.is_valid_ring(F.col("ring"))).select("neighborhood_id", F.round(grid.ring_area(F.col("ring")), 6).alias("area"), grid.ring_centroid(F.col("ring")).alias("c"))
    return p.select("neighborhood_id", "area", F.round("c.x", 5).alias("x"), F.round("c.y", 5).alias("y"))


@query()
def grid_points(t):
    """Every other point comes in metres of the grid."""
    k = F.col("point_id")
    x = F.when(k % 2 == 0, F.col("lon")).otherwise(150_000 + (k * 7919 % 100_000))
    y = F.when(k % 2 == 0, F.col("lat")).otherwise(500_000 + (k * 104_729 % 250_000))
    return t.points().select("point_id", grid.as_degrees(x, y).alias("p")).select("point_id", F.round("p.lon", 7).alias("lon"), F.round("p.lat", 7).alias("lat"))


@query("""SELECT *, CASE WHEN last_run < TIMESTAMP '2024-01-29 00:00:00' THEN 'stale' WHEN last_status = 'failed' THEN 'down' WHEN failed_7d / nullif(runs_7d, 0) >= 0.2 THEN 'unstable' WHEN failed_7d > 0 THEN 'degraded' ELSE 'healthy' END AS health,
  CASE WHEN last_run < TIMESTAMP '2024-01-29 00:00:00' THEN 'no_run_in_48_hours' WHEN last_status = 'failed' THEN 'last_run_failed' WHEN failed_7d / nullif(runs_7d, 0) >= 0.2 THEN 'many_failures' WHEN failed_7d > 0 THEN 'some_failures' END AS reason FROM
  (SELECT user_id % 40 AS source_id, arg_max(CASE user_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' ELSE 'success' END, struct_pack(a := ts, b := event_id)) AS last_status, max(ts) AS last_run, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-24') AS runs_7d,
  count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-24' AND user_id % 5 = 0) AS failed_7d FROM events GROUP BY 1)""")
def provider_health(t):
    u = F.col("user_id")
    runs = t.raw("events").select((u % 40).alias("source_id"), F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), F.when(u % 5 == 0, "failed").when(u % 5 == 1, "partial").otherwise("success").alias("status"))
    return quality.provider_health(runs, LISTING_AS_OF, 0.2)


@query("""SELECT 'known place' AS "case", count(*) FILTER (WHERE neighborhood_id IS NULL) = 0 AS passed, count(*) FILTER (WHERE neighborhood_id IS NULL) AS violations, 2::BIGINT AS run_id, 2::BIGINT AS runs, CASE WHEN count(*) FILTER (WHERE neighborhood_id IS NULL) = 0 THEN 2 WHEN count(*) FILTER (WHERE neighborhood_id IS NULL AND deal_date < DATE '1990-01-01') = 0 THEN 1 END::BIGINT AS last_passed FROM tx
  UNION ALL SELECT 'dated', count(*) FILTER (WHERE deal_date IS NULL) = 0, count(*) FILTER (WHERE deal_date IS NULL), 2, 2, 2 FROM tx""")
def latest_evaluation(t):
    tx = t.transactions()
    cases = lambda df: quality.checks({"known place": (df, F.col("neighborhood_id").isNotNull()), "dated": (df, F.col("deal_date").isNotNull())})
    log = quality.append_evaluation(None, cases(tx.filter("deal_date < '1990-01-01'")), 1, dt.datetime(2024, 1, 1))
    return quality.latest_evaluation(quality.append_evaluation(log, cases(tx), 2, dt.datetime(2024, 1, 2)))


@query(f"""WITH {{B}}, c AS ({sql_of('entity_counts')}), l AS (SELECT 'transactions' AS entity, round(100 * count(neighborhood_id) / count(*), 4) AS rate_pct FROM tx UNION ALL SELECT 'comparables', 40.0 FROM (SELECT 1))
  SELECT entity, n, rate_pct, CASE WHEN n = 0 THEN 'empty' WHEN rate_pct < 50 THEN 'few_rows_linked' END AS warning FROM c LEFT JOIN l USING (entity)""")
def audit(t):
    counts = quality.entity_counts({"transactions": t.transactions(), "comparables": comps(t), "listings": t.listings(), "snapshots": t.snapshots()})
    rate = identity.mapping_rates(t.transactions().withColumn("entity", F.lit("transactions")), "entity", "neighborhood_id").select("entity", "rate_pct")
    return quality.audit(counts, rate.unionByName(t.spark.createDataFrame([("comparables", 40.0)], "entity string, rate_pct double")))


@query("""SELECT listing_id, unnest(list_filter([CASE WHEN listing_id % 5 = 0 THEN 'rent' END, CASE WHEN listing_id % 7 = 0 THEN 'loan_pct' END, CASE WHEN listing_id % 3 = 0 THEN 'years' END], lambda x: x IS NOT NULL)) AS rule FROM latest""")
def scenario_problems(t):
    k = F.col("listing_id")
    s = t.snapshots().groupBy("listing_id").agg(F.max_by("asking_price", "sequence").alias("price")).withColumns({
        "rent": F.when(k % 5 != 0, 4000.0), "loan_pct": F.when(k % 7 == 0, 120.0).otherwise(50.0), "years": F.when(k % 3 == 0, 0.0).otherwise(25.0), "rate_pct": F.lit(4.5), "hold_years": F.lit(10.0), "vacancy_pct": F.lit(5.0)})
    return scenarios.problems(s, ["listing_id"])
