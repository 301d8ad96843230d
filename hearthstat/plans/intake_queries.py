"""Queries of intake, records out of text and column functions on the canonical tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from hearthstat.functions import clean
from hearthstat.operators import intake, lifecycle
from hearthstat.plans.catalog import query
from hearthstat.sources import documents

_AS_OF = dt.date(2024, 1, 31)


@query("""SELECT event_id, floor((value + 50) * 2000)::DOUBLE AS price, year(ts) AS year, CASE WHEN event_id % 3 = 0 THEN 'item' WHEN event_id % 3 = 1 THEN 'search' ELSE 'unknown' END AS kind,
  CASE WHEN event_id % 4 = 0 THEN 'e' || event_id ELSE sha256(event_type || '|' || user_id) END AS source_key, CASE WHEN event_id % 120 > 100 THEN 1.0::DOUBLE WHEN event_id % 120 > 1 THEN (event_id % 120) / 100.0::DOUBLE ELSE (event_id % 120)::DOUBLE END AS confidence FROM events""")
def column_functions(t):
    k, at = F.col("event_id"), F.col("ts")
    price = F.concat(F.lit("price: "), F.format_number(F.floor((F.col("value") + 50) * 2000).cast("double"), 0), F.lit(" NIS"))
    date = F.when(k % 3 == 0, F.date_format(at, "d/M/yyyy")).when(k % 3 == 1, F.date_format(at, "yyyy")).otherwise(F.date_format(at, "yyyy-MM-dd"))
    link = F.when(k % 3 == 0, F.concat(F.lit("https://x.test/item/a"), k.cast("string"))).when(k % 3 == 1, "https://x.test/homes?page=2").otherwise("https://x.test/about")
    own = F.when(k % 4 == 0, F.concat(F.lit(" e"), k.cast("string"))).otherwise(" ")
    return t.raw("events").select(
        "event_id", clean.digits_number(price).alias("price"), clean.year_of(date).alias("year"), clean.url_kind(link).alias("kind"), clean.source_key(own, F.lit(""), F.col("event_type"), F.col("user_id")).alias("source_key"), clean.unit_confidence((k % 120).cast("double")).alias("confidence"))


_SIGNALS = """signals AS (SELECT listing_id, count(*) FILTER (WHERE asking_price < before) AS reductions, CASE WHEN count(*) >= 2 AND floor(epoch(max(observed_at))) - floor(epoch(min(observed_at))) >= 86400 THEN CAST(floor((floor(epoch(max(observed_at))) - floor(epoch(min(observed_at)))) / 86400) AS BIGINT) END AS days
  FROM (SELECT *, lag(asking_price) OVER (PARTITION BY listing_id ORDER BY observed_at, sequence) AS before FROM snaps) GROUP BY 1)"""


@query(f"""WITH {{B}}, {_SIGNALS} SELECT listing_id, CASE WHEN days IS NULL THEN 'unknown' WHEN reductions >= 2 OR (reductions >= 1 AND days >= 60) THEN 'high' WHEN reductions >= 1 OR days >= 90 THEN 'medium' ELSE 'low' END AS motivation FROM signals""")
def seller_motivation(t):
    return lifecycle.seller_signals(t.snapshots()).select("listing_id", clean.seller_motivation(F.col("supported_days"), F.col("reductions")).alias("motivation"))


@query("""WITH {B}, s AS (SELECT event_id AS source_listing_id, CAST(ts AS DATE) AS d, user_id, event_id % 5 = 0 AS broken, event_id % 3 AS city FROM events)
  SELECT source_listing_id, CASE WHEN broken THEN 'invalid' WHEN d >= DATE '2024-01-17' AND d <= DATE '2024-01-31' AND city < 2 THEN 'valid' ELSE 'excluded' END AS part FROM s""")
def partition_rows(t):
    published = F.when(F.col("event_id") % 5 == 0, F.date_format("ts", "yyyy-M-dd/")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    rows = t.raw("events").select(F.col("event_id").alias("source_listing_id"), published.alias("published"), (F.col("event_id") % 3).alias("city"))
    return intake.partition_rows(rows, clean.is_iso_date(F.col("published")), intake.recent_listing(F.col("published"), F.col("city"), _AS_OF, 14, [0, 1])).select("source_listing_id", "part")


@query("""SELECT event_id AS source_listing_id, CAST(ts AS DATE) AS published_at FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-24' AND DATE '2024-01-31' AND event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view')""")
def eligible_new(t):
    e = t.raw("events").select(F.col("event_id").alias("source_listing_id"), F.col("ts").cast("date").alias("published_at"), "event_type")
    return intake.eligible_new(e.drop("event_type"), e.filter("event_type = 'view'"), _AS_OF)


@query("""SELECT c_custkey AS listing_id, c_name AS name FROM customer WHERE c_nationkey = 3 AND c_acctbal >= 100 AND (lower(c_name) LIKE '%1%' OR lower(c_mktsegment) LIKE '%1%') AND c_custkey IN
  (SELECT listing_id FROM (SELECT *, lag(asking_price) OVER (PARTITION BY listing_id ORDER BY observed_at, sequence) AS b FROM snaps) WHERE asking_price < b)""")
def search_listings(t):
    drops = lifecycle.seller_signals(t.snapshots()).filter("reductions > 0")
    c = t.raw("customer").withColumnRenamed("c_custkey", "listing_id")
    return intake.search(c, {"c_nationkey": 3}, {"c_acctbal": (100, None)}, "1", ("c_name", "c_mktsegment"), drops).select("listing_id", F.col("c_name").alias("name"))


@query("""SELECT o_orderkey AS order_id, unnest(list_filter([CASE WHEN NOT coalesce(o_totalprice > 1000, false) THEN 'price_floor' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END, CASE WHEN o_orderstatus = 'F' AND o_orderdate >= DATE '2000-01-01' THEN 'done_too_late' END], lambda x: x IS NOT NULL)) AS rule FROM orders""")
def rule_violations(t):
    s = F.col("o_orderstatus")
    rules = {"price_floor": F.col("o_totalprice") > 1000, "status": s.isin("F", "O"), "done_too_late": (s != "F") | (F.col("o_orderdate") < F.lit(dt.date(2000, 1, 1)))}
    return intake.violations(t.raw("orders").withColumnRenamed("o_orderkey", "order_id"), "order_id", rules)


@query("""WITH {B}, d AS (SELECT user_id AS source_listing_id, arg_max(event_type, event_id) AS kind, arg_max(floor((value + 50) * 10000), event_id) AS price FROM events GROUP BY 1)
  SELECT c_custkey AS source_listing_id, CASE WHEN kind IS NULL THEN 'awaiting_detail' WHEN kind = 'error' THEN 'error' WHEN NOT price BETWEEN 300000 AND 15000000 THEN 'filtered' ELSE 'ready' END AS state,
  CASE WHEN kind IS NULL THEN 'no_detail' WHEN kind = 'error' THEN 'detail_failed' WHEN NOT price BETWEEN 300000 AND 15000000 THEN 'not_wanted' END AS reason FROM customer LEFT JOIN d ON c_custkey = source_listing_id""")
def staged_records(t):
    details = t.raw("events").select(F.col("user_id").alias("source_listing_id"), F.col("event_id").alias("at"), (F.col("event_type") == "error").alias("failed"), F.floor((F.col("value") + 50) * 10000).alias("price"), F.lit(80).alias("area"))
    return intake.stage(t.raw("customer").select(F.col("c_custkey").alias("source_listing_id")), details, intake.plausible("sale", F.col("price"), F.col("area"))).select("source_listing_id", "state", "reason")


@query("SELECT o_custkey AS source_id, o_orderkey AS id, o_totalprice AS amount FROM orders")
def unwrap_records(t):
    one = F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    o = t.raw("orders").select(F.col("o_custkey").alias("source_id"), F.when(F.col("o_orderkey") % 3 == 0, F.to_json(F.struct(F.array(one).alias("data")))).when(F.col("o_orderkey") % 3 == 1, F.to_json(F.struct(F.array(one).alias("results")))).otherwise(F.to_json(F.array(one))).alias("payload"))
    return documents.unwrap_records(o, "payload", ("data", "results"), "struct<id:bigint,amount:double>")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS found FROM orders")
def deep_find(t):
    k = F.col("o_orderkey")
    inner = F.when(k % 4 == 0, F.lit('{"other": 1}')).when(k % 4 == 1, F.format_string('{"a": [{"askPrice": "%,.2f"}]}', "o_totalprice")).otherwise(F.format_string('{"b": {"c": {"price": %.2f}}, "askPrice": null}', "o_totalprice"))
    return t.raw("orders").select(k.alias("id"), documents.deep_find(inner, ("price", "askPrice")).alias("found"))


@query("""SELECT DISTINCT o_custkey AS page_id, round(o_totalprice * 100) AS price, 'Elm ' || (o_orderkey % 40) AS address, (1 + o_orderkey % 5) + 0.5::DOUBLE AS rooms, CAST(o_orderkey % 12 AS INT) AS floor, CAST(10 + o_orderkey % 120 AS DOUBLE) AS area_sqm
  FROM orders WHERE round(o_totalprice * 100) BETWEEN 300000 AND 15000000 AND 10 + o_orderkey % 120 >= 15""")
def listing_phrases(t):
    k = F.col("o_orderkey")
    said = F.format_string("₪ %,.0f  Elm %d  %d.5 rooms floor %d %d sqm", F.round(F.col("o_totalprice") * 100), k % 40, 1 + k % 5, k % 12, 10 + k % 120)
    listed = t.raw("orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_join(F.collect_list(said), " <br> ").alias("text"))
    return documents.listing_phrases(listed, F.col("text"), (300_000, 15_000_000))


@query("""SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, length(html) AS price FROM pages""")
def structured_meta(t):
    tagged = F.concat(F.col("html"), F.lit('<script type="application/ld+json">{"offers": {"price": '), F.length("html").cast("string"), F.lit("}}</script>"))
    m = documents.structured_meta(tagged)
    return t.raw("pages").select("page_id", m["title"].alias("title"), m["price"].cast("long").alias("price"))


@query("SELECT s_suppkey AS id, CAST(4 AS INT) AS vertices, s_suppkey + 0.5::DOUBLE AS east, '{\"coordinates\":[[[' || s_suppkey || '.0,0.0],[' || s_suppkey || '.5,0.0],[' || s_suppkey || '.5,1.0],[' || s_suppkey || '.0,1.0],[' || s_suppkey || '.0,0.0]]],\"type\":\"Polygon\"}' AS geojson FROM supplier")
def polygon_text(t):
    k = F.col("s_suppkey").cast("int")
    wkt = F.format_string("POLYGON ((%d 0, %d.5 0, %d.5 1, %d 1, %d 0))", k, k, k, k, k)
    rings = F.format_string("[[[%d,0],[%d.5,0],[%d.5,1],[%d,1],[%d,0]]]", k, k, k, k, k)
    ring = F.when(k % 2 == 0, documents.points_of_wkt(wkt)).otherwise(documents.points_of_rings(rings))
    return t.raw("supplier").select(F.col("s_suppkey").alias("id"), ring.alias("ring")).select("id", F.size("ring").alias("vertices"), F.array_max(F.transform("ring", lambda p: p["x"])).alias("east"), documents.geojson(F.col("ring")).alias("geojson"))


@query("""SELECT 'kept' AS side, count(*) AS n FROM (SELECT DISTINCT parcel_id, home_id FROM tx WHERE deal_date < DATE '1999-01-01' INTERSECT SELECT parcel_id, home_id FROM tx WHERE deal_date >= DATE '1999-01-01')
  UNION ALL SELECT 'stale', count(*) FROM (SELECT DISTINCT parcel_id, home_id FROM tx WHERE deal_date < DATE '1999-01-01' EXCEPT SELECT parcel_id, home_id FROM tx WHERE deal_date >= DATE '1999-01-01')""")
def stale_mappings(t):
    tx, keys = t.transactions(), ["parcel_id", "home_id"]
    kept, stale = documents.without_stale(tx.filter("deal_date < '1999-01-01'").select(*keys).distinct(), tx.filter("deal_date >= '1999-01-01'"), keys)
    count = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count(kept, "kept").unionByName(count(stale, "stale"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS row_key, sha256('{"s_nationkey":' || s_nationkey || ',"s_suppkey":' || s_suppkey || '}') AS row_hash FROM supplier""")
def snapshot_copy(t):
    return documents.snapshot_copy(t.raw("supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_suppkey", ("s_acctbal",)).drop("payload")
