"""Records out of nested or free text: wrapped arrays, keys at any depth, repeated listing phrases, meta tags, rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed form of a listing in page text: price, street and number, rooms, floor, area.
PHRASE = r"₪\s*([0-9,]+)\s+([A-Za-z\p{IsHebrew} '.-]+?\s\d+)\s+([0-9.]+) rooms\s+floor (-?\d+)\s+([0-9]+) sqm"
_NUMBER = r'"\s*:\s*"?(-?[0-9][0-9,]*(?:\.[0-9]+)?)'


def unwrap_records(df: DataFrame, payload: str, keys: tuple[str, ...], record: str) -> DataFrame:
    """One row a record of the array under the first of several keys that holds one, or of a bare array."""
    wrapped = [F.from_json(F.get_json_object(payload, f"$.{k}"), f"array<{record}>") for k in keys]
    bare = F.when(F.ltrim(payload).startswith("["), F.from_json(payload, f"array<{record}>"))
    return df.select(*[c for c in df.columns if c != payload], F.inline(F.coalesce(bare, *wrapped)))


def deep_find(payload: Column, names: tuple[str, ...]) -> Column:
    """The first number under any of the names, at any depth of JSON text, in the order of the names."""
    one = lambda n: F.nullif(F.regexp_extract(payload, '"' + n + _NUMBER, 1), F.lit(""))
    return F.regexp_replace(F.coalesce(*[one(n) for n in names]), ",", "").try_cast("double")


def listing_phrases(pages: DataFrame, text: Column, price: tuple[float, float], area: tuple[float, float] = (15, 400)) -> DataFrame:
    """Listings that a page's text spells out, plausible ones only, once a page."""
    groups = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(PHRASE), F.lit(i)).alias(n) for i, n in enumerate(("price", "address", "rooms", "floor", "area"), 1)])
    rows = pages.select("page_id", F.explode(groups).alias("g")).select(
        "page_id", F.regexp_replace("g.price", ",", "").try_cast("double").alias("price"), F.trim("g.address").alias("address"), F.col("g.rooms").try_cast("double").alias("rooms"), F.col("g.floor").try_cast("int").alias("floor"), F.col("g.area").try_cast("double").alias("area_sqm"))
    return rows.filter(F.col("price").between(*price) & F.col("area_sqm").between(*area)).distinct()


def structured_meta(html: Column) -> Column:
    """Title, description, price and city of a page: meta tags first, then linked data, then text."""
    tag = lambda n: F.nullif(F.regexp_extract(html, rf'<meta[^>]*(?:property|name)="{n}"[^>]*content="([^"]*)"', 1), F.lit(""))
    data = F.regexp_extract(html, r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>', 1)
    text = F.regexp_replace(F.regexp_extract(html, r"₪\s*([0-9,]+)", 1), ",", "")
    return F.struct(
        F.coalesce(tag("og:title"), F.nullif(F.regexp_extract(html, "<title>([^<]*)</title>", 1), F.lit(""))).alias("title"), tag("(?:og:)?description").alias("description"),
        F.coalesce(deep_find(data, ("price", "lowPrice")), text.try_cast("double")).alias("price"), F.coalesce(F.get_json_object(data, "$.address.addressLocality"), tag("og:locality")).alias("city"))


def points_of_wkt(wkt: Column) -> Column:
    """The vertices (x, y) of the outer ring of POLYGON text, without the closing repeat; NULL for other text."""
    outer = F.regexp_extract(wkt, r"(?i)^\s*POLYGON\s*\(\s*\(([^)]*)\)", 1)
    pairs = F.transform(F.split(outer, ","), lambda p: F.split(F.trim(p), r"\s+"))
    ring = F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("double").alias("x"), F.get(p, F.lit(1)).try_cast("double").alias("y")))
    return F.when(outer != "", _open(ring))


def points_of_rings(rings: Column) -> Column:
    """The vertices of the first ring of JSON text ``[[[x, y], ...], ...]``."""
    first = F.get(F.from_json(rings, "array<array<array<double>>>"), F.lit(0))
    return _open(F.transform(first, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))


def _open(ring: Column) -> Column:
    closed = F.get(ring, F.lit(0)).eqNullSafe(F.element_at(ring, -1)) & (F.size(ring) > 1)
    return F.when(closed, F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(1)))).otherwise(ring)


def geojson(ring: Column) -> Column:
    """A polygon of an open ring as JSON text."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    return F.to_json(F.struct(F.array(F.transform(closed, lambda p: F.array(p["x"], p["y"]))).alias("coordinates"), F.lit("Polygon").alias("type")))


def snapshot_copy(df: DataFrame, key: str, volatile: tuple[str, ...]) -> DataFrame:
    """Rows of a table as JSON without the columns that change at every load, with a hash."""
    kept = sorted(c for c in df.columns if c not in volatile)
    payload = F.to_json(F.struct(*kept), {"ignoreNullFields": "false"})
    return df.select(F.col(key).cast("string").alias("row_key"), payload.alias("payload")).withColumn("row_hash", F.sha2("payload", 256))


def without_stale(mapped: DataFrame, current: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Mappings that current evidence still supports, and those it no longer does."""
    now = current.select(*keys).distinct()
    return mapped.join(now, keys, "left_semi"), mapped.join(now, keys, "left_anti")
