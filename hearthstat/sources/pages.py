"""Rows out of raw web pages, as column expressions over a table of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LISTING = "array<struct<id:string,price:string,rooms:string,area:string,city:string,published_at:string,promoted:boolean>>"


def page_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, white space collapsed."""
    for what in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        html = F.regexp_replace(html, what, " ")
    return F.trim(F.regexp_replace(html, "[ \\t\\n\\r]+", " "))


def page_links(pages: DataFrame) -> DataFrame:
    """Targets of each page's links and how often it names them."""
    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.explode(hrefs).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("times"))


def embedded_listings(pages: DataFrame, block: str = "listing-data") -> DataFrame:
    """Listings of the JSON block of a page, promoted ones left out; a page without a block gives a row with ``rejected``."""
    text = F.regexp_extract("html", rf'(?s)<script[^>]*id="{block}"[^>]*>(.*?)</script>', 1)
    rows = F.from_json(F.get_json_object(text, "$.feed"), LISTING)
    p = pages.select("page_id", rows.alias("rows"))
    listing = p.select("page_id", F.explode_outer("rows").alias("r"), F.col("rows").isNull().alias("rejected")).filter("rejected OR (r IS NOT NULL AND NOT coalesce(r.promoted, false))")
    number = lambda c: F.regexp_replace(F.col(c), r"[^0-9.]", "").try_cast("double")
    return listing.select("page_id", F.col("r.id").alias("source_listing_id"), number("r.price").alias("price"), number("r.rooms").alias("rooms"), number("r.area").alias("area_sqm"), F.col("r.city").alias("city"), F.try_to_date("r.published_at", "yyyy-MM-dd").alias("published_at"), "rejected")
