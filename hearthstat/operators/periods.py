"""Market periods of places: sales, asking prices and rents of a month, or of the last twelve, side by side.

Quantiles come from ``ranks``, so no task holds a place; keys of the three sides meet in full joins.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthstat.functions.clean import pct_change
from hearthstat.operators import ranks
from hearthstat.operators.market import since

#: Measures of each side and their rounding.
SOLD = {"median_price": ("amount", 0.5), "median_pp_sqm": ("pp_sqm", 0.5), "p25_pp_sqm": ("pp_sqm", 0.25), "p75_pp_sqm": ("pp_sqm", 0.75), "median_area": ("area_sqm", 0.5), "median_rooms": ("rooms", 0.5)}


def _positive(c: str) -> Column:
    return F.when(F.col(c) > 0, F.col(c))


def _sold(comps: DataFrame, keys: list[str], counts: dict[str, Column]) -> DataFrame:
    return ranks.quantiles(comps, keys, {n: (_positive(c), q) for n, (c, q) in SOLD.items()}, {"executed_count": F.lit(True)} | counts)


def _asked(last: DataFrame, keys: list[str], price: str, prefix: str, count: str) -> DataFrame:
    unit = F.when((F.col(price) > 0) & (F.col("area_sqm") > 0), F.col(price) / F.col("area_sqm"))
    return ranks.quantiles(last, keys, {f"median_{prefix}": (_positive(price), 0.5), f"median_{prefix}_sqm": (unit, 0.5)}, {count: F.lit(True)})


def _periods(sold: DataFrame, asked: DataFrame, rented: DataFrame, keys: list[str], full: int) -> DataFrame:
    both = sold.join(asked, keys, "full").join(rented, keys, "full")
    counts = ["executed_count", "listing_count", "rent_count", *(c for c in ("executed_count_3m",) if c in both.columns)]
    for c in counts:
        both = both.withColumn(c, F.coalesce(c, F.lit(0)))
    ask, unit = F.col("median_ask_sqm"), F.col("median_pp_sqm")
    return both.select(
        *keys, *counts, *[F.round(c, 4).alias(c) for c in [*SOLD, "median_ask", "median_ask_sqm", "median_rent", "median_rent_sqm"]],
        F.round(F.when((unit > 0) & (ask > 0), pct_change(ask, unit)), 6).alias("premium_pct"),
        F.round(F.least(F.col("executed_count") / full, F.lit(1.0)), 6).alias("transaction_confidence"), F.round(F.least(F.col("listing_count") / 10, F.lit(1.0)), 6).alias("listing_confidence"),
    )


def monthly(comps: DataFrame, snaps: DataFrame, rents: DataFrame, listings: DataFrame) -> DataFrame:
    """Per place and month: sales, and each listing's last asking price and rent seen in that month."""
    keys = ["neighborhood_id", "month"]
    sold = comps.filter("neighborhood_id IS NOT NULL AND deal_date IS NOT NULL").withColumn("month", F.trunc("deal_date", "MM"))
    homes = listings.filter("neighborhood_id IS NOT NULL").select("listing_id", "neighborhood_id", "area_sqm")
    last = lambda df, c: df.groupBy("listing_id", F.trunc("observed_at", "MM").alias("month")).agg(F.max_by(c, F.struct("observed_at", "sequence")).alias(c)).join(homes, "listing_id")
    return _periods(_sold(sold, keys, {}), _asked(last(snaps, "asking_price"), keys, "asking_price", "ask", "listing_count"), _asked(last(rents, "asking_rent"), keys, "asking_rent", "rent", "rent_count"), keys, 15)


def rolling(comps: DataFrame, snaps: DataFrame, rents: DataFrame, listings: DataFrame, as_of: dt.date) -> DataFrame:
    """Per place: twelve months of sales beside the active offers and rents of now, months of inventory and listings a sale."""
    keys, date = ["neighborhood_id"], F.col("deal_date")
    sold = comps.filter((date >= since(as_of, 12)) & (date <= F.lit(as_of)) & F.col("neighborhood_id").isNotNull())
    homes = listings.filter("status = 'active' AND neighborhood_id IS NOT NULL").select("listing_id", "neighborhood_id", "area_sqm")
    last = lambda df, c: df.groupBy("listing_id").agg(F.max_by(c, F.struct("observed_at", "sequence")).alias(c)).join(homes, "listing_id")
    p = _periods(_sold(sold, keys, {"executed_count_3m": date >= since(as_of, 3)}), _asked(last(snaps, "asking_price"), keys, "asking_price", "ask", "listing_count"), _asked(last(rents, "asking_rent"), keys, "asking_rent", "rent", "rent_count"), keys, 20)
    n = F.col("executed_count")
    return p.withColumn("inventory_months", F.round(F.when(n > 0, F.col("listing_count") / (n / 12)), 6)).withColumn("listing_ratio", F.round(F.when(n > 0, F.col("listing_count") / n), 6))
