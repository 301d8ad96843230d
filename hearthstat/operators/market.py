"""Market measures: executed sales and asking prices, never mixed in one measure; samples stand beside every figure."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthstat.functions.clean import median_of, pct_change, sample_label


@dataclass(frozen=True)
class Bounds:
    area: tuple[float, float] = (15, 400)
    unit_price: tuple[float, float] = (5_000, 100_000)
    ownership: float = 0.9
    excluded: tuple[str, ...] = ()


def comparable_surface(tx: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """Dated whole-ownership sales with plausible area and unit price and a nature that is not excluded."""
    c = F.col
    return tx.filter(
        c("deal_date").isNotNull() & (c("amount") > 0) & c("area_sqm").between(*bounds.area) & c("pp_sqm").between(*bounds.unit_price)
        & (c("ownership_fraction").isNull() | (c("ownership_fraction") >= bounds.ownership)) & ~c("nature").isin(*bounds.excluded)
    )


def flag_comparable(tx: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """``exclusion_reason``, the first rule a sale breaks, and ``is_comparable``."""
    c = F.col
    reason = (
        F.when(c("ownership_fraction") < bounds.ownership, "partial_ownership")
        .when(c("nature").isin(*bounds.excluded), "non_residential")
        .when(~(c("area_sqm").between(*bounds.area) & c("pp_sqm").between(*bounds.unit_price)) | (c("amount") <= 0) | c("deal_date").isNull(), "implausible")
    )
    return tx.withColumn("exclusion_reason", reason).withColumn("is_comparable", F.col("exclusion_reason").isNull())


def since(as_of: dt.date, months: int) -> F.Column:
    return F.add_months(F.lit(as_of), -months)


def market_confidence(comps: DataFrame, as_of: dt.date) -> DataFrame:
    """Per place: twelve-month sample, median unit price, newest sale, label."""
    recent = comps.filter((F.col("deal_date") > since(as_of, 12)) & (F.col("deal_date") <= F.lit(as_of)) & F.col("neighborhood_id").isNotNull())
    return recent.groupBy("neighborhood_id").agg(
        F.count("*").alias("sample_count"), F.round(median_of(F.col("pp_sqm")), 4).alias("median_pp_sqm"), F.max("deal_date").alias("latest_deal")
    ).withColumn("confidence", sample_label(F.col("sample_count")))


def place_trend(comps: DataFrame, as_of: dt.date) -> DataFrame:
    """Median unit prices 0-12, 12-24 and 24-36 months back and the changes between them."""
    d = F.col("deal_date")
    window = lambda a, b: (d > since(as_of, b)) & (d <= since(as_of, a))
    m = comps.filter(F.col("neighborhood_id").isNotNull()).groupBy("neighborhood_id").agg(
        *[median_of(F.col("pp_sqm"), window(12 * k, 12 * k + 12)).alias(f"m{k}") for k in range(3)], *[F.count_if(window(12 * k, 12 * k + 12)).alias(f"n{k}") for k in range(3)]
    )
    r = lambda c: F.round(c, 4)
    return m.select("neighborhood_id", *[r(f"m{k}").alias(f"m{k}") for k in range(3)], "n0", "n1", "n2", r(pct_change(F.col("m0"), F.col("m1"))).alias("change_1y"), r(pct_change(F.col("m0"), F.col("m2"))).alias("change_2y"))


def city_market(comps: DataFrame, hoods: DataFrame, as_of: dt.date) -> DataFrame:
    recent = comps.filter((F.col("deal_date") > since(as_of, 12)) & (F.col("deal_date") <= F.lit(as_of)))
    return hoods.join(recent, "neighborhood_id", "left").groupBy("city_id").agg(
        F.count("transaction_id").alias("transactions"), F.round(median_of(F.col("amount")), 4).alias("median_price"), F.round(median_of(F.col("pp_sqm")), 4).alias("median_pp_sqm"))


def latest(snaps: DataFrame, value: str) -> DataFrame:
    """The newest value of each listing."""
    return snaps.groupBy("listing_id").agg(F.max_by(value, "sequence").alias(value))


def rent_metrics(rents: DataFrame, listings: DataFrame) -> DataFrame:
    r, rooms = F.col("asking_rent"), F.col("rooms")
    active = latest(rents, "asking_rent").join(listings.filter("status = 'active'"), "listing_id")
    return active.groupBy("neighborhood_id").agg(
        F.count("*").alias("supply"), F.round(median_of(r), 2).alias("median_rent"), F.round(median_of(r / F.col("area_sqm")), 4).alias("median_rent_sqm"), F.round(median_of(r, rooms == 3), 2).alias("median_rent_3_rooms"))


def gross_yield(snaps: DataFrame, rents: DataFrame, listings: DataFrame) -> DataFrame:
    """Twelve median rents over the median asking price; the sample is the smaller of both."""
    live = listings.filter("status = 'active'").select("listing_id", "neighborhood_id")
    both = live.join(latest(snaps, "asking_price"), "listing_id", "left").join(latest(rents, "asking_rent"), "listing_id", "left")
    m = both.groupBy("neighborhood_id").agg(median_of(F.col("asking_price")).alias("ask"), median_of(F.col("asking_rent")).alias("rent"), F.least(F.count("asking_price"), F.count("asking_rent")).alias("sample_count"))
    return m.select("neighborhood_id", F.round(F.when(F.col("ask") > 0, 1200 * F.col("rent") / F.col("ask")), 6).alias("gross_yield_pct"), "sample_count")


def census_profile(crosswalk: DataFrame) -> DataFrame:
    """Population-weighted means over a place's areas; an area without a measure leaves that measure's denominator."""
    w = F.col("population") * F.coalesce("overlap_ratio", F.lit(0.5))
    mean = lambda c: F.sum(w * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), w))
    return crosswalk.groupBy("neighborhood_id").agg(
        F.count("*").alias("areas"), F.sum("population").alias("population"), F.round(mean("employment_pct"), 6).alias("employment_pct"), F.round(mean("wage"), 4).alias("wage"),
        F.round(pct_change(F.sum("population_2024"), F.sum("population")), 6).alias("growth_pct"), F.round(F.avg("confidence"), 6).alias("confidence"),
    )
