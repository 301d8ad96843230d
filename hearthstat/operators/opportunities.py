"""Opportunity scores of listings and the wide research table they stand in."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthstat.functions.clean import clamp, discount_pct, median_of
from hearthstat.operators.market import since


@dataclass(frozen=True)
class ScoreConfig:
    """Fixed values of the default score."""

    version: str = "edge-v0.3"
    base: float = 50
    gap_weight: float = 1.5
    gap: tuple[float, float] = (-10, 25)
    project: float = 2
    execution: float = 5
    permit: float = 3
    renewal_max: float = 18
    days_divisor: float = 18
    reduction: float = 3
    seller_max: float = 14
    high: tuple[int, float] = (20, 10)
    medium: tuple[int, float] = (8, 7)
    least: int = 3
    low_score: float = 5
    risk: float = 4


def renewal_summary(projects: DataFrame) -> DataFrame:
    """Projects, those in execution and most permits of a place; expansion is the ratio of summed units."""
    return projects.groupBy("neighborhood_id").agg(
        F.count("*").alias("projects"), F.count_if("in_execution").alias("executing"), F.max("permits_count").alias("permits"),
        F.round(F.sum("planned_units") / F.nullif(F.sum("existing_units"), F.lit(0)), 6).alias("expansion"),
    )


def opportunity_score(asked: DataFrame, comps: DataFrame, renewal: DataFrame, signals: DataFrame, as_of: dt.date, cfg: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Scores of priced active listings whose place has enough sales of the last 18 months.

    ``asked`` holds listing_id, neighborhood_id, area_sqm, asking_price.  Unknown seller evidence adds nothing to the
    score, and ``seller_evidence`` says so.
    """
    recent = comps.filter((F.col("deal_date") >= since(as_of, 18)) & (F.col("deal_date") <= F.lit(as_of)) & F.col("neighborhood_id").isNotNull())
    base = recent.groupBy("neighborhood_id").agg(median_of(F.col("pp_sqm")).alias("comp_sqm"), F.count("*").alias("comp_count")).filter(F.col("comp_count") >= cfg.least)
    row = asked.filter((F.col("asking_price") > 0) & (F.col("area_sqm") > 0)).join(base, "neighborhood_id").join(renewal, "neighborhood_id", "left").join(signals.select("listing_id", "reductions", "supported_days"), "listing_id", "left")
    n, zero = F.col("comp_count"), lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    worth = F.col("area_sqm") * F.col("comp_sqm")
    row = row.withColumns({
        "discount_pct": discount_pct(F.col("asking_price"), worth),
        "renewal_score": F.least(F.lit(float(cfg.renewal_max)), zero("projects") * cfg.project + F.when(zero("executing") > 0, cfg.execution).otherwise(0) + F.when(zero("permits") > 0, cfg.permit).otherwise(0)),
        "seller_score": F.least(F.lit(float(cfg.seller_max)), zero("supported_days") / cfg.days_divisor + zero("reductions") * cfg.reduction),
        "comp_score": F.when(n >= cfg.high[0], cfg.high[1]).when(n >= cfg.medium[0], cfg.medium[1]).otherwise(cfg.low_score).cast("double"),
        "risk": F.when(n < cfg.medium[0], cfg.risk).otherwise(0).cast("double"),
        "seller_evidence": F.when(F.col("supported_days").isNotNull(), "supported").otherwise("unknown"),
    })
    row = row.withColumn("price_score", clamp(F.coalesce("discount_pct", F.lit(0.0)) * cfg.gap_weight, *map(float, cfg.gap)))
    total = F.col("price_score") + F.col("renewal_score") + F.col("seller_score") + F.col("comp_score") - F.col("risk") + cfg.base
    return row.select(
        "listing_id", F.round("discount_pct", 6).alias("discount_pct"), "comp_count", F.round("price_score", 6).alias("price_score"), "renewal_score", F.round("seller_score", 6).alias("seller_score"), "comp_score", "risk", "seller_evidence",
        F.greatest(F.lit(1), F.least(F.lit(99), F.floor(total + 0.5))).cast("int").alias("score"), F.lit(cfg.version).alias("model_version"))


def research_universe(listings: DataFrame, asked: DataFrame, signals: DataFrame, scores: DataFrame, renewal: DataFrame, hoods: DataFrame) -> DataFrame:
    """One wide row a listing; what is not known stays NULL, flags are never NULL."""
    prices = asked.select("listing_id", "asking_price")
    s = signals.select("listing_id", "reductions", "change_pct", "supported_days")
    out = listings.join(prices, "listing_id", "left").join(s, "listing_id", "left").join(scores.select("listing_id", "score", "discount_pct", "comp_count"), "listing_id", "left")
    out = out.join(hoods.select("neighborhood_id", "city_id"), "neighborhood_id", "left").join(renewal.select("neighborhood_id", "projects"), "neighborhood_id", "left")
    return out.select("listing_id", "city_id", "neighborhood_id", "status", "asking_price", "score", "discount_pct", "comp_count", "supported_days", "change_pct", F.coalesce(F.col("reductions") > 0, F.lit(False)).alias("price_dropped"), F.coalesce(F.col("projects") > 0, F.lit(False)).alias("has_renewal"))


def best(universe: DataFrame, k: int) -> DataFrame:
    """The report of the k best scored active listings."""
    return universe.filter("status = 'active' AND score IS NOT NULL").orderBy(F.col("score").desc(), F.col("discount_pct").desc_nulls_last(), "listing_id").limit(k)
