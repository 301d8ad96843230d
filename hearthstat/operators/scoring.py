"""Scores: freshness-weighted deals, shrinkage to a prior, coverage-gated composites, mid-rank percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthstat.functions.clean import clamp

#: Fixed weights of the composite place score; they add up to 100.
WEIGHTS = {"deal": 25.0, "market": 15.0, "renewal": 20.0, "demographics": 15.0, "rental": 10.0, "infrastructure": 10.0, "supply": 5.0}


def bayesian_adjust(local: Column, n: Column, prior: Column, k: float = 5.0) -> Column:
    """A local mean drawn to the prior with the strength of ``k`` observations; either alone stands for itself."""
    return F.when(local.isNull(), prior).when(prior.isNull(), local).otherwise((n * local + k * prior) / (n + k))


def weighted_deals(deals: DataFrame, keys: list[str]) -> DataFrame:
    """``score`` (held between 0 and 100) weighted by ``freshness`` and ``weight`` (0 to 1); NULL when no deal weighs."""
    w = F.col("freshness") * clamp(F.col("weight"), 0.0, 1.0)
    return deals.groupBy(*keys).agg(F.when(F.sum(w) > 0, F.sum(clamp(F.col("score"), 0.0, 100.0) * w) / F.sum(w)).alias("local"), F.count_if(w > 0).alias("n"))


def deal_heat(deals: DataFrame, k: float = 5.0) -> DataFrame:
    """Places drawn to their city's weighted mean."""
    city = weighted_deals(deals, ["city_id"]).select("city_id", F.col("local").alias("prior"))
    place = weighted_deals(deals, ["city_id", "neighborhood_id"])
    return place.join(city, "city_id").select("neighborhood_id", "n", F.round("local", 6).alias("local"), F.round("prior", 6).alias("prior"), F.round(bayesian_adjust(F.col("local"), F.col("n"), F.col("prior"), k), 6).alias("heat"))


def percentile_rank(df: DataFrame, value: str, peers: list[str]) -> DataFrame:
    """Mid-rank percentile among peers that have a value."""
    has = F.col(value).isNotNull()
    w = Window.partitionBy(*peers, has.cast("int"))
    below = F.rank().over(w.orderBy(value)) - 1
    equal = F.count("*").over(Window.partitionBy(*peers, value))
    return df.withColumn("percentile", F.when(has, 100 * (below + 0.5 * equal) / F.count("*").over(w)))


def composite(df: DataFrame, weights: dict[str, float] = WEIGHTS, least: float = 60.0) -> DataFrame:
    """Weighted mean of the components present; NULL below ``least`` per cent of the weight."""
    have = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    total = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    out = df.withColumn("coverage", 100 * have / sum(weights.values()))
    return out.withColumn("score", F.when(F.col("coverage") >= least, total / have))


def confidence_level(score: Column, high: float = 80, medium: float = 60, low: float = 35) -> Column:
    """A label of a confidence in per cent; without one, or below ``low``, evidence is insufficient."""
    return F.when(score.isNull() | (score < low), "insufficient").when(score >= high, "high").when(score >= medium, "medium").otherwise("low")
