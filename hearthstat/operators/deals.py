"""Deals: stages over time, the open pipeline, due diligence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def timeline(events: DataFrame) -> DataFrame:
    """Stays of a deal in a stage: consecutive events (deal_id, seq, at, stage) of one stage are one stay; the last is open."""
    w = Window.partitionBy("deal_id").orderBy("at", "seq")
    entered = events.withColumn("before", F.lag("stage").over(w)).filter(~F.col("before").eqNullSafe(F.col("stage")))
    until = F.lead("at").over(w)
    return entered.select("deal_id", "seq", "stage", F.col("at").alias("entered_at"), until.alias("left_at"), (F.unix_timestamp(until) - F.unix_timestamp("at")).alias("seconds"))


def pipeline(stays: DataFrame, prices: DataFrame, scenarios: DataFrame, closed: tuple[str, ...]) -> DataFrame:
    """Deals whose open stay is not in a closed stage, with the latest price and the primary scenario."""
    now = stays.filter(F.col("left_at").isNull() & ~F.col("stage").isin(*closed)).select("deal_id", "stage", "entered_at")
    return now.join(prices, "deal_id", "left").join(scenarios, "deal_id", "left")


def stage_counts(open_deals: DataFrame) -> DataFrame:
    return open_deals.groupBy("stage").agg(F.count("*").alias("deals"), F.sum("price").alias("asked"))


def completeness(items: DataFrame) -> DataFrame:
    """Due diligence by deal over the latest status of each item (deal_id, item_key, status, at, seq); items not applicable do not count."""
    latest = items.groupBy("deal_id", "item_key").agg(F.max_by("status", F.struct("at", "seq")).alias("status"))
    counts = latest.filter("status <> 'not_applicable'").groupBy("deal_id").agg(F.count("*").alias("items"), F.count_if(F.col("status") == "verified").alias("verified"), F.count_if(F.col("status") == "issue").alias("issues"))
    return counts.withColumn("complete_pct", F.round(100 * F.col("verified") / F.col("items"), 4))
