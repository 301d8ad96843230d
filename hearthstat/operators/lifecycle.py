"""Listing histories: price reductions, changes, lifecycles and activity windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthstat.functions.clean import pct_change


def history():
    return Window.partitionBy("listing_id").orderBy("observed_at", "sequence")


def seller_signals(snaps: DataFrame) -> DataFrame:
    """First and last price, strict reductions, total change and observed span; a span needs two snapshots a day apart."""
    span = F.unix_timestamp(F.max("observed_at")) - F.unix_timestamp(F.min("observed_at"))
    cuts = snaps.withColumn("before", F.lag("asking_price").over(history()))
    m = cuts.groupBy("listing_id").agg(
        F.min_by("asking_price", F.struct("observed_at", "sequence")).alias("first_price"), F.max_by("asking_price", F.struct("observed_at", "sequence")).alias("last_price"),
        F.count_if(F.col("asking_price") < F.col("before")).alias("reductions"), F.count("*").alias("snapshots"), (span / 86400).alias("days"),
    )
    supported = (F.col("snapshots") >= 2) & (F.col("days") >= 1)
    return m.select("listing_id", "first_price", "last_price", "reductions", "snapshots", F.round(pct_change(F.col("last_price"), F.col("first_price")), 6).alias("change_pct"), F.when(supported, F.floor("days")).alias("supported_days"))


def listing_changes(snaps: DataFrame) -> DataFrame:
    """created, status, price_drop, price_increase; a change of status outranks one of price; equal rows give nothing."""
    was = lambda c: F.lag(c).over(history())
    kind = (
        F.when(F.col("n") == 1, "created").when(F.col("status") != F.col("old_status"), F.col("status"))
        .when(F.col("asking_price") < F.col("old_price"), "price_drop").when(F.col("asking_price") > F.col("old_price"), "price_increase")
    )
    seen = snaps.withColumn("n", F.row_number().over(history())).withColumn("old_price", was("asking_price")).withColumn("old_status", was("status"))
    return seen.withColumn("change", kind).filter(F.col("change").isNotNull()).select("listing_id", "sequence", "observed_at", "change", "old_price", F.col("asking_price").alias("new_price"))


def snapshot_on_change(snaps: DataFrame) -> DataFrame:
    """Snapshots that differ from the one before."""
    state = F.struct("asking_price", "status")
    before = F.lag(state).over(history())
    return snaps.withColumn("same", before.eqNullSafe(state) & (F.row_number().over(history()) > 1)).filter(~F.col("same")).drop("same")


def inactive_after(snaps: DataFrame, as_of: dt.datetime, days: int = 2) -> DataFrame:
    last = snaps.groupBy("listing_id").agg(F.max("observed_at").alias("last_seen"))
    return last.withColumn("inactive", F.col("last_seen") < F.lit(as_of) - F.expr(f"interval {days} days"))


def tumbling_counts(snaps: DataFrame, width: str = "1 day") -> DataFrame:
    """Works on a stream as on a table."""
    return snaps.groupBy(F.window("observed_at", width).alias("w")).agg(F.count("*").alias("n"), F.max("asking_price").alias("max_price")).select(F.col("w.start").alias("start"), "n", "max_price")


def sliding_stats(snaps: DataFrame, listings: DataFrame, width: str = "7 days", step: str = "1 day") -> DataFrame:
    """Snapshots and mean asking price of each place in overlapping windows."""
    at = snaps.join(listings.select("listing_id", "neighborhood_id"), "listing_id")
    w = at.groupBy("neighborhood_id", F.window("observed_at", width, step).alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("asking_price"), 4).alias("mean_price"))
    return w.select("neighborhood_id", F.col("w.start").alias("start"), "n", "mean_price")


def listing_sessions(snaps: DataFrame, gap: str = "1 day") -> DataFrame:
    """Bursts of observations of a listing separated by a gap."""
    return snaps.groupBy("listing_id", F.session_window("observed_at", gap).alias("w")).agg(F.count("*").alias("n"), F.max("observed_at").alias("last_seen")).select("listing_id", F.col("w.start").alias("first_seen"), "last_seen", "n")


def missing_cycles(sightings: DataFrame, cycles: DataFrame, enabled: DataFrame, least: int = 3) -> DataFrame:
    """Completed cycles that each listing missed, the fewest over its enabled scopes; inactive from ``least`` missed in all of them.

    sightings: scope, listing_id, cycle; cycles: scope, cycle of each completed cycle, in order of ``cycle``.  A listing may
    have been seen last in a cycle that is still open.
    """
    seen = sightings.join(enabled, "scope", "left_semi").groupBy("scope", "listing_id").agg(F.max("cycle").alias("cycle"))
    every = cycles.select("scope", "cycle", F.lit(1).alias("done")).unionByName(seen.select("scope", "cycle", F.lit(0).alias("done"))).groupBy("scope", "cycle").agg(F.max("done").alias("done"))
    later = Window.partitionBy("scope").orderBy(F.col("cycle").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a scope's cycles, not its listings
    missed = every.withColumn("missed", F.coalesce(F.sum("done").over(later), F.lit(0)))
    return seen.join(missed, ["scope", "cycle"]).groupBy("listing_id").agg(F.min("missed").alias("missing_cycles")).withColumn("inactive", F.col("missing_cycles") >= least)
