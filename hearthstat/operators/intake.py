"""From staged source rows to records: what is new, recent and plausible, which rules rows break, and the states they pass."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthstat.functions.clean import is_iso_date

#: Fixed plausible ranges of offers.
PLAUSIBLE = {"sale": ((300_000, 15_000_000), (15, 400)), "rent": ((1_500, 30_000), (15, 400))}


def in_filters(df: DataFrame, allowed: set[str], values: dict[str, list]) -> DataFrame:
    """Rows whose columns are among given values; only allowed columns may be named."""
    if unknown := set(values) - (allowed & set(df.columns)):
        raise ValueError(f"no filter on {sorted(unknown)}")
    for name, some in values.items():
        df = df.filter(F.col(name).isin(list(some)))
    return df


def recent_listing(published: Column, city: Column, as_of: dt.date, days: int, cities: list | None = None) -> Column:
    """A valid date of publication within the last days, not to come, in one of the cities."""
    d = F.try_to_date(published, "yyyy-MM-dd")
    ok = is_iso_date(published) & d.between(F.date_sub(F.lit(as_of), days), F.lit(as_of))
    return F.coalesce(ok if cities is None else ok & city.isin(cities), F.lit(False))


def eligible_new(df: DataFrame, known: DataFrame, as_of: dt.date, lower: dt.date | None = None, days: int = 7) -> DataFrame:
    """Backfill: everything from a fixed date on. Otherwise: rows of the last days whose ids are not known yet."""
    if lower is not None:
        return df.filter(F.col("published_at").between(F.lit(lower), F.lit(as_of)))
    window = df.filter(F.col("published_at").between(F.date_sub(F.lit(as_of), days), F.lit(as_of)))
    return window.join(known.select("source_listing_id").distinct(), "source_listing_id", "left_anti")


def partition_rows(df: DataFrame, valid: Column, wanted: Column) -> DataFrame:
    """``part``: invalid rows first, then those not wanted, else valid."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return df.withColumn("part", F.when(~yes(valid), "invalid").when(~yes(wanted), "excluded").otherwise("valid"))


def search(df: DataFrame, equal: dict | None = None, ranges: dict[str, tuple] | None = None, text: str | None = None, text_in: tuple[str, ...] = (), drops: DataFrame | None = None, key: str = "listing_id") -> DataFrame:
    """Optional equality, ranges with open ends, words in any of several columns, and whether the price ever fell."""
    for name, value in (equal or {}).items():
        df = df.filter(F.col(name) == value)
    for name, (low, high) in (ranges or {}).items():
        df = df if low is None else df.filter(F.col(name) >= low)
        df = df if high is None else df.filter(F.col(name) <= high)
    if text and text_in:
        found = F.lit(False)
        for name in text_in:
            found = found | F.coalesce(F.contains(F.lower(name), F.lit(text.lower())), F.lit(False))
        df = df.filter(found)
    return df if drops is None else df.join(drops.select(key).distinct(), key, "left_semi")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) of every rule that a row does not meet; a rule that is NULL is not met."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def plausible(kind: str, price: Column, area: Column) -> Column:
    prices, areas = PLAUSIBLE[kind]
    return price.between(*prices) & area.between(*areas)


def stage(records: DataFrame, details: DataFrame, wanted: Column) -> DataFrame:
    """State of each staged record: awaiting_detail, error, filtered or ready, with the reason.

    ``details`` hold source_listing_id, failed, and the columns that ``wanted`` reads; the newest detail (by ``at``) counts.
    """
    newest = details.groupBy("source_listing_id").agg(F.max_by(F.struct(*[c for c in details.columns if c != "source_listing_id"]), "at").alias("d"))
    r = records.select("source_listing_id").join(newest, "source_listing_id", "left").select("source_listing_id", F.col("d").isNull().alias("waiting"), "d.*")
    return _state(r, F.col("waiting"), wanted)


def _state(df: DataFrame, waiting: Column, wanted: Column) -> DataFrame:
    bad, keep = F.coalesce("failed", F.lit(False)), F.coalesce(wanted, F.lit(False))
    state = F.when(waiting, "awaiting_detail").when(bad, "error").when(~keep, "filtered").otherwise("ready")
    reason = F.when(waiting, "no_detail").when(bad, "detail_failed").when(~keep, "not_wanted")
    return df.withColumn("state", state).withColumn("reason", reason).drop("waiting")


def stage_stream(details: DataFrame, wanted: Column) -> DataFrame:
    """The second of two chained streams: details as they arrive become error, filtered or ready; no state is kept."""
    return _state(details, F.lit(False), wanted)
