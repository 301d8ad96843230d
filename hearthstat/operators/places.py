"""Products of places: rolling markets, trends from text records, long metrics, inherited values, lineage, scores and dashboards."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthstat.functions.clean import median_of, pct_change, to_iso_date, to_number
from hearthstat.operators.market import latest, since
from hearthstat.operators.scoring import WEIGHTS

#: Fixed component of each metric of the place score, and whether more of it is better.
COMPONENTS = {"change_1y": ("market", True), "gross_yield_pct": ("rental", True), "expansion": ("renewal", True), "employment_pct": ("demographics", True), "growth_pct": ("demographics", True), "median_pp_sqm": ("supply", False)}


def settlement_trend(records: DataFrame) -> DataFrame:
    """Medians per settlement of the last twelve months and the twelve before, counted back from the newest date in the data.

    ``date`` and ``price`` are source text; what does not parse has no part in any figure.
    """
    r = records.select("settlement", to_iso_date(F.col("date")).alias("d"), to_number(F.col("price")).alias("p")).filter("d IS NOT NULL AND p > 0")
    anchor = r.agg(F.max("d").alias("anchor"))
    back = lambda m: F.add_months("anchor", -m)
    now, past = F.col("d") > back(12), (F.col("d") > back(24)) & (F.col("d") <= back(12))
    m = r.crossJoin(F.broadcast(anchor)).filter(now | past).groupBy("settlement").agg(  # the anchor is one row
        F.count_if(now).alias("sales"), F.count_if(past).alias("prior_sales"), median_of(F.col("p"), now).alias("m"), median_of(F.col("p"), past).alias("was"))
    return m.select("settlement", "sales", "prior_sales", F.round("m", 4).alias("median_price"), F.round("was", 4).alias("prior_median"), F.round(pct_change(F.col("m"), F.col("was")), 4).alias("change_pct"))


def long_metrics(frames: list[tuple[DataFrame, dict[str, str], str]]) -> DataFrame:
    """(place, metric, value, sample, confidence, source) of wide frames; ``{metric: sample column}`` names what each holds."""
    tall = []
    for df, metrics, source in frames:
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.col(n).cast("long").alias("sample_count")) for m, n in metrics.items()])
        tall.append(df.select("neighborhood_id", F.inline(cells)).withColumn("source", F.lit(source)))
    out = reduce(DataFrame.unionByName, tall).filter("value IS NOT NULL")
    return out.withColumn("confidence", F.round(F.least(F.col("sample_count") / 20, F.lit(1.0)), 6))


def latest_year_value(df: DataFrame, keys: list[str]) -> DataFrame:
    """The newest year of each key that has a value."""
    return df.filter("value IS NOT NULL").groupBy(*keys).agg(F.max_by("value", "year").alias("value"), F.max("year").alias("year"))


def municipal_inherit(city_values: DataFrame, hoods: DataFrame) -> DataFrame:
    """A city's newest value of each metric on all its places, marked as the city's."""
    newest = latest_year_value(city_values, ["city_id", "metric"])
    return hoods.select("neighborhood_id", "city_id").join(newest, "city_id").select("neighborhood_id", "metric", "value", "year", F.lit(0.55).alias("confidence"), F.lit("city_level_value").alias("warning"))


def link_evidence(links: dict[str, DataFrame]) -> DataFrame:
    """Which record of which dataset points to which place, how, and how surely; frames hold record_id, place_id, method, confidence."""
    rows = [df.select(F.lit(name).alias("dataset"), F.col("record_id").cast("long"), F.col("place_id").cast("long"), "method", F.col("confidence").cast("double")) for name, df in links.items()]
    return reduce(DataFrame.unionByName, rows)


def source_quality(evidence: DataFrame) -> DataFrame:
    """Links, places and mean confidence of each dataset, and how far it carries: strong, usable or limited.

    Confidences are summed as decimals, so the mean does not hang on the order of rows where it meets a limit.
    """
    exact = F.col("confidence").cast("decimal(20,15)")
    s = evidence.groupBy("dataset").agg(F.count("*").alias("rows"), F.count("place_id").alias("linked"), F.countDistinct("place_id").alias("places"), (F.sum(exact).cast("decimal(38,15)") / F.count("confidence")).cast("double").alias("mean"))
    share = F.col("linked") / F.col("rows")
    label = F.when((share >= 0.9) & (F.col("mean") >= 0.9), "strong").when((share >= 0.5) & (F.col("mean") >= 0.6), "usable").otherwise("limited")
    return s.select("dataset", "rows", "linked", "places", F.round("mean", 6).alias("mean_confidence"), label.alias("quality"))


def score_places(metrics: DataFrame, weights: dict[str, float] = WEIGHTS, least: float = 60.0) -> DataFrame:
    """Mid-rank percentiles of each metric among all places, meaned by component, weighted over the components present.

    Below ``least`` per cent of the weight there is no score; the mean confidence covers the metrics used.
    """
    table = lambda f: F.element_at(F.create_map(*[F.lit(x) for k, v in COMPONENTS.items() for x in (k, f(v))]), F.col("metric"))
    known = metrics.filter(F.col("metric").isin(*COMPONENTS))
    all_, ordered, same = Window.partitionBy("metric"), Window.partitionBy("metric").orderBy("value"), Window.partitionBy("metric", "value")
    share = 100 * (F.rank().over(ordered) - 1 + 0.5 * F.count("*").over(same)) / F.count("*").over(all_)
    ranked = known.withColumn("share", share).withColumn("part", table(lambda v: v[0])).withColumn("points", F.when(table(lambda v: v[1]), F.col("share")).otherwise(100 - F.col("share")))
    parts = ranked.groupBy("neighborhood_id", "part").agg(F.avg("points").alias("points"), F.sum("confidence").alias("c"), F.count("*").alias("n"))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("part"))
    s = parts.withColumn("w", weight).groupBy("neighborhood_id").agg(
        (100 * F.sum("w") / sum(weights.values())).alias("coverage"), (F.sum(F.col("w") * F.col("points")) / F.sum("w")).alias("score"), (F.sum("c") / F.sum("n")).alias("confidence"))
    return s.select("neighborhood_id", F.round("coverage", 4).alias("coverage"), F.round(F.when(F.col("coverage") >= least, F.col("score")), 6).alias("score"), F.round("confidence", 6).alias("confidence"))


def serving_cache(metrics: DataFrame, scores: DataFrame, names: list[str]) -> DataFrame:
    """One wide row a place: its metrics by name and its score."""
    wide = metrics.groupBy("neighborhood_id").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names])
    return wide.join(scores, "neighborhood_id", "full")


def parcel_activity(parcels: DataFrame, tx: DataFrame) -> DataFrame:
    sold = tx.groupBy("parcel_id").agg(F.count("*").alias("n"), F.max("deal_date").alias("latest_deal"))
    return parcels.select("parcel_id").join(sold, "parcel_id", "left").select("parcel_id", F.coalesce("n", F.lit(0)).alias("transactions"), "latest_deal")


def place_section(df: DataFrame, place_id: int, order: str) -> DataFrame:
    """One section of a place's dashboard: its rows, newest first."""
    return df.filter(F.col("neighborhood_id") == place_id).orderBy(F.col(order).desc_nulls_last())


def sections(frames: dict[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """Rows and newest date of every section of every place's dashboard."""
    one = lambda name, df, at: df.filter("neighborhood_id IS NOT NULL").groupBy("neighborhood_id").agg(F.count("*").alias("rows"), F.max(F.lit(None) if at is None else at).cast("date").alias("newest")).withColumn("section", F.lit(name))
    return reduce(DataFrame.unionByName, [one(name, df, at) for name, (df, at) in frames.items()])


def area_sections(of_places: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """The same on the grain of statistical areas; an area's share of a place's rows is not known, so rows stay whole beside the overlap."""
    return crosswalk.select("stat_area_id", "neighborhood_id", "overlap_ratio").join(of_places, "neighborhood_id").groupBy("stat_area_id", "section").agg(
        F.sum("rows").alias("rows"), F.max("newest").alias("newest"), F.count("*").alias("places"), F.min("overlap_ratio").alias("least_overlap"))


def area_overview(hoods: DataFrame, trend: DataFrame, rents: DataFrame, confidence: DataFrame, inherited: DataFrame) -> DataFrame:
    """Sales, rents, confidence and city values side by side, a row a place."""
    out = hoods.select("neighborhood_id", "city_id", "name")
    for df in (trend.select("neighborhood_id", "m0", "change_1y"), rents.select("neighborhood_id", "supply", "median_rent"), confidence.select("neighborhood_id", "sample_count", "confidence"), inherited.select("neighborhood_id", F.col("value").alias("city_value"), F.col("year").alias("city_year"))):
        out = out.join(df, "neighborhood_id", "left")
    return out
