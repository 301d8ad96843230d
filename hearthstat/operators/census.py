"""Census profiles of places from their statistical areas: by safe mappings, else by reviewed ones as provisional context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthstat.functions.clean import pct_change

REVIEWED = ("configured_crosswalk", "official_crosswalk")


def profiles(areas: DataFrame, census: DataFrame, population: DataFrame, measures: tuple[str, ...], year: int = 2022, later: int = 2024) -> DataFrame:
    """A row a place and year: population, means weighted by population (an area without a measure leaves its denominator),
    areas, mapping confidence, quality and whether scores may use it; the later year has growth and the first year's means.

    ``areas``: neighborhood_id, area_id, overlap_ratio, mapping_method, mapping_confidence, exclusive, safe_for_identity,
    safe_for_polygon (NULL flags are false); ``census``: area_id, population and measures; ``population``: area_id,
    population of the later year.  Validated: the area is wholly the place's, overlaps it by four fifths by polygon, or is
    exclusive.  Only a place without a validated profile gets a provisional one, from mappings of at least .85 that were
    reviewed; it is never safe for scores.
    """
    c, flag = F.col, lambda n: F.coalesce(F.col(n), F.lit(False))
    safe = F.coalesce(c("overlap_ratio") == 1, F.lit(False)) | F.coalesce((c("mapping_method") == "polygon_overlap") & (c("overlap_ratio") >= 0.8), F.lit(False)) | flag("exclusive")
    reviewed = F.coalesce(c("mapping_confidence") >= 0.85, F.lit(False)) & (flag("safe_for_identity") | flag("safe_for_polygon") | F.coalesce(c("mapping_method").isin(*REVIEWED), F.lit(False)))
    quality = F.array_compact(F.array(F.when(safe, F.lit("validated")), F.when(reviewed, F.lit("provisional"))))
    # A mapping counts for either quality that it has; places choose afterwards.
    m = areas.select("neighborhood_id", "area_id", "mapping_confidence", F.explode(quality).alias("quality")).filter("neighborhood_id IS NOT NULL")
    own = ["neighborhood_id", "quality"]

    def mean(x: str) -> Column:
        return F.try_divide(F.sum(c("population") * c(x)), F.sum(F.when(c(x).isNotNull(), c("population")))).alias(x)

    first = m.join(census, "area_id").groupBy(*own).agg(F.count("*").alias("areas"), F.sum("population").alias("before"), F.avg("mapping_confidence").alias("mapping_confidence"), *[mean(x) for x in measures])
    best = first.groupBy("neighborhood_id").agg(F.max("quality").alias("quality"))  # validated comes after provisional
    now = m.join(population.select("area_id", F.col("population").alias("after")), "area_id").groupBy(*own).agg(F.sum("after").alias("after"), F.lit(True).alias("has_later"))
    one = first.join(best, own, "left_semi").join(now, own, "left")
    years = F.array_compact(F.array(F.struct(F.lit(year).alias("year"), c("before").cast("double").alias("population"), F.lit(None).cast("double").alias("growth_pct")),
                                    F.when(c("has_later"), F.struct(F.lit(later).alias("year"), c("after").cast("double").alias("population"), F.when(c("before") > 0, pct_change(c("after"), c("before"))).alias("growth_pct")))))
    out = one.select("*", F.inline(years))
    return out.select(
        "neighborhood_id", "year", "population", F.round("growth_pct", 6).alias("growth_pct"), *[F.round(x, 6).alias(x) for x in measures], "areas", F.round("mapping_confidence", 6).alias("mapping_confidence"),
        c("quality").alias("profile_quality"), (c("quality") == "validated").alias("safe_for_score"), F.when(c("quality") == "validated", "safe_stat_area_crosswalk").otherwise("reviewed_crosswalk").alias("crosswalk_method"),
    )
