"""Each active offer against its place: executed sales, sales alike, offers of others, trend; discounts, signal, confidence.

Medians within a box around each offer (rooms, area) are exact, without pairing offers with sales: sales are counted by
cells of like area and bins of like price, cells that lie within a box add up their counts, and only sales in cells on a
box's edge, or in the one or two bins where the median falls, are looked at one by one.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthstat.functions.clean import pct_change
from hearthstat.operators import ranks
from hearthstat.operators.market import since


def box_medians(subjects: DataFrame, rows: DataFrame, width: float = 0.2, rooms: float = 0.5) -> DataFrame:
    """listing_id, matched_n, matched_median: rows (neighborhood_id, area_sqm, rooms, value) of the subject's place whose
    area lies within ``width`` of its own and whose rooms lie within ``rooms``; an unknown area or number of rooms of the
    subject, or an unknown number of the row, asks for nothing.  The median is of positive values."""
    name = lambda *c: F.to_json(F.struct(*c))
    s = subjects.withColumn("box", name("neighborhood_id", "s_area", "s_rooms"))
    boxes = s.groupBy("box").agg(*[F.first(c).alias(c) for c in ("neighborhood_id", "s_area", "s_rooms")])
    strip = F.when(F.col("area_sqm") > 0, F.floor(F.log("area_sqm") / math.log(1.01)))
    r = rows.filter("neighborhood_id IS NOT NULL").withColumn("bin", F.when(F.col("value") > 0, F.floor(F.log("value") * 64))).withColumn("strip", strip).withColumn("cell", name("neighborhood_id", "rooms", "strip"))
    cells = r.groupBy("cell").agg(F.first("neighborhood_id").alias("neighborhood_id"), F.first("rooms").alias("rooms"), F.min("area_sqm").alias("lo"), F.max("area_sqm").alias("hi"))
    low, high, open_ = F.col("s_area") * (1 - width), F.col("s_area") * (1 + width), F.col("s_area").isNull()
    fits = F.col("s_rooms").isNull() | F.col("rooms").isNull() | F.col("rooms").between(F.col("s_rooms") - rooms, F.col("s_rooms") + rooms)
    meets = boxes.join(cells, "neighborhood_id").filter(fits & (open_ | ((F.col("hi") >= low) & (F.col("lo") <= high))))
    meets = meets.select("box", "cell", "s_area", (open_ | ((F.col("lo") >= low) & (F.col("hi") <= high))).alias("inside"))
    within = F.col("inside") | F.col("area_sqm").between(low, high)
    inner = meets.filter("inside").join(r.groupBy("cell", "bin").agg(F.count("*").alias("m")), "cell").select("box", "bin", "m")
    edge = meets.filter("NOT inside").join(r, "cell").filter(within).select("box", "bin", F.lit(1).cast("long").alias("m"))
    bins = inner.unionByName(edge).groupBy("box", "bin").agg(F.sum("m").alias("m"))
    own, priced = Window.partitionBy("box"), F.when(F.col("bin").isNotNull(), F.col("m")).otherwise(0)
    upto = F.sum(priced).over(own.orderBy("bin"))
    b = bins.withColumn("before", upto - priced).withColumn("total", F.sum(priced).over(own)).withColumn("n", F.sum("m").over(own))
    at = 0.5 * (F.col("total") - 1)
    here = b.filter((F.col("before") <= F.ceil(at)) & (F.col("before") + priced > F.floor(at)) & F.col("bin").isNotNull())
    near = here.select("box", "bin", "before", "total").join(meets, "box").join(r, ["cell", "bin"]).filter(within)
    values = near.groupBy("box", "bin", "before", "total", "value").agg(F.count("*").alias("m"))
    place = F.col("before") + F.sum("m").over(Window.partitionBy("box", "bin").orderBy("value"))
    first = lambda p: F.min(F.when(F.col("place") > p, F.col("value")))
    mid = values.withColumn("place", place).groupBy("box").agg(first(F.floor(at)).alias("a"), first(F.ceil(at)).alias("z"), F.first(at - F.floor(at)).alias("part"))
    out = bins.groupBy("box").agg(F.sum("m").alias("matched_n")).join(mid, "box", "left")
    return s.select("listing_id", "box").join(out, "box", "left").select("listing_id", F.coalesce("matched_n", F.lit(0)).alias("matched_n"), (F.col("a") + F.col("part") * (F.col("z") - F.col("a"))).alias("matched_median"))


def median_of_others(offers: DataFrame) -> DataFrame:
    """listing_id, others, others_median: the number of other offers of the place and the median of their unit prices.

    Without one's own value the k-th of the others is the k-th or the next of all, so three values of each place do.
    """
    place = ["neighborhood_id"]
    counted = offers.groupBy(*place).agg(F.count("*").alias("all"))
    table = ranks.up_to(offers, place, "unit", F.lit(1))
    nth = lambda i: F.min(F.when(F.col("up_to") > i, F.col("unit")))
    n = F.col("total")
    # Others number total - 1 for an offer with a unit price, and total for one without.
    values = table.groupBy(*place).agg(F.first("total").alias("total"), *[nth(F.floor((n - 2) / 2) + i).alias(f"v{i}") for i in range(3)], *[nth(x).alias(a) for a, x in (("lo", F.floor((n - 1) / 2)), ("hi", F.ceil((n - 1) / 2)))])
    o = offers.join(table.drop("total"), [*place, "unit"], "left").join(values, place, "left").join(counted, place)
    rank, base, odd = F.col("up_to") - 1, F.floor((n - 2) / 2), n % 2 == 1  # total - 1 others: an even number of them where the total is odd
    pick = lambda i: F.when(base + i < rank, F.col(f"v{i}")).otherwise(F.col(f"v{i + 1}"))
    own = F.when(n >= 2, F.when(odd, (pick(0) + pick(1)) / 2).otherwise(pick(0)))
    return o.select("listing_id", (F.col("all") - 1).alias("others"), F.when(F.col("unit").isNull(), (F.col("lo") + F.col("hi")) / 2).otherwise(own).alias("others_median"))


def lifecycle(snaps: DataFrame) -> DataFrame:
    """Snapshots, their span in days and the first positive asking price of each listing."""
    at, price = F.struct("observed_at", "sequence"), F.when(F.col("asking_price") > 0, F.col("asking_price"))
    span = (F.unix_timestamp(F.max("observed_at")) - F.unix_timestamp(F.min("observed_at"))) / 86400
    return snaps.groupBy("listing_id").agg(F.count("*").alias("snapshot_count"), span.alias("span"), F.min_by(price, F.when(price.isNotNull(), at)).alias("first_price"), F.max_by("asking_price", at).alias("asking_price"))


def listing_benchmarks(listings: DataFrame, snaps: DataFrame, comps: DataFrame, trend: DataFrame, as_of: dt.date) -> DataFrame:
    """All benchmarks of each active offer with a place and an asking price.

    Executed: sales of twelve months; matched: those alike (``box_medians``); recent: of six months.  The trend-adjusted
    base is the recent median, else the matched, else the executed one.  ``trend``: neighborhood_id, change_1y.  Days on
    the market and the first price need two snapshots a day apart.  Below a confidence of one half there is no signal.
    """
    life = lifecycle(snaps)
    x = listings.filter("status = 'active' AND neighborhood_id IS NOT NULL").select("listing_id", "neighborhood_id", F.col("area_sqm").alias("s_area"), F.col("rooms").alias("s_rooms")).join(life, "listing_id").filter("asking_price > 0")
    x = x.withColumn("unit", F.when(F.col("s_area") > 0, F.col("asking_price") / F.col("s_area")))
    window = lambda m: comps.filter((F.col("deal_date") >= since(as_of, m)) & (F.col("deal_date") <= F.lit(as_of)) & F.col("neighborhood_id").isNotNull())
    place, year = ["neighborhood_id"], window(12)
    positive = F.when(F.col("pp_sqm") > 0, F.col("pp_sqm"))
    base = ranks.quantiles(year, place, {"executed_median": (positive, 0.5), "recent_median": (F.when(F.col("deal_date") >= since(as_of, 6), positive), 0.5)}, {"executed_n": F.lit(True)})
    box = box_medians(x, year.select("neighborhood_id", "area_sqm", "rooms", F.col("pp_sqm").alias("value")))
    both = year.select(*place, F.col("pp_sqm").alias("unit"), F.lit(1).alias("w")).unionByName(x.select(*place, "unit", F.lit(0).alias("w")))
    below = ranks.up_to(both, place, "unit", F.col("w")).select(*place, "unit", F.col("up_to").alias("below"))
    r = x.join(box, "listing_id").join(median_of_others(x.select("listing_id", *place, "unit")), "listing_id").join(base, place, "left").join(below, [*place, "unit"], "left").join(trend.select(*place, "change_1y"), place, "left")
    n, m, others, unit = F.coalesce("executed_n", F.lit(0)), F.col("matched_n"), F.col("others"), F.col("unit")
    gap = lambda c: F.when((c > 0) & (unit > 0), pct_change(unit, c))
    adjusted = F.coalesce("recent_median", "matched_median", "executed_median")
    sample = F.when(m >= 5, 0.55).when(n >= 8, 0.35).when(n >= 3, 0.20).otherwise(0.05)
    confidence = F.round(F.least(F.lit(1.0), sample + F.when(others >= 5, 0.25).when(others >= 2, 0.15).otherwise(0.05) + F.when(unit > 0, 0.20).otherwise(0.0)), 6)
    first = F.coalesce(*[gap(F.col(c)) for c in ("matched_median", "executed_median", "others_median")])
    seen = (F.col("snapshot_count") >= 2) & (F.col("span") >= 1)
    money = lambda c: F.round(c, 4)
    return r.select(
        "listing_id", "neighborhood_id", "asking_price", F.round("unit", 4).alias("asking_sqm"), "snapshot_count", F.when(seen, F.floor("span")).alias("days_on_market"), F.when(seen, F.col("first_price")).alias("first_price"),
        F.round(F.when(seen & (F.col("first_price") > 0), pct_change(F.col("asking_price"), F.col("first_price"))), 6).alias("change_since_first_pct"), n.alias("executed_n"), "matched_n", others.alias("others"),
        money("executed_median").alias("executed_median"), money("matched_median").alias("matched_median"), money("recent_median").alias("recent_median"), money("others_median").alias("others_median"),
        *[F.round(gap(c), 6).alias(a) for a, c in (("executed_discount_pct", F.col("executed_median")), ("matched_discount_pct", F.col("matched_median")), ("others_discount_pct", F.col("others_median")), ("adjusted_discount_pct", adjusted))],
        money(adjusted).alias("adjusted_median"), F.col("change_1y"), F.round(F.when(n > 0, 100 * F.coalesce("below", F.lit(0)) / n), 6).alias("executed_percentile"), confidence.alias("confidence"),
        F.when(confidence < 0.5, "insufficient").when(first <= -10, "discount").when(first >= 10, "premium").otherwise("neutral").alias("signal"),
        F.when(m >= 5, "matched_rooms_area_12m").when(n >= 8, "neighborhood_12m").otherwise("limited_neighborhood_evidence").alias("method"), F.when(seen, "supported").otherwise("provisional").alias("lifecycle_status"),
    )
