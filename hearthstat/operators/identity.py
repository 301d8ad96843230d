"""Resolution to canonical places: fallbacks with method and confidence, merged crosswalks, closures of hierarchies."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthstat.functions.clean import normalize_name

#: Fixed order of trust of mapping methods, best first.
PRECEDENCE = ("verified", "official", "configured", "evidence", "overlap")


def merge_crosswalks(maps: DataFrame, keys: list[str]) -> DataFrame:
    """The most trusted method of each pair with the greatest confidence of all."""
    trust = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("mapping_method"))
    order = Window.partitionBy(*keys).orderBy(F.when(trust > 0, trust).otherwise(99), F.col("confidence").desc(), "mapping_method")
    best = F.max("confidence").over(Window.partitionBy(*keys))
    return maps.withColumn("n", F.row_number().over(order)).withColumn("confidence", best).filter("n = 1").drop("n")


def resolve(tx: DataFrame, parcels: DataFrame, on_ambiguous: str = "best") -> DataFrame:
    """A direct place first; else the parcel's, by confidence then id; the method and confidence stand beside it."""
    if on_ambiguous not in ("best", "fanout", "drop"):
        raise ValueError("on_ambiguous is best, fanout or drop")
    p = parcels.select("parcel_id", F.col("neighborhood_id").alias("via"), F.col("confidence").alias("via_confidence"))
    if on_ambiguous == "best":
        order = Window.partitionBy("parcel_id").orderBy(F.col("via_confidence").desc(), "via")
        p = p.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
    elif on_ambiguous == "drop":
        p = p.withColumn("n", F.count("*").over(Window.partitionBy("parcel_id"))).filter("n = 1").drop("n")
    direct = F.col("neighborhood_id").isNotNull()
    # Resolved rows need no crosswalk; ``spread`` deals them over the join's tasks, as NULL alone would not.
    needy = ~direct & F.col("parcel_id").isNotNull()
    open_ = tx.withColumn("look", F.when(needy, F.col("parcel_id"))).withColumn("spread", F.when(needy, F.xxhash64("parcel_id")).otherwise(F.xxhash64("transaction_id")))
    return open_.join(p.withColumnRenamed("parcel_id", "look").withColumn("spread", F.xxhash64("look")), ["look", "spread"], "left").select(
        "transaction_id", F.coalesce("neighborhood_id", "via").alias("place_id"), F.when(direct, "direct").when(F.col("via").isNotNull(), "parcel").otherwise("unresolved").alias("method"),
        F.when(direct, 1.0).otherwise(F.col("via_confidence")).alias("confidence"))


def parcel_evidence(tx: DataFrame) -> DataFrame:
    """Places that a parcel's sales point to; one parcel alone is capped at .72, up to four at .90, more at .98."""
    n = F.countDistinct("transaction_id")
    return tx.filter(F.col("neighborhood_id").isNotNull()).groupBy("parcel_id", "neighborhood_id").agg(n.alias("sales"), F.round(F.when(n >= 5, 0.98).when(n >= 2, 0.90).otherwise(0.72), 4).alias("confidence"))


def _cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the session's shared folder; only a local session without one gets a temporary folder."""
    spark = df.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hearthstat-"))
    return df.checkpoint()


def closure(edges: DataFrame) -> DataFrame:
    """Ancestors of every node of a parent table (child, parent), of however many levels, each with its least depth.

    Each level is one join of the pairs found last, checkpointed where ``spark.checkpoint.dir`` says; a cycle is an error.
    """
    up = edges.select("child", "parent").distinct()
    out, depth = None, 1
    last = up.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"))
    while True:
        last = _cut(last)
        if last.filter(F.col("node") == F.col("ancestor")).head(1):
            raise ValueError("the parent table has a cycle")
        if depth > 1 and last.isEmpty():
            return out.groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))
        level = last.withColumn("depth", F.lit(depth))
        out = level if out is None else out.unionByName(level)
        depth += 1
        last = last.join(up, F.col("ancestor") == F.col("child")).select("node", F.col("parent").alias("ancestor")).distinct()


def official_crosswalk(keys: DataFrame, hoods: DataFrame, aliases: DataFrame) -> DataFrame:
    """Places named by an official key (city_id, stat_area_id, names): exact names or aliases of the same city.

    An area of one place only is wholly that place's (.98); a shared one has no known overlap (.85).
    """
    named = keys.select("city_id", "stat_area_id", F.explode(F.array_distinct(F.transform(F.split("names", "[,;/]"), normalize_name))).alias("key")).filter("key <> ''")
    known = hoods.select("city_id", "neighborhood_id", normalize_name(F.col("name")).alias("key"))
    known = known.union(hoods.join(aliases, "neighborhood_id").select("city_id", "neighborhood_id", normalize_name(F.col("alias")))).distinct()
    matched = named.join(known, ["city_id", "key"]).select("stat_area_id", "neighborhood_id").distinct()
    places = F.count("*").over(Window.partitionBy("stat_area_id"))
    return matched.withColumn("places", places).select(
        "stat_area_id", "neighborhood_id", F.when(F.col("places") == 1, 1.0).alias("overlap_ratio"), F.lit("official").alias("mapping_method"), F.when(F.col("places") == 1, 0.98).otherwise(0.85).alias("confidence"))


def curated_crosswalk(evidence: DataFrame) -> DataFrame:
    """Reviewed pairs that are safe for identity; only those safe for analytics overlap wholly."""
    return evidence.filter("safe_for_identity").select("stat_area_id", "neighborhood_id", F.when(F.col("safe_for_analytics"), 1.0).alias("overlap_ratio"), F.lit("configured").alias("mapping_method"), "confidence")


def crosswalk_validation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per place: areas that both, only the first and only the second crosswalk map, and what that says."""
    side = lambda df, c: df.select("stat_area_id", "neighborhood_id").distinct().withColumn(c, F.lit(True))
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    both = side(a, "a").join(side(b, "b"), ["stat_area_id", "neighborhood_id"], "full").groupBy("neighborhood_id").agg(
        F.count_if(has("a") & has("b")).alias("matched"), F.count_if(has("a") & ~has("b")).alias("only_first"), F.count_if(~has("a") & has("b")).alias("only_second"))
    first, second = F.col("only_first"), F.col("only_second")
    return both.withColumn("result", F.when((first == 0) & (second == 0), "exact_match").when((F.col("matched") == 0) & ((first == 0) | (second == 0)), "one_sided").otherwise("conflict"))


def resolution_queue(attempts: DataFrame) -> DataFrame:
    """State of each entity over its attempts (entity_id, at, place_id): a resolution sticks to the first place found."""
    found = F.col("place_id").isNotNull()
    return attempts.groupBy("entity_id").agg(
        F.count("*").alias("attempts"), F.min_by("place_id", F.when(found, F.struct("at", "seq"))).alias("place_id"), F.min(F.when(found, F.col("at"))).alias("resolved_at"), F.max("at").alias("last_attempt"),
    ).withColumn("state", F.when(F.col("resolved_at").isNotNull(), "resolved").otherwise("pending"))


def address_membership(assets: DataFrame, documented: DataFrame) -> DataFrame:
    """Membership of an asset in a project by exactly its documented address (project_id, address, membership); else unverified."""
    rank = F.when(F.col("membership") == "verified", 0).otherwise(1)
    known = documented.groupBy(normalize_name(F.col("address")).alias("key")).agg(F.min(F.struct(rank.alias("r"), "project_id", "membership")).alias("m"))
    return assets.withColumn("key", normalize_name(F.col("address"))).join(known, "key", "left").drop("key").withColumn("project_id", F.col("m.project_id")).withColumn("membership", F.coalesce("m.membership", F.lit("unverified"))).drop("m")


def claims_status(projects: DataFrame, claims: DataFrame) -> DataFrame:
    """Evidence of projects: any claim not verified makes it provisional, none at all insufficient; claims coexist."""
    c = claims.groupBy("project_id").agg(F.count("*").alias("claims"), F.count_if(F.col("evidence_status") == "verified").alias("verified"))
    n, ok = F.coalesce("claims", F.lit(0)), F.coalesce("verified", F.lit(0))
    return projects.select("project_id").join(c, "project_id", "left").select("project_id", n.alias("claims"), ok.alias("verified"), F.when(n == 0, "insufficient").when(ok < n, "provisional").otherwise("supported").alias("state"))


def mapping_rates(df: DataFrame, source: str, place: str) -> DataFrame:
    """Rows, rows with a place and their share by source."""
    return df.groupBy(source).agg(F.count("*").alias("rows"), F.count(place).alias("resolved")).withColumn("rate_pct", F.round(100 * F.col("resolved") / F.col("rows"), 4))
