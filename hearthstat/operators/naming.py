"""Places from names, streets and sibling parcels: exact keys first, substring rules only within a city, shared evidence only when it is single."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthstat.functions.clean import normalize_address, normalize_name, street_key


def build_aliases(hoods: DataFrame, source_names: DataFrame) -> DataFrame:
    """Normal forms of canonical names (1.0) and of source names (place, name, confidence); the surest of each form."""
    own = hoods.select("city_id", "neighborhood_id", normalize_name(F.col("name")).alias("key"), F.lit(1.0).alias("confidence"))
    other = source_names.join(hoods.select("city_id", "neighborhood_id"), "neighborhood_id").select("city_id", "neighborhood_id", normalize_name(F.col("source_name")).alias("key"), "confidence")
    return own.unionByName(other).filter("key <> ''").groupBy("city_id", "neighborhood_id", "key").agg(F.max("confidence").alias("confidence"))


def resolve_names(df: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """The place of a named row (key, city_id, place_name, neighborhood_id): an earlier match stays, else the surest alias of the city."""
    order = Window.partitionBy("city_id", "key").orderBy(F.col("confidence").desc(), "via")
    best = aliases.select("city_id", "key", F.col("neighborhood_id").alias("via"), "confidence").withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
    looked = df.withColumn("key", F.when(F.col("neighborhood_id").isNull(), F.nullif(normalize_name(F.col("place_name")), F.lit(""))))
    method = F.when(F.col("neighborhood_id").isNotNull(), "earlier").when(F.col("via").isNotNull(), F.when(F.col("confidence") == 1.0, "name").otherwise("alias")).otherwise("unresolved")
    return looked.join(best, ["city_id", "key"], "left").select(key, F.coalesce("neighborhood_id", "via").alias("place_id"), method.alias("method"))


def resolve_streets(df: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """The place of an address by rules (city_id, street, neighborhood_id, confidence).

    The whole street decides first; else a rule that is a run of the street's words, or the other way round. The first
    two words of the shorter one stand side by side in the longer one, so that is an equi-join. Equal rules of a city
    come down to their best first, and equal streets are looked up once.
    """
    order = lambda *more: F.min(F.struct(*more, F.col("confidence").isNull().alias("unsure"), (-F.col("confidence")).alias("against"), "place_id", "confidence"))
    r = rules.select("city_id", street_key(F.col("street")).alias("rule"), F.col("neighborhood_id").alias("place_id"), "confidence").filter("rule <> ''")
    r = r.groupBy("city_id", "rule").agg(order().alias("m")).select("city_id", "rule", "m.place_id", "m.confidence")
    looked = df.select(key, "city_id", street_key(F.col("address")).alias("at"))
    a = looked.filter("at <> ''").select("city_id", "at").distinct()
    w = lambda c: F.split(F.col(c), " ")
    pairs = lambda c: F.zip_with(F.slice(w(c), F.lit(1), F.size(w(c)) - 1), F.slice(w(c), F.lit(2), F.size(w(c)) - 1), lambda x, y: F.concat_ws(" ", x, y))
    first = lambda d, c: d.withColumn("word", F.substring_index(F.col(c), " ", 2))
    every = lambda d, c: d.withColumn("word", F.explode(F.array_distinct(F.concat(w(c), pairs(c)))))
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    inside = every(a, "at").join(first(r, "rule"), ["city_id", "word"]).filter(F.contains(pad("at"), pad("rule")))
    around = first(a, "at").join(every(r, "rule"), ["city_id", "word"]).filter(F.contains(pad("rule"), pad("at")))
    part = (F.col("at") != F.col("rule")).alias("part")
    best = inside.unionByName(around).groupBy("city_id", "at").agg(order(part).alias("m"))
    return looked.join(best, ["city_id", "at"], "left").select(key, "m.place_id", F.when(F.col("m.part"), "part_of_street").when(~F.col("m.part"), "street").alias("method"), "m.confidence")


def project_places(projects: DataFrame, names: DataFrame, streets: DataFrame | None = None) -> DataFrame:
    """Places whose name is a run of words in a project's name, the longest first; runs up to the longest name are keys.

    ``streets`` (city_id, street, neighborhood_id): a project without a place's name takes that of a street in its name.
    """
    known = names.select("city_id", "neighborhood_id", normalize_address(F.col("name")).alias("run"), F.lit(0).alias("kind"))
    if streets is not None:
        known = known.unionByName(streets.select("city_id", "neighborhood_id", street_key(F.col("street")).alias("run"), F.lit(1).alias("kind")))
    known = known.filter("run <> ''")
    longest = known.agg(F.coalesce(F.max(F.size(F.split("run", " "))), F.lit(1)).alias("longest"))
    words = F.split(normalize_address(F.col("project_name")), " ")
    w = projects.crossJoin(F.broadcast(longest)).select("project_id", "city_id", words.alias("w"), "longest").withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w"))))
    runs = w.withColumn("len", F.explode(F.sequence(F.lit(1), F.least(F.col("longest"), F.size("w") - F.col("i") + 1)))).select("project_id", "city_id", F.array_join(F.slice("w", F.col("i"), F.col("len")), " ").alias("run"))
    order = Window.partitionBy("project_id").orderBy("kind", F.length("run").desc(), "neighborhood_id")
    hit = runs.join(known, ["city_id", "run"]).withColumn("n", F.row_number().over(order)).filter("n = 1")
    return projects.select("project_id").join(hit.select("project_id", "neighborhood_id"), "project_id", "left")


def parcel_enrich(parcels: DataFrame) -> DataFrame:
    """Rows of one cadastral key (block, parcel) lend each other area and place where all that know one agree."""
    same = Window.partitionBy("block", "parcel")
    lent = lambda c: F.coalesce(F.col(c), F.when(F.min(c).over(same) == F.max(c).over(same), F.min(c).over(same)))
    return parcels.withColumn("borrowed", F.col("area_sqm").isNull() & lent("area_sqm").isNotNull()).withColumns({"area_sqm": lent("area_sqm"), "neighborhood_id": lent("neighborhood_id")})


def inherit_place(tx: DataFrame, parcels: DataFrame) -> DataFrame:
    """Sales without a place take their parcel's, where the parcel has only one."""
    single = parcels.groupBy("parcel_id").agg(F.min("neighborhood_id").alias("lo"), F.max("neighborhood_id").alias("hi")).filter("lo = hi").select("parcel_id", F.col("lo").alias("via"))
    return tx.join(single, "parcel_id", "left").withColumn("place_id", F.coalesce("neighborhood_id", "via")).drop("via")


def resolve_external(df: DataFrame, by_parcel: DataFrame, by_point: DataFrame, by_name: DataFrame, key: str) -> DataFrame:
    """Parcel before coordinates before name; each frame holds (key, place_id), one row a key."""
    out = df.select(key)
    for name, found in (("parcel", by_parcel), ("coordinates", by_point), ("name", by_name)):
        out = out.join(found.filter("place_id IS NOT NULL").groupBy(key).agg(F.min("place_id").alias(name)), key, "left")
    method = F.when(F.col("parcel").isNotNull(), "parcel").when(F.col("coordinates").isNotNull(), "coordinates").when(F.col("name").isNotNull(), "name").otherwise("unresolved")
    return out.select(key, F.coalesce("parcel", "coordinates", "name").alias("place_id"), method.alias("method"))
