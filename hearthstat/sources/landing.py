"""Raw observations: content hashes, idempotent appends, latest versions, upserts and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthstat.functions.clean import to_number


def payload_hash(*cols: str) -> Column:
    """SHA-256 of the columns as JSON with sorted names, so that their order does not matter."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def land_raw(df: DataFrame, keys: list[str], hash_col: str, seen_at: str) -> DataFrame:
    """One row a key and hash, with first and last sight; a repeat only moves the last one."""
    return df.groupBy(*keys, hash_col).agg(F.min(seen_at).alias("first_seen"), F.max(seen_at).alias("last_seen"), F.count("*").alias("observations"))


def new_observations(df: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(stored.select(*keys).distinct(), keys, "left_anti")


def latest_version(df: DataFrame, keys: list[str], order: list[Column], row_hash: str) -> DataFrame:
    """The newest row of each complete key; a row whose key has a NULL stands for itself."""
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    key = F.when(complete, F.to_json(F.array(*[F.col(k).cast("string") for k in keys]))).otherwise(F.col(row_hash))
    return df.withColumn("_key", key).withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).filter("_n = 1").drop("_key", "_n")


def typed_fields(df: DataFrame, payload: str, numbers: dict[str, str]) -> DataFrame:
    """Numbers out of JSON text: separators and per cent signs go, what is no number is NULL."""
    return df.withColumns({name: to_number(F.get_json_object(payload, f"$.{path}")) for name, path in numbers.items()})


def keyset_scan(df: DataFrame, ts: str, key: str, after: tuple, upper: Column, limit: int) -> DataFrame:
    """Rows after a (time, key) position up to a fixed time, in order."""
    past = (F.col(ts) > F.lit(after[0])) | ((F.col(ts) == F.lit(after[0])) & (F.col(key) > F.lit(after[1])))
    return df.filter(past & (F.col(ts) <= upper)).orderBy(ts, key).limit(limit)


def upsert(target: DataFrame, source: DataFrame, keys: list[str], policy: dict[str, str]) -> DataFrame:
    """Insert or update; per column: overwrite, new_or_old, old_or_new or greatest."""
    t, s = target.alias("t"), source.alias("s")
    rule = {
        "overwrite": lambda c: F.when(F.col("s._in"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")), "new_or_old": lambda c: F.coalesce(f"s.{c}", f"t.{c}"),
        "old_or_new": lambda c: F.coalesce(f"t.{c}", f"s.{c}"), "greatest": lambda c: F.greatest(f"s.{c}", f"t.{c}"),
    }
    on = None
    for k in keys:
        e = F.col(f"t.{k}") == F.col(f"s.{k}")
        on = e if on is None else on & e
    both = t.join(s.withColumn("_in", F.lit(True)).alias("s"), on, "full")
    return both.select(*[F.coalesce(f"s.{k}", f"t.{k}").alias(k) for k in keys], *[rule[p](c).alias(c) for c, p in policy.items()])


def replace_slice(target: DataFrame, new: DataFrame, slice_of: Column) -> DataFrame:
    return target.filter(~F.coalesce(slice_of, F.lit(False))).unionByName(new)
