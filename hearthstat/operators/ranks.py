"""Exact ranks and quantiles of groups of any size: values meet in bins, so that no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def up_to(df: DataFrame, keys: list[str], value: str, weight: Column) -> DataFrame:
    """Distinct values of each group with the weight at or below each (``up_to``) and of the group (``total``).

    Equal values add up before they are shuffled. Bins widen with the logarithm of the value, so a group has a few
    thousand at most; only their totals are ordered per group, the values within one bin.
    """
    v = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    v = v.withColumn("bin", F.floor(F.signum(value) * F.log1p(F.abs(value)) * 64))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("bw").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = v.groupBy(*keys, "bin").agg(F.sum("w").alias("bw")).select(*keys, "bin", before.alias("before"), F.sum("bw").over(group).alias("total"))
    inside = F.sum("w").over(Window.partitionBy(*keys, "bin").orderBy(value))
    return v.join(bins, [*keys, "bin"]).select(*keys, value, (F.col("before") + inside).alias("up_to"), "total")


def quantile(table: DataFrame, keys: list[str], value: str, q: float = 0.5) -> DataFrame:
    """The interpolated quantile of each group of such a table: the values at the two places around it."""
    place = q * (F.col("total") - 1)
    at = lambda p: F.min(F.when(F.col("up_to") > p, F.col(value)))
    g = table.groupBy(*keys).agg(at(F.floor(place)).alias("lo"), at(F.ceil(place)).alias("hi"), F.max(place - F.floor(place)).alias("part"), F.max("total").alias("total"))
    return g.select(*keys, (F.col("lo") + F.col("part") * (F.col("hi") - F.col("lo"))).alias("quantile"), "total")


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]], counts: dict[str, Column]) -> DataFrame:
    """Several exact quantiles and counts of each group in one pass: every value becomes a row (measure, value) of its group.

    ``wanted``: name -> (value, q), NULL values have no part; ``counts``: name -> condition.
    """
    of = {str(c): c for c, _ in wanted.values()}
    cells = [F.struct(F.lit(m).alias("measure"), c.cast("double").alias("value")) for m, c in of.items()] + [F.struct(F.lit(n).alias("measure"), F.when(c, 0.0).alias("value")) for n, c in counts.items()]
    t = up_to(df.select(*keys, F.inline(F.array(*cells))), [*keys, "measure"], "value", F.lit(1))
    aggs = []
    for name, (c, q) in wanted.items():
        at, own = q * (F.col("total") - 1), F.col("measure") == str(c)
        first = lambda p, own=own: F.min(F.when(own & (F.col("up_to") > p), F.col("value")))
        aggs += [first(F.floor(at)).alias(f"{name}_lo"), first(F.ceil(at)).alias(f"{name}_hi"), F.max(F.when(own, at - F.floor(at))).alias(f"{name}_part")]
    aggs += [F.coalesce(F.max(F.when(F.col("measure") == n, F.col("total"))), F.lit(0)).alias(n) for n in counts]
    g = t.groupBy(*keys).agg(*aggs)
    return g.select(*keys, *[(F.col(f"{n}_lo") + F.col(f"{n}_part") * (F.col(f"{n}_hi") - F.col(f"{n}_lo"))).alias(n) for n in wanted], *counts)
