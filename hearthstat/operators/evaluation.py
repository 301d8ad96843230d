"""Evaluation of finished marts: cases with a severity, what breaks them, and whether they pass.

Each case is a set of violating rows; a case without any passes, and one that needs rows fails on an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cases(df: DataFrame, *rules: tuple[str, str, str, Column, bool]) -> DataFrame:
    """(case, category, severity, rows, violations, passed) of rules (case, category, severity, what breaks it, whether it
    needs rows) from one pass over a table; a rule that is NULL for a row is not broken by it."""
    one = df.agg(F.count("*").alias("rows"), *[F.count_if(F.coalesce(bad, F.lit(False))).alias(f"v{i}") for i, (*_, bad, _) in enumerate(rules)])
    row = lambda i, name, category, severity, needs: F.struct(F.lit(name).alias("case"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.col("rows"), F.col(f"v{i}").alias("violations"), ((F.col(f"v{i}") == 0) & ((F.col("rows") > 0) | F.lit(not needs))).alias("passed"))
    return one.select(F.inline(F.array(*[row(i, n, c, s, needs) for i, (n, c, s, _, needs) in enumerate(rules)])))


def columns_case(name: str, category: str, severity: str, tables: dict[str, DataFrame], wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """Every table of ``wanted`` is there with its columns."""
    spark = next(iter(tables.values())).sparkSession
    missing = [f"{t}.{c}" for t, cols in wanted.items() for c in (cols if t in tables else (*cols, "")) if t not in tables or c not in tables[t].columns]
    total = sum(map(len, wanted.values()))
    return spark.createDataFrame([(name, category, severity, total, len(missing), not missing)], "case string, category string, severity string, rows long, violations long, passed boolean")


def place_cases(comps: DataFrame, rolling: DataFrame, census: DataFrame, places: DataFrame, benchmarks: DataFrame, surfaces: dict[str, DataFrame], excluded: tuple[str, ...]) -> DataFrame:
    """The nine cases of the market: what sales count, that asking and executed prices stay apart, that nothing is invented
    where there are no sales, that provisional census profiles are never safe for scores, coverage, grounded benchmarks,
    gated signals, inventory without sales, and that the surfaces exist."""
    c = F.col
    covered = places.join(census.filter(c("population").isNotNull()).select("neighborhood_id").distinct().withColumn("known", F.lit(True)), "neighborhood_id", "left")
    return reduce(DataFrame.unionByName, [
        cases(comps, ("comparables-residential-only", "data-quality", "critical", c("nature").isin(*excluded), False)),
        columns_case("asking-executed-separate", "semantics", "critical", {"rolling": rolling}, {"rolling": ("median_pp_sqm", "median_ask_sqm", "premium_pct")}),
        cases(rolling, ("sparse-places-no-invented-executed", "grounding", "critical", (c("executed_count") == 0) & (c("median_pp_sqm").isNotNull() | c("premium_pct").isNotNull()), False),
              ("market-liquidity-consistency", "market", "medium", (c("executed_count") == 0) & c("inventory_months").isNotNull(), False)),
        cases(census, ("census-provisional-not-score-safe", "census", "critical", (c("profile_quality") == "provisional") & c("safe_for_score"), False)),
        cases(covered, ("census-coverage", "census", "high", c("known").isNull(), True)),
        cases(benchmarks, ("listing-benchmark-grounded", "listing-benchmark", "high", (c("executed_n") <= 0) | (c("others") <= 0) | (c("confidence") <= 0), True),
              ("listing-confidence-gates-signal", "listing-benchmark", "high", (c("confidence") < 0.5) & ~c("signal").eqNullSafe("insufficient"), False)),
        columns_case("surfaces-exist", "semantics", "critical", surfaces, {t: ("neighborhood_id",) for t in ("rolling", "benchmarks", "census", "places")}),
    ])
