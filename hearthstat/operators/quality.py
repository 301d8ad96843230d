"""Health of sources, evidence checks and governed queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGGREGATES = {"count": lambda c: F.count("*"), "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "median": lambda c: F.percentile(c, F.lit(0.5))}
COMPARE = {"eq": lambda c, v: c == v, "gte": lambda c, v: c >= v, "lte": lambda c, v: c <= v, "contains": lambda c, v: c.contains(v), "in": lambda c, v: c.isin(v)}


def source_freshness(runs: DataFrame, as_of: dt.datetime) -> DataFrame:
    at, status = F.col("started_at"), F.col("status")
    failed = status == "failed"
    return runs.groupBy("source_id").agg(
        F.max(F.when(status == "success", at)).alias("last_success"), F.max(F.when(failed, at)).alias("last_failure"), F.count_if(failed & (at > F.lit(as_of) - F.expr("interval 7 days"))).alias("failures_7d"))


def source_health(fresh: DataFrame, as_of: dt.datetime, stale_hours: int = 48) -> DataFrame:
    """never_run, failed, stale or healthy, by the first rule that holds."""
    ok, bad = F.col("last_success"), F.col("last_failure")
    state = F.when(ok.isNull(), "never_run").when(bad > ok, "failed").when(ok < F.lit(as_of) - F.expr(f"interval {stale_hours} hours"), "stale").otherwise("healthy")
    return fresh.withColumn("health", state)


def dataset_health(datasets: DataFrame, as_of: dt.datetime, stale_hours: int = 48) -> DataFrame:
    """disabled, never_run, failed, stale, syncing or healthy of datasets (enabled, last_checked, status, cursor), by the first rule that holds."""
    c = F.col
    state = (
        F.when(~c("enabled"), "disabled").when(c("last_checked").isNull(), "never_run").when(c("status") == "failed", "failed")
        .when(c("last_checked") < F.lit(as_of) - F.expr(f"interval {stale_hours} hours"), "stale").when(c("cursor").isNotNull(), "syncing").otherwise("healthy")
    )
    return datasets.withColumn("health", state)


def entity_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def checks(rules: dict[str, tuple[DataFrame, F.Column]]) -> DataFrame:
    """(case, rows, violations, passed) of rules that hold for every row of a table."""
    out = None
    for name, (df, holds) in rules.items():
        one = df.agg(F.count("*").alias("rows"), F.count_if(~F.coalesce(holds, F.lit(False))).alias("violations")).select(F.lit(name).alias("case"), "rows", "violations", (F.col("violations") == 0).alias("passed"))
        out = one if out is None else out.unionByName(one)
    return out


def structured_query(df: DataFrame, spec: dict) -> DataFrame:
    """A governed query: filters, up to eight grouping columns, aggregates, order and limit, on the table's own columns only."""
    known = set(df.columns)
    names = [f["field"] for f in spec.get("filters", ())] + list(spec.get("group_by", ())) + [m["field"] for m in spec.get("measures", ()) if m.get("field")]
    if unknown := set(names) - known:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    if len(spec.get("group_by", ())) > 8:
        raise ValueError("at most eight grouping columns")
    for f in spec.get("filters", ()):
        df = df.filter(COMPARE[f["op"]](F.col(f["field"]), f["value"]))
    if spec.get("measures"):
        df = df.groupBy(*spec.get("group_by", ())).agg(*[AGGREGATES[m["agg"]](m.get("field") or "*").alias(m["as"]) for m in spec["measures"]])
    if spec.get("order_by"):
        df = df.orderBy(*[F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in spec["order_by"]])
    return df.limit(spec["limit"]) if spec.get("limit") else df


def provider_health(runs: DataFrame, as_of: dt.datetime, least_rate: float = 0.5) -> DataFrame:
    """State and reason of each provider from its last run, its week's failures and its age, by the first rule that holds."""
    at, status = F.col("started_at"), F.col("status")
    week = at > F.lit(as_of) - F.expr("interval 7 days")
    s = runs.groupBy("source_id").agg(
        F.max_by("status", F.struct("started_at", "run_id")).alias("last_status"), F.max("started_at").alias("last_run"), F.count_if(week).alias("runs_7d"), F.count_if(week & (status == "failed")).alias("failed_7d"))
    old, share = F.col("last_run") < F.lit(as_of) - F.expr("interval 48 hours"), F.col("failed_7d") / F.col("runs_7d")
    ladder = [(old, "stale", "no_run_in_48_hours"), (F.col("last_status") == "failed", "down", "last_run_failed"), ((F.col("runs_7d") > 0) & (share >= least_rate), "unstable", "many_failures"), (F.col("failed_7d") > 0, "degraded", "some_failures")]
    first = lambda i: F.coalesce(*[F.when(rule[0], rule[i]) for rule in ladder])
    return s.withColumn("health", F.coalesce(first(1), F.lit("healthy"))).withColumn("reason", first(2))


def append_evaluation(log: DataFrame | None, results: DataFrame, run_id: int, at: dt.datetime) -> DataFrame:
    """The log of evaluation cases with one run more; a run that is there already is replaced by itself."""
    new = results.withColumn("run_id", F.lit(run_id).cast("long")).withColumn("run_at", F.lit(at))
    return new if log is None else log.filter(F.col("run_id") != run_id).unionByName(new)


def latest_evaluation(log: DataFrame) -> DataFrame:
    """Every case's newest outcome, and since which run it has not passed."""
    order = F.struct("run_at", "run_id")
    s = log.groupBy("case").agg(F.max_by("passed", order).alias("passed"), F.max_by("violations", order).alias("violations"), F.max("run_id").alias("run_id"), F.count("*").alias("runs"), F.max(F.when(F.col("passed"), F.col("run_id"))).alias("last_passed"))
    return s.select("case", "passed", "violations", "run_id", "runs", "last_passed")


def audit(counts: DataFrame, linked: DataFrame, least: float = 50.0) -> DataFrame:
    """Tables with their rows and linked share, and a warning where they are empty or hardly linked; frames hold entity and n, rate_pct."""
    a = counts.join(linked, "entity", "left")
    return a.withColumn("warning", F.when(F.col("n") == 0, "empty").when(F.col("rate_pct") < least, "few_rows_linked"))
