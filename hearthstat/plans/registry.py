"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearthstat.plans import market_queries, product_queries, appraisal_queries, place_queries, intake_queries, naming_queries, period_queries, polygon_queries, dataset_queries, evaluation_queries  # noqa: F401, I001  each registers its queries, in this order
from hearthstat.plans.bindings import SQL, Tables
from hearthstat.plans.catalog import QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda f: lambda spark, sf_dir: f(Tables(spark, sf_dir)))(f) for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Queries that name no tables of their own get the canonical ones before them."""
    return {name: sql.replace("{B}", SQL.strip()) if "{B}" in sql else f"WITH {SQL.strip()} {sql}" for name, (_, sql) in QUERIES.items() if sql}
