"""Where queries are registered: each operator on the canonical tables, beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from hearthstat.operators import market
from hearthstat.plans.bindings import Tables

BOUNDS = market.Bounds(unit_price=(100, 20_000), excluded=("4-NOT SPECIFIED",))
QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def comps(t: Tables) -> DataFrame:
    return market.comparable_surface(t.transactions(), BOUNDS)


def sql_of(name: str) -> str:
    """A registered query's SQL as the body of a common table expression behind the canonical ones."""
    return QUERIES[name][1].replace("WITH {B}", "WITH one AS (SELECT 1)")
