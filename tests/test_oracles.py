"""Every query with SQL gives the same rows as DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from hearthstat.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events pages".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5)
    if hasattr(x, "isoformat"):
        return x.isoformat()[:19].replace("T00:00:00", "")
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    names = sorted(df.columns)
    rows = lambda data: sorted([tuple(plain(x) for x in r) for r in data], key=str)
    got = rows(df.select(*[f"`{c}`" for c in names]).collect())
    exp = rows(duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in names)} FROM want").fetchall())
    assert len(got) == len(exp)
    bad = [(a, b) for a, b in zip(got, exp, strict=True) if a != b]
    assert not bad, bad[:3]
