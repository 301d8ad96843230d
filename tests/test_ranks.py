"""Ranks and quantiles against numpy on random groups with ties, negatives and a hot key."""

import numpy as np
from pyspark.sql import functions as F

from hearthstat.operators import ranks


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), float(v)) for k, v in zip(rng.choice([1, 2, 3], 3000, p=[0.8, 0.19, 0.01]), np.round(rng.normal(0, 50, 3000), 0), strict=True)] + [(4, 7.5), (5, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    table = ranks.up_to(df, ["k"], "v", F.lit(1))
    of = {k: np.array([v for a, v in rows if a == k and v is not None]) for k in (1, 2, 3, 4)}
    assert all(r["up_to"] == (of[r["k"]] <= r["v"]).sum() and r["total"] == len(of[r["k"]]) for r in table.collect())
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {r["k"]: r["quantile"] for r in ranks.quantile(table, ["k"], "v", q).collect()}
        assert got.keys() == of.keys() and all(abs(got[k] - np.quantile(of[k], q)) < 1e-9 for k in of)


def test_empty(spark):
    table = ranks.up_to(spark.createDataFrame([], "k int, v double"), ["k"], "v", F.lit(1))
    assert table.count() == 0 and ranks.quantile(table, ["k"], "v").count() == 0
