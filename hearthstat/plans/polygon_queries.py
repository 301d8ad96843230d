"""Queries of polygons with holes: exact overlaps, containment, rings out of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthstat.operators import polygons
from hearthstat.plans.catalog import query

#: Districts: squares of .2 degrees, every other one without its upper right quarter. Plots: rectangles with a hole.
_SHAPES = """d AS (SELECT n_nationkey AS a_id, 34 + 0.2::DOUBLE * (n_nationkey % 5) AS x, 31 + 0.2::DOUBLE * (n_nationkey // 5) AS y, n_nationkey % 2 AS cut FROM nation),
p AS (SELECT s_suppkey AS b_id, 34 + ((s_suppkey * 7919) % 900) / 1000.0::DOUBLE + 0.0003::DOUBLE AS x, 31 + ((s_suppkey * 104729) % 900) / 1000.0::DOUBLE + 0.0003::DOUBLE AS y, 0.05::DOUBLE + (s_suppkey % 7) * 0.01::DOUBLE AS w, 0.04::DOUBLE + (s_suppkey % 5) * 0.01::DOUBLE AS h FROM supplier)"""


def _districts(t) -> DataFrame:
    n = F.col("n_nationkey")
    x, y = 34 + 0.2 * (n % 5), 31 + 0.2 * F.floor(n / 5)
    p = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    square, corner = F.array(p(0, 0), p(0.2, 0), p(0.2, 0.2), p(0, 0.2)), F.array(p(0, 0), p(0, 0.2), p(0.1, 0.2), p(0.1, 0.1), p(0.2, 0.1), p(0.2, 0))
    return t.raw("nation").select(n.alias("a_id"), F.array(F.when(n % 2 == 1, corner).otherwise(square)).alias("rings"))


def _plots(t) -> DataFrame:
    """The rings come out of WKT for even keys and out of JSON for odd ones."""
    k = F.col("s_suppkey")
    x, y, w, h = 34 + ((k * 7919) % 900) / 1000.0 + 0.0003, 31 + ((k * 104729) % 900) / 1000.0 + 0.0003, 0.05 + (k % 7) * 0.01, 0.04 + (k % 5) * 0.01
    ring = lambda a, z: [(x + w * a, y + h * a), (x + w * z, y + h * a), (x + w * z, y + h * z), (x + w * a, y + h * z), (x + w * a, y + h * a)]
    text = lambda points, inner, around: F.concat(F.lit(around[0]), F.concat_ws(",", *[F.concat(F.lit(inner[0]), px.cast("string"), F.lit(inner[1]), py.cast("string"), F.lit(inner[2])) for px, py in points]), F.lit(around[1]))
    wkt = F.concat(F.lit("POLYGON ("), text(ring(0, 1), ("", " ", ""), "()"), F.lit(", "), text(ring(0.25, 0.5), ("", " ", ""), "()"), F.lit(")"))
    js = F.concat(F.lit("["), text(ring(0, 1), ("[", ",", "]"), "[]"), F.lit(","), text(ring(0.25, 0.5), ("[", ",", "]"), "[]"), F.lit("]"))
    return t.raw("supplier").select(k.alias("b_id"), F.when(k % 2 == 0, polygons.rings_of_wkt(wkt)).otherwise(polygons.rings_of_json(js)).alias("rings"))


_RECT = "greatest(0, least({0}, {1}) - greatest({2}, {3}))"


def _meet(ax, ay, aw, ah, bx, by, bw, bh):
    """The overlap of two upright rectangles."""
    return f"({_RECT.format(f'{ax} + {aw}', f'{bx} + {bw}', ax, bx)} * {_RECT.format(f'{ay} + {ah}', f'{by} + {bh}', ay, by)})"


_OUT, _HOLE = ("p.x", "p.y", "p.w", "p.h"), ("p.x + p.w * 0.25::DOUBLE", "p.y + p.h * 0.25::DOUBLE", "p.w * 0.25::DOUBLE", "p.h * 0.25::DOUBLE")
_FULL, _GONE = ("d.x", "d.y", "0.2::DOUBLE", "0.2::DOUBLE"), ("d.x + 0.1::DOUBLE", "d.y + 0.1::DOUBLE", "0.1::DOUBLE", "0.1::DOUBLE")


@query(f"""WITH {{B}}, {_SHAPES}, o AS (SELECT b_id, a_id, {_meet(*_FULL, *_OUT)} - {_meet(*_FULL, *_HOLE)} - cut * ({_meet(*_GONE, *_OUT)} - {_meet(*_GONE, *_HOLE)}) AS shared, p.w * p.h * 15 / 16.0::DOUBLE AS whole FROM p, d)
  SELECT b_id AS plot_id, a_id AS district_id, round(shared * 1e6, 4) AS shared, round(shared / whole, 6) AS ratio, CASE WHEN shared / whole >= 0.8::DOUBLE THEN 0.95::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM o WHERE shared / whole > 1e-9""")
def polygon_overlaps(t):
    plots = _plots(t).select(F.col("b_id").alias("a_id"), "rings")
    districts = _districts(t).select(F.col("a_id").alias("b_id"), "rings")
    o = polygons.overlaps(plots, districts, 0.05)
    return o.select(F.col("a_id").alias("plot_id"), F.col("b_id").alias("district_id"), F.round(F.col("shared") * 1e6, 4).alias("shared"), F.round("ratio", 6).alias("ratio"), "confidence")


@query(f"""WITH {{B}}, {_SHAPES} SELECT point_id, b_id AS plot_id FROM points t JOIN p ON t.lon > p.x AND t.lon < p.x + p.w AND t.lat > p.y AND t.lat < p.y + p.h
  WHERE NOT (t.lon > p.x + p.w * 0.25::DOUBLE AND t.lon < p.x + p.w * 0.5::DOUBLE AND t.lat > p.y + p.h * 0.25::DOUBLE AND t.lat < p.y + p.h * 0.5::DOUBLE)""")
def points_in_plots(t):
    return polygons.contained(t.points(), _plots(t).select(F.col("b_id").alias("plot_id"), "rings"), 0.05).select("point_id", "plot_id")


@query("""SELECT s_suppkey AS plot_id, CAST(2 AS INT) AS n_rings, round((0.05::DOUBLE + (s_suppkey % 7) * 0.01::DOUBLE) * (0.04::DOUBLE + (s_suppkey % 5) * 0.01::DOUBLE) * 15 / 16.0::DOUBLE * 1e6, 3) AS area FROM supplier""")
def plot_areas(t):
    return _plots(t).select(F.col("b_id").alias("plot_id"), F.size("rings").alias("n_rings"), F.round(polygons.area(F.col("rings")) * 1e6, 3).alias("area"))
