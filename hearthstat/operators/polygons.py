"""Polygons of several rings (holes, parts): even-odd containment, area and exact overlap, in column expressions.

A polygon is an array of open rings of (x, y).  A point is inside if it lies within an odd number of rings, so holes and
parts need no structure.  Each edge, taken in the direction that its ring's depth asks for, is a signed strip down to a
base line; polygons are sums of such strips.  The overlap of two polygons is then the sum over pairs of edges of the
integral of the lower of two straight lines, a closed form: no clipping, no grid error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthstat.operators.spatial import in_ring


def _open(ring: Column) -> Column:
    closed = (F.size(ring) > 1) & F.get(ring, F.lit(0)).eqNullSafe(F.element_at(ring, -1))
    return F.when(closed, F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(1)))).otherwise(ring)


def _rings(rings: Column) -> Column:
    """Open rings of three points or more whose numbers all parse; NULL if none is left."""
    good = F.filter(F.transform(rings, _open), lambda r: (F.size(r) >= 3) & F.forall(r, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    return F.when(F.size(good) > 0, good)


def rings_of_wkt(wkt: Column) -> Column:
    """All rings of POLYGON or MULTIPOLYGON text, holes included; NULL for other text."""
    pair = lambda p: F.split(F.trim(p), r"\s+")
    point = lambda p: F.struct(F.get(pair(p), F.lit(0)).try_cast("double").alias("x"), F.get(pair(p), F.lit(1)).try_cast("double").alias("y"))
    texts = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    return F.when(wkt.rlike(r"(?i)^\s*(MULTI)?POLYGON\s*(Z\s*)?\("), _rings(F.transform(texts, lambda t: F.transform(F.split(t, ","), point))))


def rings_of_json(text: Column) -> Column:
    """All rings of JSON text ``[[[x, y], ...], ...]``."""
    parsed = F.from_json(text, "array<array<array<double>>>")
    return _rings(F.transform(parsed, lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))))


def in_rings(x: Column, y: Column, rings: Column) -> Column:
    return F.size(F.filter(rings, lambda r: in_ring(x, y, r))) % 2 == 1


def box(rings: Column) -> dict[str, Column]:
    xs, ys = F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p["x"]))), F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p["y"])))
    return {"x_lo": F.array_min(xs), "x_hi": F.array_max(xs), "y_lo": F.array_min(ys), "y_hi": F.array_max(ys)}


def edges(rings: Column) -> Column:
    """Edges (x1, y1, x2, y2, sign) from left to right; a strip under an edge counts by its sign.

    A ring's direction is set by the number of rings around its first point, not by how it was written; upright edges
    have no strip.
    """

    def of(ring: Column, i: Column) -> Column:
        first = F.get(ring, F.lit(0))
        depth = F.size(F.filter(rings, lambda o, j: (i != j) & in_ring(first["x"], first["y"], o)))
        ahead = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
        twice = F.aggregate(F.zip_with(ring, ahead, lambda a, b: (a["x"] - b["x"]) * (a["y"] + b["y"])), F.lit(0.0), lambda s, v: s + v)
        turn = F.signum(twice) * F.when(depth % 2 == 0, 1).otherwise(-1)

        def edge(a: Column, b: Column) -> Column:
            forward = a["x"] < b["x"]
            pick = lambda c, left: F.when(forward == left, a[c]).otherwise(b[c])
            return F.struct(pick("x", True).alias("x1"), pick("y", True).alias("y1"), pick("x", False).alias("x2"), pick("y", False).alias("y2"), (turn * F.when(forward, -1).otherwise(1)).alias("sign"))

        return F.filter(F.zip_with(ring, ahead, edge), lambda e: e["x1"] < e["x2"])

    return F.flatten(F.transform(rings, of))


def area(rings: Column) -> Column:
    """In square units of the coordinates; holes do not count."""
    return F.aggregate(edges(rings), F.lit(0.0), lambda s, e: s + e["sign"] * (e["x2"] - e["x1"]) * (e["y1"] + e["y2"]) / 2)


def _shape(rings: Column) -> Column:
    """Names rings by their vertices."""
    return F.md5(F.to_json(rings))


def contained(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Pairs of points (lon, lat) and polygons (rings) that hold them; polygons are spread over the cells of their box.

    Equal places and equal shapes are held against each other once, and then stand for all points and polygons there.
    """
    at = lambda c: F.floor(c / cell)
    c = F.col
    named = polygons.withColumn("shape", _shape(c("rings")))
    shapes = named.filter(c("rings").isNotNull()).groupBy("shape").agg(F.first("rings").alias("rings")).select("*", *[e.alias(n) for n, e in box(c("rings")).items()])
    cells = shapes.withColumn("cx", F.explode(F.sequence(at(c("x_lo")), at(c("x_hi"))))).withColumn("cy", F.explode(F.sequence(at(c("y_lo")), at(c("y_hi")))))
    placed = points.select("lon", "lat").distinct().withColumn("cx", at(c("lon"))).withColumn("cy", at(c("lat")))
    inside = placed.join(cells, ["cx", "cy"]).filter(c("lon").between(c("x_lo"), c("x_hi")) & c("lat").between(c("y_lo"), c("y_hi"))).filter(in_rings(c("lon"), c("lat"), c("rings")))
    holders = named.join(inside.select("shape", "lon", "lat"), "shape").drop("shape")
    return points.join(holders, ["lon", "lat"]).select(*[points[n] for n in points.columns], *[holders[n] for n in polygons.columns])


def overlaps(a: DataFrame, b: DataFrame, cell: float, least: float = 0.0) -> DataFrame:
    """a_id, b_id, shared area, share of a's area and confidence of all pairs that overlap by more than nothing.

    ``a`` has a_id and rings, ``b`` b_id and rings.  Polygons whose boxes meet in a cell are candidates.  Edges of a pair
    meet by upright slabs as wide as a cell, so long boundaries do not meet edge by edge.  Confidence: .95 from a share
    of four fifths, else .7.  Equal shapes are measured once, for all polygons of that shape.
    """
    known = F.col("rings").isNotNull() & (F.size("rings") > 0)
    side = lambda df, key: df.filter(known).select(F.col(key).alias(f"{key}_of"), "rings", _shape(F.col("rings")).alias(key))
    pa, pb = side(a, "a_id"), side(b, "b_id")
    once = lambda df, key: df.groupBy(key).agg(F.first("rings").alias("rings"))
    found = _overlaps(once(pa, "a_id"), once(pb, "b_id"), cell, least)
    out = found.join(pb.drop("rings"), "b_id").join(pa.drop("rings"), "a_id")
    return out.select(F.col("a_id_of").alias("a_id"), F.col("b_id_of").alias("b_id"), "shared", "ratio", "confidence")


def _overlaps(a: DataFrame, b: DataFrame, cell: float, least: float) -> DataFrame:
    at = lambda c: F.floor(c / cell)

    def parts(df: DataFrame, key: str) -> DataFrame:
        r = F.col("rings")
        known = df.select(F.col(key), "rings").filter(r.isNotNull() & (F.size(r) > 0))
        return known.select(key, edges(r).alias("edges"), area(r).alias(f"{key}_area"), *[c.alias(f"{key}_{n}") for n, c in box(r).items()])

    def cells(df: DataFrame, key: str) -> DataFrame:
        e = lambda lo, hi: F.explode(F.sequence(at(F.col(f"{key}_{lo}")), at(F.col(f"{key}_{hi}"))))
        return df.drop("edges").withColumn("cx", e("x_lo", "x_hi")).withColumn("cy", e("y_lo", "y_hi"))

    pa, pb = parts(a, "a_id"), parts(b, "b_id")
    c = F.col
    meet = cells(pa, "a_id").join(cells(pb, "b_id"), ["cx", "cy"]).drop("cx", "cy").distinct()
    lo, hi = F.greatest("a_id_x_lo", "b_id_x_lo"), F.least("a_id_x_hi", "b_id_x_hi")
    meet = meet.filter((lo < hi) & (F.greatest("a_id_y_lo", "b_id_y_lo") < F.least("a_id_y_hi", "b_id_y_hi")))
    meet = meet.select("a_id", "b_id", "a_id_area", lo.alias("lo"), hi.alias("hi"), F.least("a_id_y_lo", "b_id_y_lo").alias("base"))

    def slabs(df: DataFrame, key: str) -> DataFrame:
        """Pieces of one side's edges in each pair and slab, lines as value at x1 and slope, from the pair's base up."""
        rows = meet.join(df.select(key, "edges"), key).select("a_id", "b_id", "lo", "hi", "base", F.inline("edges"))
        rows = rows.withColumn("u", F.greatest("x1", "lo")).withColumn("v", F.least("x2", "hi")).filter("u < v").withColumn("slab", F.explode(F.sequence(at(c("u")), at(c("v")))))
        slope = (c("y2") - c("y1")) / (c("x2") - c("x1"))
        names = {"s": c("sign"), "u": F.greatest(c("u"), c("slab") * cell), "v": F.least(c("v"), (c("slab") + 1) * cell), "x": c("x1"), "y": c("y1") - c("base"), "m": slope}
        return rows.select("a_id", "b_id", "slab", *[x.alias(f"{key[0]}_{n}") for n, x in names.items()]).filter(c(f"{key[0]}_u") < c(f"{key[0]}_v"))

    both = slabs(pa, "a_id").join(slabs(pb, "b_id"), ["a_id", "b_id", "slab"]).withColumn("u", F.greatest("a_u", "b_u")).withColumn("v", F.least("a_v", "b_v")).filter("u < v")
    y = lambda k, x: c(f"{k}_y") + c(f"{k}_m") * (c(x) - c(f"{k}_x"))
    d1, d2, wide = y("a", "u") - y("b", "u"), y("a", "v") - y("b", "v"), c("v") - c("u")
    down, up = F.least(d1, d2), F.greatest(d1, d2)
    below = F.when(down >= 0, 0.0).when(up <= 0, (d1 + d2) / 2 * wide).otherwise(-down * down / (up - down) / 2 * wide)
    lower = (y("b", "u") + y("b", "v")) / 2 * wide + below
    shared = both.groupBy("a_id", "b_id").agg(F.sum(c("a_s") * c("b_s") * lower).alias("shared"))
    out = shared.join(meet.select("a_id", "b_id", "a_id_area"), ["a_id", "b_id"]).withColumn("ratio", c("shared") / c("a_id_area"))
    out = out.filter((c("ratio") > 1e-9) & (c("ratio") >= least - 1e-12))
    return out.select("a_id", "b_id", "shared", "ratio", F.when(c("ratio") >= 0.8 - 1e-12, 0.95).otherwise(0.7).alias("confidence"))
