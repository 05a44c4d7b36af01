"""Polygons and nearest places: ray casting and point-to-edge distance on edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of bounds on distances, so that none fails by its last bit.
SLACK = 1e-9


def edges(vertices: DataFrame) -> DataFrame:
    """(poly, seq, x, y) rings to (poly, x1, y1, x2, y2), closed."""
    w = Window.partitionBy("poly").orderBy("seq")
    first = Window.partitionBy("poly").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(first))
    return vertices.select("poly", F.col("x").alias("x1"), F.col("y").alias("y1"), nxt("x").alias("x2"), nxt("y").alias("y2"))


def _crosses(x: Column, y: Column) -> Column:
    """A ray to the right of the point crosses the edge."""
    straddles = (F.col("y1") > y) != (F.col("y2") > y)
    at = F.col("x1") + F.try_divide((y - F.col("y1")) * (F.col("x2") - F.col("x1")), F.col("y2") - F.col("y1"))
    return straddles & (x < at)


def _distance(x: Column, y: Column) -> Column:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.coalesce(F.try_divide((x - F.col("x1")) * dx + (y - F.col("y1")) * dy, F.nullif(dx * dx + dy * dy, F.lit(0.0))), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return F.hypot(x - F.col("x1") - t * dx, y - F.col("y1") - t * dy)


def _boxes(ring_edges: DataFrame) -> DataFrame:
    """(poly, xl, xh, yl, yh); the edges are closed, so first ends are all vertices."""
    return ring_edges.groupBy("poly").agg(F.min("x1").alias("xl"), F.max("x1").alias("xh"), F.min("y1").alias("yl"), F.max("y1").alias("yh"))


def _least_to_box(x: Column, y: Column) -> Column:
    zero = F.lit(0.0)
    return F.hypot(F.greatest(zero, F.col("xl") - x, x - F.col("xh")), F.greatest(zero, F.col("yl") - y, y - F.col("yh")))


def _most_to_ring(x: Column, y: Column) -> Column:
    """The ring touches each side of its box, so it is no farther than the far end of any side."""
    far = lambda v, lo, hi: F.greatest(F.abs(v - F.col(lo)), F.abs(v - F.col(hi)))
    sides = [F.hypot(x - F.col(s), far(y, "yl", "yh")) for s in ("xl", "xh")] + [F.hypot(far(x, "xl", "xh"), y - F.col(s)) for s in ("yl", "yh")]
    return F.least(*sides)


def nearest_polygon(points: DataFrame, ring_edges: DataFrame, keys: list[str], strip: float = 1.0) -> DataFrame:
    """(keys, inside, poly, distance): the polygon that holds the point, else the nearest; of several
    the first by name.

    The ray cast is an equi-join on strips of y, so a point meets the edges at its height only. Points
    in no polygon meet the polygons' boxes, whose number does not grow with the points, and then the
    edges of those polygons that the boxes cannot rule out. ``keys`` name a point. A null coordinate,
    or no polygon at all, gives inside false and null for the others.
    """
    px, py = F.col("px"), F.col("py")
    row = lambda y: F.floor(y / strip)
    banded = ring_edges.withColumn("__strip", F.explode(F.sequence(row(F.least("y1", "y2")), row(F.greatest("y1", "y2")))))
    met = points.withColumn("__strip", row(py)).join(banded, "__strip").where(_crosses(px, py))
    holding = met.groupBy(*keys, "poly").agg((F.count("*") % 2 == 1).alias("__odd")).where("__odd").groupBy(*keys).agg(F.min("poly").alias("__in"))
    boxed = points.join(holding, keys, "left_anti").join(_boxes(ring_edges), F.lit(True)).withColumns({"__least": _least_to_box(px, py), "__most": _most_to_ring(px, py)})
    open_ = boxed.withColumn("__most", F.min("__most").over(Window.partitionBy(*keys))).where(F.col("__least") <= F.col("__most") * (1 + SLACK) + SLACK)
    near = open_.select(*keys, "px", "py", "poly").join(ring_edges, "poly").withColumn("__d", _distance(px, py))
    near = near.groupBy(*keys).agg(F.min_by("poly", F.struct("__d", "poly")).alias("__near"), F.min("__d").alias("__d"))
    held = F.col("__in").isNotNull()
    return points.select(*keys).join(holding, keys, "left").join(near, keys, "left").select(
        *keys, held.alias("inside"), F.coalesce("__in", "__near").alias("poly"), F.when(held, 0.0).otherwise(F.col("__d")).alias("distance")
    )


def nearest_place(points: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place): the named place at the least squared distance; places are a short list."""
    rows = points.join(F.broadcast(places), F.lit(True))
    d2 = (F.col("px") - F.col("plon")) * (F.col("px") - F.col("plon")) + (F.col("py") - F.col("plat")) * (F.col("py") - F.col("plat"))
    return rows.groupBy(*keys).agg(F.min_by("place", F.struct(d2, F.col("place"))).alias("place"), F.min(d2).alias("d2"))
