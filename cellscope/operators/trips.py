"""Trip planning: distance, mode, candidates, fit to a budget, ranking.

Cells are compared with one start or destination, given as numbers, so plans are scans of the cell
table and top-k selections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscope.functions.scalars import MODES, ROAD_FACTOR, haversine_km
from cellscope.operators.cells import KEYS

LEAST_FIELD_H, CANDIDATES = 0.5, 8


def with_distance(cells: DataFrame, lat: float, lon: float) -> DataFrame:
    return cells.withColumn("km", haversine_km(F.lit(lat), F.lit(lon), F.col("clat"), F.col("clon")))


def hours(km: Column, mode: str) -> Column:
    return km * ROAD_FACTOR / MODES[mode][0]


def greenest_mode(cells: DataFrame, budget: float, cap: float = float("inf")) -> DataFrame:
    """One row: the first mode, greenest first, that reaches some gap in the budget."""
    near = [F.coalesce(F.bool_or((F.col("impact") > 0) & (2 * hours(F.col("km"), m) <= budget - LEAST_FIELD_H) & (hours(F.col("km"), m) <= cap * 1.5)), F.lit(False)) for m in MODES]
    mode = F.lit("Drive")
    for m, ok in reversed(list(zip(MODES, near, strict=True))):
        mode = F.when(ok, m).otherwise(mode)
    return cells.agg(mode.alias("mode"))


def greenest_for(km: Column, budget: float) -> Column:
    mode = F.lit("Drive")
    for m in reversed(MODES):
        mode = F.when(2 * hours(km, m) <= budget - LEAST_FIELD_H, m).otherwise(mode)
    return mode


def candidates(cells: DataFrame, mode: str, budget: float, cap: float = float("inf")) -> DataFrame:
    """The strongest cells within reach and the nearest ones, once each, strongest first.

    If none fits the budget, all within the cap stand in.
    """
    timed = cells.withColumn("est_h", hours(F.col("km"), mode)).where(F.col("est_h") <= cap * 1.5)
    timed = timed.withColumn("__fits", 2 * F.col("est_h") <= budget - LEAST_FIELD_H)
    some = F.broadcast(timed.agg(F.coalesce(F.bool_or("__fits"), F.lit(False)).alias("__some")))
    pool = timed.crossJoin(some).where("__fits OR NOT __some").drop("__fits", "__some")
    strong = pool.orderBy(F.col("impact").desc(), *KEYS).limit(CANDIDATES).withColumn("__o", F.lit(0))
    near = pool.orderBy("km", *KEYS).limit((CANDIDATES + 1) // 2).withColumn("__o", F.lit(1))
    both = strong.unionByName(near)
    firsts = both.groupBy(*KEYS).agg(F.min("__o").alias("__o"))
    chosen = both.join(firsts, [*KEYS, "__o"])
    order = [F.col("__o"), F.when(F.col("__o") == 0, -F.col("impact")).otherwise(F.col("km")), *[F.col(k) for k in KEYS]]
    return chosen.orderBy(*order).limit(CANDIDATES + 4).drop("__o")


def routed(trips: DataFrame, mode: str, budget: float, routes: DataFrame | None = None) -> DataFrame:
    """Hours and km each way, by a route (gi, gj, route_h, route_km) or else the estimate."""
    if routes is None:
        trips = trips.withColumns({"route_h": F.lit(None).cast("double"), "route_km": F.lit(None).cast("double")})
    else:
        trips = trips.join(routes, KEYS, "left")
    out = trips.withColumns({"one_h": F.coalesce("route_h", "est_h"), "one_km": F.coalesce(F.col("route_km"), F.col("km") * ROAD_FACTOR), "real": F.col("route_h").isNotNull()}).drop("route_h", "route_km")
    return out.withColumns({"field_h": budget - 2 * F.col("one_h"), "co2": 2 * F.col("one_km") * MODES[mode][1]})


def fitting(trips: DataFrame, cap: float = float("inf"), ratio: float = 0.0) -> DataFrame:
    return trips.where((F.col("one_h") <= cap) & (F.col("field_h") >= LEAST_FIELD_H) & (F.col("field_h") >= ratio * 2 * F.col("one_h")))


def best(trips: DataFrame, low_carbon: bool = False, n: int = 5) -> DataFrame:
    value = F.col("score") * F.greatest(F.col("field_h"), F.lit(0.0))
    ranked = trips.withColumn("value", value / (1 + F.col("co2")) if low_carbon else value)
    return ranked.orderBy(F.col("value").desc(), *KEYS).limit(n)


def farther(trips: DataFrame, cap: float = float("inf"), n: int = 3) -> DataFrame:
    return trips.where(F.col("one_h") <= cap).orderBy("one_h", *KEYS).limit(n)


def nearest(cells: DataFrame) -> DataFrame:
    return cells.orderBy("km", *KEYS).limit(1)


def snap(cells: DataFrame, lat: float, lon: float, reach: float | None = 0.45) -> DataFrame:
    """The cell nearest to a point by Manhattan degrees; none beyond ``reach``."""
    apart = cells.withColumn("apart", F.abs(F.col("clat") - lat) + F.abs(F.col("clon") - lon))
    if reach is not None:
        apart = apart.where(F.col("apart") <= reach)
    return apart.orderBy("apart", *KEYS).limit(1)
