"""What to record in a cell: species prospects and the coverage-gap tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF, WIDE, NEIGHBOURS = 0.125, 0.375, 0.5


def in_box(lat: Column, lon: Column, at: tuple[float, float], half: float) -> Column:
    return (F.abs(lat - at[0]) <= half) & (F.abs(lon - at[1]) <= half)


def band_join(points: DataFrame, places: DataFrame, half: float) -> DataFrame:
    """Points (lat, lon, ..) within ``half`` degrees of places (place, plat, plon) on both axes.

    An equi-join on bins of the box's width: each place is looked up in the nine bins around it.
    """
    side = 2 * half
    binned = points.withColumns({"__i": F.floor(F.col("lat") / side), "__j": F.floor(F.col("lon") / side)})
    near = F.sequence(F.lit(-1), F.lit(1))
    spread = places.withColumn("__di", F.explode(near)).withColumn("__dj", F.explode(near))
    spread = spread.withColumns({"__i": F.floor(F.col("plat") / side) + F.col("__di"), "__j": F.floor(F.col("plon") / side) + F.col("__dj")}).drop("__di", "__dj")
    return binned.join(spread, ["__i", "__j"]).where((F.abs(F.col("lat") - F.col("plat")) <= half) & (F.abs(F.col("lon") - F.col("plon")) <= half)).drop("__i", "__j")


def prospects(obs: DataFrame, at: tuple[float, float], half: float = HALF, n: int = 6, least_total: int = 40) -> DataFrame:
    """Species worth recording here: new to the cell first, then low share of the regional count,
    then scarce in the region. ``least_total`` drops taxa with too few records anywhere."""
    lat, lon = F.col("lat"), F.col("lon")
    here, wide = in_box(lat, lon, at, half), in_box(lat, lon, at, 3 * half)
    counts = obs.groupBy("taxon").agg(F.count_if(here).alias("here"), F.count_if(wide).alias("region"), F.count("*").alias("total"))
    some = counts.where((F.col("total") > least_total) & ((F.col("here") >= 2) | ((F.col("here") < 2) & (F.col("region") >= 3))))
    local = F.col("here") >= 2
    share = F.when(local, F.col("here") / F.greatest(F.lit(1), F.col("region"))).otherwise(0.0)
    out = some.select("taxon", F.when(local, F.col("here")).otherwise(0).alias("here"), F.col("region"), local.alias("known"), share.alias("share"))
    return out.orderBy("known", "share", "region", "taxon").limit(n)


def gap_tree(obs: DataFrame, at: tuple[float, float], half: float = HALF, wide: float = NEIGHBOURS) -> DataFrame:
    """(grp, c, n, cov): species of the cell against those around, by group, over the cell's own rate."""
    lat, lon = F.col("lat"), F.col("lon")
    here, near = in_box(lat, lon, at, half), in_box(lat, lon, at, wide)
    counts = obs.where(near).groupBy("grp").agg(F.count_distinct(F.when(here, F.col("taxon"))).alias("c"), F.count_distinct("taxon").alias("n")).where("n >= 3")
    counts = counts.withColumn("c", F.least("c", "n"))
    total = F.broadcast(counts.agg(F.try_divide(F.sum("c").cast("double"), F.sum("n")).alias("rate")))
    return counts.crossJoin(total).select("grp", "c", "n", F.when(F.col("rate") > 0, F.col("c") / F.col("n") / F.col("rate")).otherwise(0.0).alias("cov"))


def least_covered(obs_cells: DataFrame) -> DataFrame:
    """(gi, gj, grp): the group with the lowest share of its richest cell; none where all are 0.

    ``obs_cells`` is (grp, gi, gj, s).
    """
    most = obs_cells.groupBy("grp").agg(F.max("s").alias("most"))
    share = obs_cells.join(F.broadcast(most), "grp").withColumn("share", F.col("s") / F.col("most"))
    return share.groupBy("gi", "gj").agg(F.min_by("grp", F.struct("share", "grp")).alias("grp"), F.min("share").alias("share"))
