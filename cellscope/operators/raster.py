"""Pixel tables: sampling, pooling, display statistics and metadata documents.

A raster is (layer, row, col, value); null is nodata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def masked(value: Column, nodata: float | None = None, least: float | None = None) -> Column:
    """Nodata, non-finite and sentinel values as null."""
    bad = F.isnan(value)
    if nodata is not None:
        bad = bad | (value == nodata)
    if least is not None:
        bad = bad | (value < least)
    return F.when(~bad, value)


def pooled(pixels: DataFrame, factor: int, value: Column) -> DataFrame:
    """Block means of an expression over factor x factor pixels, by layer."""
    r, c = F.floor(F.col("row") / factor).cast("int"), F.floor(F.col("col") / factor).cast("int")
    return pixels.groupBy("layer", r.alias("row"), c.alias("col")).agg(F.avg(value).alias("value"))


def mosaic(tiles: DataFrame) -> DataFrame:
    """Overlapping tiles of a layer by their largest value."""
    return tiles.groupBy("layer", "row", "col").agg(F.max("value").alias("value"))


def sample(points: DataFrame, pixels: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """The pixel under each point (px, py), null off the raster: an equi-join on pixel indexes."""
    at = points.withColumns({"col": F.floor((F.col("px") - x0) / dx).cast("int"), "row": F.floor((F.col("py") - y0) / dy).cast("int")})
    return at.join(pixels.select("row", "col", "value"), ["row", "col"], "left").drop("row", "col")


def sub_grid_means(cells: DataFrame, pixels: DataFrame, keys: list[str], reach: float, n: int, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """Mean of the valid pixels under an n x n grid of points around each cell's centre."""
    step = [(-reach + 2 * reach * i / (n - 1)) for i in range(n)]
    steps = F.array(*[F.lit(s) for s in step])
    pts = cells.withColumn("__a", F.explode(steps)).withColumn("__b", F.explode(steps))
    pts = pts.withColumns({"px": F.col("clon") + F.col("__b"), "py": F.col("clat") + F.col("__a")}).drop("__a", "__b")
    return sample(pts, pixels, x0, y0, dx, dy).groupBy(*keys).agg(F.avg("value").alias("mean"), F.count("value").alias("n_valid"))


def display_stats(pixels: DataFrame, percentile: float = 0.98) -> DataFrame:
    """One row a layer: range, percentiles, valid share, zero share, and the display ceiling.

    Where over half of the valid pixels are zero and some are not, the ceiling is taken among the
    positive ones. Layers without valid pixels get ceiling 1 and ``empty``.
    """
    v, positive = F.col("value"), F.when(F.col("value") > 0, F.col("value"))
    s = pixels.groupBy("layer").agg(
        F.count("*").alias("n"), F.count("value").alias("n_valid"), F.count(positive).alias("n_positive"), F.min("value").alias("minimum"), F.max("value").alias("maximum"),
        F.percentile(v, F.lit(0.02)).alias("p2"), F.percentile(v, F.lit(0.98)).alias("p98"), F.percentile(v, F.lit(percentile)).alias("__all"), F.percentile(positive, F.lit(percentile)).alias("__pos"),
    )
    zero = F.coalesce(1 - F.try_divide(F.col("n_positive").cast("double"), F.col("n_valid")), F.lit(1.0))
    s = s.withColumn("zero_frac", zero).withColumn("sparse_branch", (F.col("zero_frac") > 0.5) & (F.col("n_positive") > 0))
    ceiling = F.when(F.col("sparse_branch"), F.col("__pos")).otherwise(F.col("__all"))
    ceiling = F.when(F.col("n_valid") == 0, 1.0).when(ceiling <= 0, F.greatest(F.lit(1.0), F.col("maximum"))).otherwise(ceiling)
    return s.select(
        "layer", "minimum", "maximum", "p2", "p98", F.round(100.0 * F.col("n_valid") / F.col("n"), 4).alias("valid_percent"), F.round("zero_frac", 4).alias("zero_frac"), "sparse_branch",
        F.round(ceiling, 4).alias("render_vmax"), (F.col("n_valid") == 0).alias("empty"),
    )


def utilisation(stats: DataFrame) -> DataFrame:
    """Share of the colour map in use."""
    u = F.coalesce((F.col("p98") - F.col("p2")) / F.col("render_vmax"), F.lit(0.0))
    return stats.select("layer", F.least(F.lit(1.0), F.greatest(F.lit(0.0), u)).alias("utilisation"))


def stac_items(stats: DataFrame, href: Column, crs: Column) -> DataFrame:
    """(layer, item): a metadata document for each layer; absent statistics are left out."""
    from cellscope.functions.scalars import epsg, stem_of_url

    band = F.struct("minimum", "maximum", "valid_percent", F.round("p2", 2).alias("percentile_2"), F.round("p98", 2).alias("percentile_98"))
    item = F.struct(
        F.lit("Feature").alias("type"), F.lit("1.0.0").alias("stac_version"), stem_of_url(href).alias("id"),
        F.struct(
            F.col("layer").alias("title"), epsg(crs).alias("proj:epsg"), F.array(F.struct(band.alias("statistics"))).alias("raster:bands"),
            F.struct(F.struct(F.array(F.array(F.lit(0.0), F.round("render_vmax", 2))).alias("rescale")).alias("default")).alias("renders"), F.when(F.col("empty"), "hide_empty").alias("flag"),
        ).alias("properties"),
        F.struct(F.struct(href.alias("href"), F.array(F.lit("data")).alias("roles")).alias("cog")).alias("assets"),
    )
    return stats.select("layer", F.to_json(item).alias("item"))
