"""Blending axes under weights, presets, contributions, and comparisons between groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellscope.operators.cells import KEYS
from cellscope.operators.scaling import impact_percentile

AXES = ("discover", "conservation", "env", "staleness", "urgency")
# The shipped weights, in the order of AXES.
PRESETS = {"Spatial Gap": (1.0, 0.0, 0.5, 0.0, 0.0), "Species discovery": (1.0, 0.0, 0.0, 0.6, 0.0), "Conservation": (0.0, 1.0, 0.0, 0.0, 0.4)}


def impact(weights: tuple[float, ...]) -> Column:
    return sum((w * F.coalesce(F.col(a), F.lit(0.0)) for w, a in zip(weights, AXES, strict=True)), F.lit(0.0))


def ranked(grid: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """With ``impact`` and its percentile among all cells, ``score``."""
    return impact_percentile(grid.withColumn("impact", impact(weights)), "impact", "score", KEYS)


def preset_scores(grid: DataFrame, presets: dict[str, tuple[float, ...]] = PRESETS) -> DataFrame:
    """(preset, gi, gj, impact, score) for every preset, one window partition each."""
    table = F.explode(F.array(*[F.struct(F.lit(n).alias("preset"), F.array(*[F.lit(float(x)) for x in w]).alias("w")) for n, w in presets.items()]))
    rows = grid.withColumn("__p", table)
    value = sum((F.get(F.col("__p.w"), F.lit(i)) * F.coalesce(F.col(a), F.lit(0.0)) for i, a in enumerate(AXES)), F.lit(0.0))
    rows = rows.select(F.col("__p.preset").alias("preset"), *KEYS, value.alias("impact"))
    by = Window.partitionBy("preset")
    place = (F.row_number().over(by.orderBy("impact", *KEYS)) - 1) / F.greatest(F.count("*").over(by) - 1, F.lit(1))
    flat = F.max("impact").over(by) - F.min("impact").over(by) < 1e-9
    return rows.withColumn("score", F.when(flat, 0.0).otherwise(place))


def contributions(weights: tuple[float, ...], most: int = 3) -> Column:
    """``axis n/100`` of the largest positive weighted terms, joined by middle dots."""
    terms = F.array(*[F.struct((-w * F.coalesce(F.col(a), F.lit(0.0))).alias("k"), F.lit(i).alias("i"), F.lit(a).alias("a"), F.coalesce(F.col(a), F.lit(0.0)).alias("raw")) for i, (w, a) in enumerate(zip(weights, AXES, strict=True))])
    top = F.slice(F.array_sort(F.filter(terms, lambda t: t["k"] < 0)), 1, most)
    text = F.transform(top, lambda t: F.concat(t["a"], F.lit(" "), F.floor(t["raw"] * 100).cast("string"), F.lit("/100")))
    return F.when(F.size(top) > 0, F.array_join(text, " · ")).otherwise("-")
