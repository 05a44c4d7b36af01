"""Priority axes of the map: discover, conservation, env, staleness, urgency, travel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscope.functions.scalars import STATUS_WEIGHTS, implied_records, inverse_density, lookup, staleness_score
from cellscope.operators.cells import KEYS
from cellscope.operators.scaling import lexicographic_share, min_max, ordinal_share, over_max, z_score


def climate_density(cells: DataFrame, bands: list[str], weight: str, h: float = 0.5) -> DataFrame:
    """(keys, kde): weighted Gaussian kernel density of each cell's climate among recorded cells.

    Both sides are cell tables, so the recorded side is bounded by the grid. It is gathered by
    standardised climate into one row per distinct climate, which both sides share, before the
    pairs are taken.
    """
    z = z_score(cells, **{f"z_{b}": F.col(b) for b in bands}).where(" AND ".join(f"{b} IS NOT NULL" for b in bands))
    zs = [f"z_{b}" for b in bands]
    points = z.groupBy(*zs).agg(F.sum(F.when(F.col(weight) > 0, F.col(weight)).otherwise(0)).cast("double").alias("__w"))
    recorded = points.where("__w > 0").select(*[F.col(c).alias(f"r_{c}") for c in zs], "__w")
    d2 = sum(((F.col(c) - F.col(f"r_{c}")) * (F.col(c) - F.col(f"r_{c}")) for c in zs), F.lit(0.0))
    kde = points.select(*zs).join(recorded, F.lit(True)).groupBy(*zs).agg(F.sum(F.col("__w") * F.exp(-d2 / (2 * h * h))).alias("kde"))
    return z.join(kde, zs).select(*cells.columns, "kde")


def env_surprisal(cells: DataFrame, bands: list[str], weight: str, h: float = 0.5) -> DataFrame:
    """Share of cells whose climate is better recorded; cells without a climate get 0."""
    dens = climate_density(cells, bands, weight, h).select(*KEYS, F.round(-F.log(F.col("kde") + 1e-9), 9).alias("__s"))
    return ordinal_share(cells.join(dens, KEYS, "left"), "__s", "env", KEYS).drop("__s")


def env_inverse(cells: DataFrame, bands: list[str], weight: str, h: float = 0.5) -> DataFrame:
    """Scaled inverse climate density, null without a climate."""
    dens = climate_density(cells, bands, weight, h).select(*KEYS, F.try_divide(F.lit(1.0), F.nullif("kde", F.lit(0.0))).alias("__v"))
    return min_max(cells.join(dens, KEYS, "left"), env_inverse=F.col("__v")).drop("__v")


def discover(cells: DataFrame, records: str = "n_train", env: str = "env") -> DataFrame:
    """Place by records descending, then env ascending, then from south-east to north-west."""
    return lexicographic_share(cells, [F.col(records).desc(), F.col(env).asc(), F.col("gi").desc(), F.col("gj").asc()], "discover")


def at_risk(occurrences: DataFrame, status: DataFrame) -> DataFrame:
    """(gi, gj, n_species, score_raw, conservation): species by their most severe status."""
    worst = status.groupBy("taxon").agg(F.max(lookup(F.col("status"), STATUS_WEIGHTS, 0.0)).alias("w")).where("w > 0")
    cells = occurrences.select("taxon", *KEYS).distinct().join(worst, "taxon").groupBy(*KEYS).agg(F.count("*").alias("n_species"), F.sum("w").cast("double").alias("score_raw"))
    return over_max(cells, conservation=F.col("score_raw"))


def staleness_layer(points: DataFrame, least: int = 20) -> DataFrame:
    """(gi, gj, n_all, n_recent, staleness) from counted points (gi, gj, n, recent)."""
    cells = points.groupBy(*KEYS).agg(F.sum("n").alias("n_all"), F.sum(F.when(F.col("recent"), F.col("n")).otherwise(0)).alias("n_recent"))
    scored = cells.withColumn("__s", staleness_score(F.col("n_all"), F.col("n_recent"), least)).where("__s IS NOT NULL")
    return over_max(scored, staleness=F.col("__s")).drop("__s")


def land(cells: DataFrame, footprint: Column, travel: Column, density: Column) -> DataFrame:
    """Cells inside the footprint that have land or records."""
    return cells.where(footprint & (travel.isNotNull() | (F.coalesce(density, F.lit(0.0)) > 0)))


def published(x: Column) -> Column:
    return F.coalesce(F.bround(x, 3), F.lit(0.0))


def published_travel(minutes: Column) -> Column:
    return F.coalesce(F.rint(minutes), F.lit(-1.0))


def map_grid(cells: DataFrame, conservation: DataFrame, stale: DataFrame, bands: list[str], res: float) -> DataFrame:
    """All axes of each cell (gi, gj, clat, density, loss, travel, bands..) as published.

    Cells that the staleness layer lacks take the inverse-density proxy; a staleness of 0 stays 0.
    """
    base = cells.withColumn("n_train", implied_records(F.coalesce("density", F.lit(0.0)), F.col("clat"), res))
    base = discover(env_surprisal(base, bands, "density"))
    base = min_max(base, proxy=inverse_density(F.coalesce("density", F.lit(0.0))), urgency=F.coalesce(F.greatest("loss", F.lit(0.0)), F.lit(0.0)))
    base = base.join(conservation.select(*KEYS, "conservation"), KEYS, "left").join(stale.select(*KEYS, "staleness"), KEYS, "left")
    return base.select(
        *KEYS, published(F.col("discover")).alias("discover"), published(F.col("conservation")).alias("conservation"), published(F.col("env")).alias("env"),
        published(F.coalesce("staleness", "proxy")).alias("staleness"), published(F.col("urgency")).alias("urgency"), published_travel(F.col("travel")).alias("travel_min"), "n_train",
    )
