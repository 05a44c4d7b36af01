"""Normalising and ranking columns of a cell table.

Minima, maxima and moments come as a one-row aggregate that is broadcast, so nothing is gathered.
Ranks are windows over the whole table: they run on cells, whose number the grid bounds (1.04
million at 0.25 degrees), never on observations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """``df`` with whole-table aggregates as columns."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in totals.items()])))


def _over_range(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(x.isNotNull(), F.coalesce(F.try_divide(x - lo, F.nullif(hi - lo, F.lit(0.0))), F.lit(0.0)))


def min_max(df: DataFrame, also: dict[str, Column] | None = None, **columns: Column) -> DataFrame:
    """Each expression scaled to [0, 1]; all 0 where it is constant, null where it is null.

    ``also`` are further whole-table aggregates of the same pass, which stay as columns.
    """
    totals = {f"__{n}_{k}": f(c.cast("double")) for n, c in columns.items() for k, f in (("lo", F.min), ("hi", F.max))}
    out = with_totals(df, **totals, **(also or {}))
    return out.withColumns({n: _over_range(c.cast("double"), F.col(f"__{n}_lo"), F.col(f"__{n}_hi")) for n, c in columns.items()}).drop(*totals)


def min_max_within(df: DataFrame, by: list[str], **columns: Column) -> DataFrame:
    """``min_max`` within each group of a cell table."""
    w = Window.partitionBy(*by)
    return df.withColumns({n: _over_range(c.cast("double"), F.min(c.cast("double")).over(w), F.max(c.cast("double")).over(w)) for n, c in columns.items()})


def over_max(df: DataFrame, **columns: Column) -> DataFrame:
    """Each expression over its maximum (over 1 where that is 0)."""
    totals = {f"__{n}": F.max(c.cast("double")) for n, c in columns.items()}
    out = with_totals(df, **totals)
    return out.withColumns({n: c.cast("double") / F.coalesce(F.nullif(F.col(f"__{n}"), F.lit(0.0)), F.lit(1.0)) for n, c in columns.items()}).drop(*totals)


def z_score(df: DataFrame, epsilon: float = 1e-9, **columns: Column) -> DataFrame:
    totals = {f"__{n}_{k}": f(c.cast("double")) for n, c in columns.items() for k, f in (("mu", F.avg), ("sd", F.stddev_pop))}
    out = with_totals(df, **totals)
    return out.withColumns({n: (c.cast("double") - F.col(f"__{n}_mu")) / (F.col(f"__{n}_sd") + epsilon) for n, c in columns.items()}).drop(*totals)


def masked_z_score(df: DataFrame, mask: Column, epsilon: float = 1e-12, **columns: Column) -> DataFrame:
    """z over the masked rows; 0 where they do not vary; minus infinity for the others."""
    totals = {f"__{n}_{k}": f(F.when(mask, c.cast("double"))) for n, c in columns.items() for k, f in (("mu", F.avg), ("sd", F.stddev_pop))}
    out = with_totals(df, **totals)
    z = {n: F.when(~mask, float("-inf")).when(F.col(f"__{n}_sd") > epsilon, F.try_divide(c.cast("double") - F.col(f"__{n}_mu"), F.col(f"__{n}_sd"))).otherwise(0.0) for n, c in columns.items()}
    return out.withColumns(z).drop(*totals)


def ordinal_share(df: DataFrame, value: str, name: str, keys: list[str]) -> DataFrame:
    """(place - 1) / (n - 1) in ascending order of value, ties by key; null values rank 0."""
    order = Window.partitionBy(F.col(value).isNull()).orderBy(value, *keys)
    some = with_totals(df, __n=F.count(value))
    place = (F.row_number().over(order) - 1) / F.greatest(F.col("__n") - 1, F.lit(1))
    return some.withColumn(name, F.when(F.col(value).isNull(), 0.0).otherwise(place)).drop("__n")


def lexicographic_share(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Place by several keys over (N - 1)."""
    some = with_totals(df, __n=F.count("*"))
    return some.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1) / F.greatest(F.col("__n") - 1, F.lit(1))).drop("__n")


def impact_percentile(df: DataFrame, value: str, name: str, keys: list[str]) -> DataFrame:
    """Ordinal percentile of a score; 0 everywhere on a flat map."""
    some = with_totals(df, __lo=F.min(value), __hi=F.max(value))
    ranked = ordinal_share(some, value, name, keys)
    return ranked.withColumn(name, F.when(F.col("__hi") - F.col("__lo") < 1e-9, 0.0).otherwise(F.col(name))).drop("__lo", "__hi")


def average_rank(value: Column, *partition: str) -> Column:
    """Rank with ties at their mean place (within the partition)."""
    by = [F.col(p) for p in partition]
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2
