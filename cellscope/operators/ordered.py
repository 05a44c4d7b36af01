"""Running totals and ranks along a whole table, without a task that sees it whole.

Values fall into bins, ranges that follow each other and hold about ROWS rows. What a bin needs to know
of the ones before it is a total of few rows; the rest is a window within the bin.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellscope.functions.shipping import ship

#: Rows of a bin, and the most bins that are made.
ROWS, BINS = 500_000, 4_000


def bin_of(rows: DataFrame, value: str) -> Column:
    """The bin of a column of numbers, by quantiles of ``rows``; equal values share a bin, nulls are in the first."""
    ship(rows.sparkSession)
    at = [i / BINS for i in range(1, BINS)]
    found = rows.agg(F.count(value).alias("n"), F.percentile_approx(value, at, 10 * BINS).alias("q")).first()
    bins = min(BINS, -(-found["n"] // ROWS))
    cuts = np.unique([found["q"][i * BINS // bins - 1] for i in range(1, bins)]) if bins > 1 else np.array([])
    if not len(cuts):
        return F.lit(0)

    @F.pandas_udf("int")
    def place(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, v.to_numpy()).astype(np.int32))

    return place(F.coalesce(F.col(value), F.lit(cuts[0].item())))


def tasks_for(rows: DataFrame) -> int:
    """Tasks that see about ROWS rows each, not fewer than the session's."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS))


def before_bin(binned: DataFrame, amount: str, by: list[str]) -> DataFrame:
    """(by.., __bin, __before): the total of an amount in the bins before; one row a bin."""
    totals = binned.groupBy(*by, "__bin").agg(F.sum(amount).alias("__all"))
    w = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, "__bin", F.coalesce(F.sum("__all").over(w), F.lit(0)).alias("__before"))


def running(rows: DataFrame, place: Column, amount: str, order: list[str], by: list[str], tasks: int | None = None) -> DataFrame:
    """``rows`` with ``__sum``, the amounts up to a row along ``order``, whose first column ``place`` bins."""
    binned = rows.withColumn("__bin", place)
    binned = binned.repartition(tasks, *by, "__bin") if tasks else binned
    w = Window.partitionBy(*by, "__bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    first = before_bin(binned, amount, by).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__bin").alias("__at"), "__before")
    on = F.col("__bin") == F.col("__at")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = binned.withColumn("__sum", F.sum(amount).over(w)).join(F.broadcast(first), on)
    return out.withColumn("__sum", F.col("__sum") + F.col("__before")).drop("__bin", "__at", "__before", *[f"__{c}" for c in by])


def mean_ranks(rows: DataFrame, value: str) -> DataFrame:
    """(value, __rank): each value's rank in ``rows``, ties at their mean."""
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    return running(counts, bin_of(rows, value), "__n", [value], []).select(value, (F.col("__sum") - (F.col("__n") - 1) / 2).alias("__rank"))
