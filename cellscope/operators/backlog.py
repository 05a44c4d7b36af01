"""The identification backlog per cell, and how hard its records are to name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscope.functions.scalars import coarseness, unengaged, wait_days
from cellscope.operators.cells import KEYS


def with_wait(needs: DataFrame, reference: str) -> DataFrame:
    out = needs.withColumn("wait", wait_days(F.col("created"), F.lit(reference).cast("timestamp")))
    return out.withColumns({"idle": unengaged(F.col("idents")), "coarse": coarseness(F.col("rank"))})


def backlog_cells(needs: DataFrame, research: DataFrame, reference: str, least: int = 5) -> DataFrame:
    """(gi, gj, n_need, n_done, backlog, median_wait, idle_share) of cells with enough records."""
    a = with_wait(needs, reference).groupBy(*KEYS).agg(F.count("*").alias("n_need"), F.median("wait").alias("median_wait"), F.avg(F.col("idle").cast("double")).alias("idle_share"))
    b = research.groupBy(*KEYS).agg(F.count("*").alias("n_done"))
    both = a.join(b, KEYS, "full").fillna(0, ["n_need", "n_done"])
    total = F.col("n_need") + F.col("n_done")
    return both.where(total >= least).select(*KEYS, "n_need", "n_done", (F.col("n_need") / total).alias("backlog"), "median_wait", "idle_share")
