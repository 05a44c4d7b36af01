"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscope.llm.shared import drop_spooled, spool


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (id, component): the smallest id reachable, for ids that have a link.

    Every step needs only minima by key, which are pre-aggregated, and equi-joins, which adaptive
    execution can split; no neighbour list is gathered. Each round is written to the shared
    folder. Null ids and loops are dropped; repeated links count once.
    """
    now = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = spool(now, "links")
    state = None
    while True:
        # large star: hang larger neighbours of each node on the smallest of its neighbourhood
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = spool(large, "large")
        # small star: hang the smaller neighbours, and the node, on the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, now = now, spool(small.where("u <> v").distinct(), "small")
        drop_spooled(before)
        drop_spooled(large)
        # stable when every node has one parent and no parent has one
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == (mark["n"], mark["h"]):
            break
        if not mark["n"] or not now.select("v").intersect(now.select("u")).limit(1).count() and now.groupBy("u").count().where("count > 1").limit(1).count() == 0:
            break
        state = (mark["n"], mark["h"])
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
