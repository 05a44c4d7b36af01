"""The domain's tables as views of the driver's tables, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT = "1998-07-01"
RES = 1.0
COARSE = 2.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations: (id, lat, lon, taxon, day, rank, grp)."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (41 + F.col("l_suppkey") * 7919 % 4300 / 100.0).alias("lat"), (-141 + F.col("l_orderkey") * 104729 % 8900 / 100.0).alias("lon"),
        F.col("l_partkey").alias("taxon"), F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("rank"), F.col("l_linestatus").alias("grp"),
    )


OBS = """obs AS (SELECT l_orderkey*10+l_linenumber AS id, 41+((l_suppkey*7919)%4300)/100.0e0 AS lat, -141+((l_orderkey*104729)%8900)/100.0e0 AS lon,
 l_partkey AS taxon, CAST(l_shipdate AS DATE) AS day, l_returnflag AS rank, l_linestatus AS grp FROM lineitem)"""
#: Every rank of the view is species-level.
RANKS = ("A", "N", "R")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with vectors: (vec_id, species, lat, lon, embedding)."""
    t = table(spark, sf_dir, "embeddings")
    return t.select("vec_id", F.col("label").alias("species"), (41 + F.col("vec_id") * 7919 % 4300 / 100.0).alias("lat"), (-141 + F.col("vec_id") * 104729 % 8900 / 100.0).alias("lon"), "embedding")


POOL = "pool AS (SELECT vec_id, label AS species, 41+((vec_id*7919)%4300)/100.0e0 AS lat, -141+((vec_id*104729)%8900)/100.0e0 AS lon, embedding FROM embeddings)"


def cells_sql(res: float, split: str = SPLIT, k: int = 5, by: str = "") -> str:
    """CTEs obs, binned, taxa, raw and cells, as ``backtest_cells`` makes them."""
    b = f"{by}, " if by else ""
    parts = " * ".join(f"(greatest(r.n_test - n.n_after - {i}, 0) / CAST(greatest(r.n_test - {i}, 1) AS DOUBLE))" for i in range(k))
    on = f"{b}gi, gj"
    return f"""{OBS},
binned AS (SELECT *, CAST(floor(lat/{res}) AS INT) AS gi, CAST(floor(lon/{res}) AS INT) AS gj FROM obs),
taxa AS (SELECT {b}gi, gj, taxon, count(*) FILTER (WHERE day < DATE '{split}') AS n_before, count(*) FILTER (WHERE day >= DATE '{split}') AS n_after, max(day) FILTER (WHERE day < DATE '{split}') AS last FROM binned GROUP BY ALL),
raw AS (SELECT {b}gi, gj, CAST(sum(n_before) AS BIGINT) AS n_train, max(last) AS last, count(*) FILTER (WHERE n_before=1) AS f1, count(*) FILTER (WHERE n_before=2) AS f2, CAST(sum(n_after) AS BIGINT) AS n_test, count(*) FILTER (WHERE n_before=0 AND n_after>0) AS new_species FROM taxa GROUP BY ALL HAVING sum(n_before) > 0),
newt AS (SELECT {on}, n_after FROM taxa WHERE n_before=0 AND n_after>0),
rare AS (SELECT {', '.join('r.' + c.strip() for c in on.split(','))}, CASE WHEN any_value(r.n_test) >= {k} THEN round(coalesce(sum(CASE WHEN n.n_after IS NOT NULL THEN 1 - {parts} END), 0) + 1e-12, 9) END AS rare_newK FROM raw r LEFT JOIN newt n USING ({on}) GROUP BY ALL),
c0 AS (SELECT {on}, (gi+0.5e0)*{res} AS clat, (gj+0.5e0)*{res} AS clon, n_train, CAST(date_diff('day', last, DATE '{split}') AS BIGINT) AS days_since, greatest(0.0e0, CASE WHEN f2>0 THEN f1*f1/(2.0e0*f2) ELSE f1*(f1-1)/2.0e0 END) AS chao_unseen, n_test, new_species, n_test>0 AS revisited, CAST(new_species AS DOUBLE)/nullif(n_test,0) AS new_rate, rare_newK FROM raw JOIN rare USING ({on})),
cells AS (SELECT *, (scarcity+staleness)/2 AS priority FROM (SELECT *, coalesce((1.0e0/n_train - min(1.0e0/n_train) OVER ()) / nullif(max(1.0e0/n_train) OVER () - min(1.0e0/n_train) OVER (), 0), 0) AS scarcity, coalesce(CAST(days_since - min(days_since) OVER () AS DOUBLE) / nullif(max(days_since) OVER () - min(days_since) OVER (), 0), 0) AS staleness, coalesce(CAST(n_train - min(n_train) OVER () AS DOUBLE) / nullif(max(n_train) OVER () - min(n_train) OVER (), 0), 0) AS density FROM c0))"""
