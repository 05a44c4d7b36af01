"""Counters of cells over a stream of landed observation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscope.operators.cells import KEYS, binned


def read_landed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def cell_counts(stream: DataFrame, res: float) -> DataFrame:
    """Running counts per cell; late records only add, so update and complete mode are safe."""
    return binned(stream, res).groupBy(*KEYS).agg(F.count("*").alias("n"), F.max("ts").alias("last"))


def daily_counts(stream: DataFrame, res: float, late: str = "2 days") -> DataFrame:
    """Counts per cell and day; the watermark bounds the state, and later records are dropped."""
    windows = binned(stream, res).withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), *KEYS)
    return windows.agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), *KEYS, "n")


def deduplicated(stream: DataFrame, key: str, late: str = "2 days") -> DataFrame:
    """Records of several pulls, once each."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
