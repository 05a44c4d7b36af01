"""All relational queries by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellscope.plans import base, q_cells, q_files, q_map, q_more, q_rest


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.QUERIES["top1_cells_to_visit"](spark, sf_dir)


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)


__all__ = ["entry", "oracle_sql", "q_cells", "q_files", "q_map", "q_more", "q_rest", "queries"]
