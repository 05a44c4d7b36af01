"""From raw documents to packed sequences: toxicity, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellscope.llm import stages
from cellscope.llm.shared import spool


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.one_of_each_group(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.packed(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]
#: The first stage is a trained model, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = spool(docs, name)
    return docs
