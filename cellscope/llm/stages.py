"""Operators as filters of a corpus: tables of documents in, tables of documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscope.llm import mixing, near_dedup, packing, toxicity
from cellscope.llm.shared import column, unused


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier does not reject, with their own columns. Null and empty texts
    stay, repeated rows share one fate, without usable labels all stay, an empty table stays empty."""
    return toxicity.reject_toxic(docs, labels)


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, with its own columns, whatever their names.

    Documents without words are no group and all stay; of rows with one id, one stays; rows with a
    null id stay; an empty table stays empty.
    """
    kept, again = unused(docs, "__kept"), unused(docs, "__again")
    chosen = near_dedup.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(kept)).distinct()
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias(again))
    rows = docs.join(chosen, docs["doc_id"] == F.col(kept), "left_semi")
    once = rows.join(repeated, rows["doc_id"] == F.col(again), "left_anti")
    twice = rows.join(repeated, rows["doc_id"] == F.col(again), "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(twice).unionByName(docs.where("doc_id IS NULL"))


def mixed(docs: DataFrame) -> DataFrame:
    """Documents repeated by the Poisson counts of their sources, in random order, with their own
    columns only. A null source is a source, a null text is carried, an empty table stays empty."""
    return mixing.mix_sources(docs).select(*[column(c) for c in docs.columns])


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of token sequences; a null or empty text is its end id, repeated rows are packed each,
    an empty table has no pieces."""
    return packing.pack(docs)
