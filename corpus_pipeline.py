"""Corpus preparation from end to end: each stage works on what the one before has kept, written as Parquet and read again.

Documents: doc_id, text, lang, source, n_chars. A stage that shortens texts counts n_chars anew. Of repeated rows
one stays; rows that share a doc_id but not their text are documents by themselves. Further columns stay, whatever
their names, up to packing. Null texts are empty, very long ones are taken whole. An empty table passes through all
stages. What a stage has staged on its way goes when its result is written, and that when the next one's is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplework.llm import common, decontamination, entries, line_dedup, near_dedup, packing, quality_net


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labelled ones among them, doesn't reject."""
    net = entries.quality_model(docs, common.table(spark, sf_dir, "labels"))
    return quality_net.score(docs, net, "_rw_score").where("_rw_score >= 0.5").drop("_rw_score")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has; those of which no word is left go."""
    short = line_dedup.dedup_lines(docs, counts=("_rw_lines", "_rw_words"))
    left = short.where((F.col("_rw_words") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    n_chars = F.when(F.col("_rw_words") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).drop("_rw_lines", "_rw_words")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 ids."""
    return packing.digest(packing.pack_documents(docs, entries.vocabulary(), end_id=2))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Training, alignment and differencing aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with common.collected(spark) as keep:
            after = common.staged(stage(spark, docs, sf_dir), name)
            keep.append(after)
        common.discard(spark, docs)
        docs = after
    return docs
