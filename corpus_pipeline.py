"""From documents to a training mix: each stage works on all that the one before kept, and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, jaccard, langid, mixing, suffix_dedup
from tessera.llm.common import read_table, stage_table
from tessera.session import prepare


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language is not told clearly."""
    prepare(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    prepare(spark)
    return jaccard.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages that an earlier document has."""
    prepare(spark)
    return suffix_dedup.cut_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage of the benchmark."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each once, with how many times it is taken in copies."""
    prepare(spark)
    return mixing.mixed_documents(docs)


STAGES = [("language_id", language_id), ("jaccard_join", jaccard_join), ("suffix_array_dedup", suffix_array_dedup), ("decontamination", decontamination), ("source_mixing", source_mixing)]

#: SQL can't express the first stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage_table(docs, name)
    return docs
