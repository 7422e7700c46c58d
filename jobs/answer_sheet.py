"""Answer a table of questions from a table of documents: the sheet of each question's best documents by BM25.

    spark-submit jobs/answer_sheet.py QUESTIONS DOCUMENTS SHEET [--config FILE]

QUESTIONS is a Parquet table (item_id, text), a stated set that fits the driver; DOCUMENTS a Parquet table (doc_id, text, source, lang, ...) of
any size. SHEET is Parquet, partitioned by shard (the question's id modulo shards):

    question_id, rank, doc_id, source, lang, bm25, known_terms, asked_terms

A question that no document answers has one row without rank and document. known_terms are those of its asked_terms (different ones) that the
document found has. Documents are read twice, for counts and for scores; what is shuffled is k rows a question and task.

Safe to run again: the sheet is replaced as a whole by the same rows.

Defined results: questions and documents without an id take no part; of several questions of one id all tokens count together; a null text has no
terms; a document in several rows is found once for each row that is among the best, and its source and lang are the least of its rows'.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from jobs.common import command, log, settings
from tessera.functions.text import index_terms
from tessera.operators import bm25
from tessera.session import prepare

SHEET = "question_id long, rank int, doc_id long, source string, lang string, bm25 double, known_terms int, asked_terms int, shard int"
DEFAULTS = {"k": 10, "shards": 8}


def best(questions: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """question_id, doc_id, bm25, rank of the k best documents of each question."""
    return bm25.best_of_texts(documents.where("doc_id is not null"), bm25.asked_by(questions, "question_id", "text"), k, "doc_id").withColumnsRenamed({"query_id": "question_id", "chunk_id": "doc_id"})


def sheet_of(questions: DataFrame, documents: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The sheet's rows, without shard."""
    asked = questions.select("question_id", F.explode_outer(index_terms(F.col("text"))).alias("term")).groupBy("question_id").agg(F.collect_set("term").alias("asked"))
    # of the documents only those found come on: k for each question
    wanted = found.select("doc_id").distinct()
    rows = documents.join(F.broadcast(wanted) if k * questions.count() <= 1_000_000 else wanted, "doc_id", "left_semi")
    about = rows.groupBy("doc_id").agg(F.min("source").alias("source"), F.min("lang").alias("lang"), F.array_distinct(F.flatten(F.collect_list(index_terms(F.col("text"))))).alias("terms"))
    sheet = asked.join(found, "question_id", "left").join(about, "doc_id", "left")
    known = F.when(F.col("doc_id").isNotNull(), F.size(F.array_intersect("asked", F.coalesce("terms", F.array().cast("array<string>")))))
    return sheet.select("question_id", "rank", "doc_id", "source", "lang", F.round("bm25", 8).alias("bm25"), known.alias("known_terms"), F.size("asked").alias("asked_terms"))


def answer(spark: SparkSession, questions: str, documents: str, sheet: str, config: dict | None = None) -> DataFrame:
    """Write the sheet and return it as it stands."""
    prepare(spark)
    config = DEFAULTS | (config or {})
    asked = spark.read.parquet(questions).select(F.col("item_id").cast("long").alias("question_id"), "text").where("question_id is not null")
    texts = spark.read.parquet(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang")
    k, shards = int(config["k"]), int(config["shards"])
    found = best(asked, texts, k).persist()  # k rows a question, used twice
    try:
        rows = sheet_of(asked, texts, found, k).withColumn("shard", F.pmod("question_id", F.lit(shards)).cast("int"))
        rows.write.mode("overwrite").partitionBy("shard").parquet(sheet)
    finally:
        found.unpersist()
    written = spark.read.schema(SHEET).parquet(sheet)
    counts = written.agg(F.countDistinct("question_id").alias("questions"), F.count("rank").alias("answers"), F.count_if(F.col("rank").isNull()).alias("open")).first()
    log.info("read %s questions of %s and the documents of %s; wrote %s answers, %s questions without one, to %s", counts["questions"], questions, documents, counts["answers"], counts["open"], sheet)
    return written


def main(args: list[str] | None = None) -> int:
    paths = {"questions": "a Parquet table of questions", "documents": "a Parquet table of documents", "sheet": "the folder to write"}
    return command("answer_sheet", paths, lambda spark, a: answer(spark, a.questions, a.documents, a.sheet, settings(spark, a.config, DEFAULTS)), args)


if __name__ == "__main__":
    sys.exit(main())
