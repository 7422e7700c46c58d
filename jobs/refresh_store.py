"""Keep a store of search chunks in step with a growing table of documents.

    spark-submit jobs/refresh_store.py DOCUMENTS STORE CHECKPOINT [--config FILE]

DOCUMENTS is a Parquet table (doc_id, text, source, ...) to which files are added. Each run takes the files that are new since the last one,
as a stream that ends when it has caught up, and leaves two tables in STORE, in a folder for each of the stream's batches:

    files/batch=B            doc_id, source, sha1: one version of a document
    chunks/batch=B/source=S  sha1, chunk_index, n_tokens, text: the chunks of a content, once

Chunks belong to a content, not to a document: a content that is stored already is not chunked again, whichever document brings it, and
stays as long as the newest version of some document has it. current() is what a search sees: the chunks of all contents that live,
under the smallest id that has them. So it doesn't depend on how the documents came, in one batch or in many.

Safe to run again: the stream's checkpoint says which files a batch has, a batch writes its own partitions only (dynamic partition
overwrite), contents first and files last, and does not look at what it wrote itself. A run without new files writes nothing.

Defined results: rows without doc_id are left out and counted; a null, empty or blank text has no chunks; of several versions of a document in one batch
the one with the least content hash stands, of the same content the least source; a null source is a partition of its own; more columns are ignored.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from jobs.common import command, log, settings
from tessera.functions.text import token_count
from tessera.operators import chunker, files
from tessera.session import prepare

FILES = "doc_id long, source string, sha1 string, batch long"
CHUNKS = "sha1 string, chunk_index int, n_tokens int, text string, batch long, source string"
#: files_per_batch: null takes all that is new in one batch.
DEFAULTS = {"files_per_batch": None, "chunk_tokens": chunker.CHUNK_TOKENS, "overlap_tokens": chunker.OVERLAP_TOKENS}


def _table(spark: SparkSession, store: str, name: str) -> DataFrame:
    return spark.read.schema(FILES if name == "files" else CHUNKS).parquet(f"{store}/{name}")


def versions(rows: DataFrame) -> DataFrame:
    """doc_id, source, sha1: one version of each document of a batch. Texts stay where they are."""
    seen = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("sha1", "source")).alias("v"))
    return seen.select("doc_id", "v.source", "v.sha1")


def fresh_contents(new: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, source, sha1 of the first document of each content that no other batch has."""
    held = new.where("sha1 is not null").withColumn("path", F.lpad(F.col("doc_id").cast("string"), 20, "0"))
    return files.content_dedup(held, known.where("sha1 is not null")).drop("path")


def chunks_of(rows: DataFrame, fresh: DataFrame, config: dict) -> DataFrame:
    """The chunks of the contents in fresh, whose texts are in rows (doc_id, sha1, text)."""
    texts = rows.select("doc_id", "sha1", "text").join(fresh, ["doc_id", "sha1"]).dropDuplicates(["doc_id", "sha1"])
    made = chunker.chunk_blocks(texts, ["sha1", "source"], "text", limit=config["chunk_tokens"], overlap=config["overlap_tokens"])
    return made.select("sha1", F.col("block_chunk").alias("chunk_index"), token_count(F.col("text")).alias("n_tokens"), "text", "source")


def _write(rows: DataFrame, path: str, *by: str) -> None:
    """The partitions that rows have, in place of what was there."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def take(rows: DataFrame, batch: int, store: str, config: dict) -> int:
    """One batch into the store; the number of rows read."""
    spark = rows.sparkSession
    known = _table(spark, store, "files").where(F.col("batch") != batch)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.sha1(F.col("text")).alias("sha1"), "text")
    made = chunks_of(rows, fresh_contents(versions(rows), known), config).withColumn("batch", F.lit(batch).cast("long"))
    _write(made.hint("rebalance", "source"), f"{store}/chunks", "batch", "source")
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nameless"))
    _write(versions(counted).withColumn("batch", F.lit(batch).cast("long")), f"{store}/files", "batch")
    stored = _table(spark, store, "files").where(F.col("batch") == batch).agg(F.count("*").alias("n"), F.count_if(F.col("sha1").isNull()).alias("empty")).first()
    written = _table(spark, store, "chunks").where(F.col("batch") == batch).agg(F.count("*").alias("n"), F.countDistinct("sha1").alias("contents")).first()
    log.info("batch %s: read %s rows (%s without doc_id); wrote %s documents (%s without text), %s new contents with chunks, %s chunks", batch, seen.get["n"], seen.get["nameless"], stored["n"], stored["empty"], written["contents"], written["n"])
    return seen.get["n"]


def current(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, source, copies, chunk_index, n_tokens, text of every content that some document has now."""
    newest = _table(spark, store, "files").groupBy("doc_id").agg(F.max_by(F.struct("sha1", "source"), "batch").alias("v"))
    owners = newest.where("v.sha1 is not null").groupBy(F.col("v.sha1").alias("sha1")).agg(F.min(F.struct("doc_id", F.col("v.source").alias("source"))).alias("o"), F.count("*").alias("copies"))
    return _table(spark, store, "chunks").drop("source", "batch").join(owners, "sha1").select("o.doc_id", "o.source", "copies", "chunk_index", "n_tokens", "text")


def refresh(spark: SparkSession, documents: str, store: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Take what is new in documents, wait for the stream's end, and return current()."""
    prepare(spark)
    config = DEFAULTS | (config or {})
    for name, kind in (("files", FILES), ("chunks", CHUNKS)):  # makes the folders, so that both can be read before the first batch
        spark.createDataFrame([], kind).write.mode("append").partitionBy("batch").parquet(f"{store}/{name}")
    reader = spark.readStream.schema(spark.read.parquet(documents).schema)
    if config["files_per_batch"]:
        reader = reader.option("maxFilesPerTrigger", int(config["files_per_batch"]))
    took: list[int] = []
    # a stream takes folders and patterns; as a pattern of one name, a table of one file will do as well
    name = documents.rstrip("/")
    stream = reader.parquet(f"{name[:-1]}[{name[-1]}]").writeStream.foreachBatch(lambda rows, batch: took.append(take(rows, batch, store, config)))
    query = stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %s rows of %s in %s batches", sum(took), documents, len(took))
    return current(spark, store)


def main(args: list[str] | None = None) -> int:
    paths = {"documents": "a Parquet table of documents", "store": "the folder of the store", "checkpoint": "the folder of the stream's checkpoint"}
    return command("refresh_store", paths, lambda spark, a: refresh(spark, a.documents, a.store, a.checkpoint, settings(spark, a.config, DEFAULTS)), args)


if __name__ == "__main__":
    sys.exit(main())
