"""Indexing as a stream: new files of a folder become micro-batches, each committed before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.plans.catalog import Project
from tessera.plans.indexer import Indexer, Models

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, project: Project, checkpoint: str, models: Models | None = None, files_per_batch: int = 256, once: bool = False) -> StreamingQuery:
    """Index what appears in a folder. once: take what is there now and stop.

    Spark's file source skips names that begin with . or _ and takes a path once; changed and deleted files are
    reindex()'s work.
    """
    project.create((models or Models()).make_embedder().dim)
    project.add_source(folder)
    stream = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    names = stream.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("us"))

    def take(rows: DataFrame, _: int) -> None:
        Indexer(spark, project, models).index_files(rows.select("path", "size", (F.col("us") / 1e6).alias("mtime")))

    writer = names.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def with_rates(progress: DataFrame, key: str = "job_id", order: str = "seq", done: str = "made", seconds: str = "seconds", total: str = "total") -> DataFrame:
    """Progress rows with done_so_far and eta: what is left over the mean rate of the last ten, at least 1."""
    own = Window.partitionBy(key).orderBy(order)
    sofar = F.sum(done).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rate = F.avg(F.col(done) / F.greatest(F.col(seconds), F.lit(1e-6))).over(own.rowsBetween(-9, Window.currentRow))
    return progress.withColumn("done_so_far", sofar).withColumn("eta", F.greatest(F.lit(0), F.col(total) - sofar) / F.greatest(rate, F.lit(1.0)))
