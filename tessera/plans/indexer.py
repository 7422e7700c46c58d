"""Indexing: folders and changed folders into a project, in batches that are searchable as soon as they are committed.

Files are hashed and parsed by the executors, equal contents of one format once. What becomes of a file (unchanged, update, duplicate, new),
its display name and its chunks' numbers are joins and aggregates over tables of files, after parsing: a file that fails or has no
text claims neither a content nor a name. To the driver come counts, and the paths of a few files that failed.
"""

from __future__ import annotations

import os
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import basename, estimated_chunks, eta_words, suffix
from tessera.operators import bm25, chunker, embed, knn
from tessera.operators.files import changes, classify, counters, display_names, path_order, under_sources, union
from tessera.plans.catalog import Project
from tessera.sources import files as scan
from tessera.sources.parsers import Registry
from tessera.sources.storage import Store

#: Files of a batch and bytes of them, for each core: a larger cluster commits larger batches and not more of them.
BATCH_FILES, BATCH_BYTES = 512, 16 << 20
#: Paths that a result names, of those that failed and of those of old formats.
NAMED = 100
Progress = Callable[[int, int, str], None]


@dataclass
class IndexResult:
    files_indexed: int = 0
    files_skipped_same: int = 0
    files_unchanged: int = 0
    files_renamed: int = 0
    files_updated: int = 0
    files_failed: int = 0
    files_empty: int = 0
    files_deleted: int = 0
    chunks_created: int = 0
    legacy_files: list[str] = field(default_factory=list)  # the first NAMED in path order
    missing_sources: list[str] = field(default_factory=list)
    errors: dict[str, str] = field(default_factory=dict)

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class Models:
    """What an index is made with; all are made anew by each worker."""

    make_embedder: Callable = embed.HashingEmbedder
    make_tokenizer: Callable = chunker.WordTokenizer
    registry: Registry | None = None
    chunk_tokens: int = chunker.CHUNK_TOKENS
    overlap_tokens: int = chunker.OVERLAP_TOKENS


class Indexer:
    def __init__(self, spark: SparkSession, project: Project, models: Models | None = None, progress: Progress | None = None):
        self.spark, self.project, self.models = spark, project, models or Models()
        self.progress = progress or (lambda done, total, message: None)

    def index_folder(self, folder: str) -> IndexResult:
        """Add a folder's files. Files that have gone stay; reindex() removes them."""
        folder = os.path.abspath(os.path.expanduser(folder))
        if not os.path.isdir(folder):
            raise FileNotFoundError(folder)
        with self._stage() as store:
            listing = self._staged(scan.list_folder(self.spark, folder), store, "found")
            self.project.add_source(folder)
            result = IndexResult(legacy_files=[r["path"] for r in scan.legacy(listing).orderBy(path_order()).limit(NAMED).collect()])
            return self._batches(scan.supported(listing), result, store)

    def index_files(self, listing: DataFrame) -> IndexResult:
        """Add or update files given as path, size and mtime."""
        with self._stage() as store:
            return self._batches(scan.supported(listing), IndexResult(), store)

    def reindex(self) -> IndexResult:
        """Bring the project in line with its folders: delete, update and add. A folder that is missing keeps its files."""
        sources = self.project.sources()
        live = [s for s in sources if os.path.isdir(s)]
        result = IndexResult(missing_sources=[s for s in sources if s not in live])
        if not live:
            raise FileNotFoundError("no source folder is left: " + ", ".join(sources))
        with self._stage() as store:
            listing = self._staged(scan.supported(union([scan.list_folder(self.spark, s) for s in live])), store, "found")
            files = self.project.files()
            gone = changes(listing.select("path", F.lit(None).cast("string").alias("sha1")), files.select("path", "sha1")).where("change = 'deleted'").select("path")
            gone = under_sources(gone, live).join(files.select("path", "chunk_count"), "path")
            count, chunks = gone.agg(F.count("*"), F.coalesce(F.sum("chunk_count"), F.lit(0))).first()
            if count:
                self.project.commit({"tombstones": gone.select("path")}, 0, chunks)
                result.files_deleted = count
            return self._batches(listing, result, store)

    @contextmanager
    def _stage(self) -> Iterator[Store]:
        """A folder of its own for what a run keeps in between."""
        store = Store(self.spark, f"{self.project.store.root}/_stage-{uuid.uuid4().hex}")
        try:
            yield store
        finally:
            store.delete()

    @staticmethod
    def _staged(rows: DataFrame, store: Store, name: str) -> DataFrame:
        rows.write.parquet(f"{store.root}/{name}")
        return rows.sparkSession.read.schema(rows.schema).parquet(f"{store.root}/{name}")

    def _batches(self, listing: DataFrame, result: IndexResult, store: Store) -> IndexResult:
        hashed = self._staged(scan.with_hashes(listing), store, "listing")  # contents are read once
        met = hashed.join(self.project.files().select("path", F.col("sha1").alias("old")), "path", "left")
        open_ = F.col("sha1").isNotNull() & ~F.coalesce(F.col("old") == F.col("sha1"), F.lit(False))
        facts = met.agg(F.count_if(F.col("sha1").isNull()).alias("failed"), F.count_if(F.col("old") == F.col("sha1")).alias("same"), F.count_if(open_).alias("n"), F.coalesce(F.sum(F.when(open_, F.col("size"))), F.lit(0)).alias("bytes"), estimated_chunks(F.sum(F.when(open_, F.col("size")))).alias("chunks")).first()
        result.files_unchanged += facts["same"]
        result.files_failed += facts["failed"]
        if facts["failed"]:
            result.errors |= {r["path"]: "can't be read" for r in hashed.where("sha1 is null").orderBy(path_order()).limit(NAMED).collect()}
        cores = self.spark.sparkContext.defaultParallelism
        parts = max(-(-facts["n"] // (BATCH_FILES * cores)), -(-facts["bytes"] // (BATCH_BYTES * cores)))
        todo = met.where(open_).drop("old")
        if parts > 1:  # runs of files in path order
            placed = todo.repartitionByRange(parts, path_order()).withColumn("part", F.spark_partition_id())
            placed.write.partitionBy("part").parquet(f"{store.root}/todo")
            todo = self.spark.read.schema(placed.schema).parquet(f"{store.root}/todo")
        rates: deque[float] = deque(maxlen=10)
        done = 0
        for k in range(parts):
            began = time.monotonic()
            made = self._batch(todo.where(F.col("part") == k).drop("part") if parts > 1 else todo, result, Store(self.spark, f"{store.root}/{k}"))
            done += made
            rates.append(made / max(time.monotonic() - began, 1e-6))
            left = max(0, facts["chunks"] - done) / max(sum(rates) / len(rates), 1)
            self.progress(done, max(facts["chunks"], done), f"{k + 1} of {parts} batches, {eta_words(left)} left")
        return result

    def _batch(self, part: DataFrame, result: IndexResult, store: Store) -> int:
        m, models = self.project.manifest(), self.models
        known = self._staged(self.project.files().select("path", F.col("sha1"), F.col("display_name").alias("old_name"), F.col("chunk_count").alias("old_chunks")), store, "known")
        # contents that files outside this batch keep make no new file; of the others one file each is parsed
        kept = known.join(part.select("path"), "path", "left_anti").select("sha1").distinct()
        kind = suffix(F.col("path"))
        wanted = part.join(known.select("path"), "path", "left_semi").unionByName(part.join(known.select("path"), "path", "left_anti").join(kept, "sha1", "left_anti").select(part.columns))
        chosen = self._staged(wanted.groupBy("sha1", kind.alias("kind")).agg(F.min_by("path", path_order()).alias("parsed")), store, "chosen")
        tasks = min(chosen.count(), 4 * self.spark.sparkContext.defaultParallelism) or 1
        blocks = scan.parse_files(chosen.select(F.col("parsed").alias("path")).repartition(tasks), models.registry, lambda rows: self._staged(rows, store, "layers"))
        blocks = self._staged(blocks, store, "blocks")
        chunks = chunker.chunk_blocks(blocks.where("error is null"), ["path", "block_no", "page"], "text", models.make_tokenizer, models.chunk_tokens, models.overlap_tokens)
        chunks = self._staged(chunks, store, "chunks")
        got = chunks.groupBy(F.col("path").alias("parsed")).agg(F.count("*").cast("int").alias("chunk_count"))
        errors = blocks.where("error is not null").select(F.col("path").alias("parsed"), "error")
        state = F.when(F.col("error").isNotNull(), "failed").when(F.col("parsed").isNull() | (F.col("chunk_count") > 0), "ok").otherwise("empty")
        files = part.withColumn("kind", kind).join(chosen, ["sha1", "kind"], "left").join(got, "parsed", "left").join(errors, "parsed", "left").withColumn("state", state)
        decided = self._staged(classify(files, known).join(known.drop("sha1"), "path", "left"), store, "decided")
        names = display_names(decided.where("action = 'new'").select("path"), known.select(F.col("old_name").alias("display_name")))
        before = Window.orderBy(path_order()).rowsBetween(Window.unboundedPreceding, -1)  # the files of one batch
        taken = decided.where("action in ('new', 'update')").join(names, "path", "left").withColumn("display_name", F.coalesce("old_name", "display_name"))
        taken = taken.withColumn("first_chunk", F.lit(m.next_chunk_id) + F.coalesce(F.sum("chunk_count").over(before), F.lit(0)))
        taken = self._staged(taken.select("path", "parsed", "sha1", "mtime", "chunk_count", "display_name", "first_chunk"), store, "taken").withColumn("indexed_at", F.lit(time.time()).cast("timestamp"))

        gone = F.col("old_name").isNotNull() & F.col("action").isin("update", "empty")
        # an update keeps its name, so it is no renaming
        told = decided.join(taken.select("path", "display_name"), "path", "left").withColumn("display_name", F.when(F.col("action") == "new", F.col("display_name")).otherwise(basename(F.col("path"))))
        sums = decided.agg(F.count_if(F.col("action") == "failed").alias("failed"), F.count_if(F.col("action") == "empty").alias("empty"), F.count_if(gone).alias("gone"), F.coalesce(F.sum(F.when(gone, F.col("old_chunks"))), F.lit(0)).alias("dead"), F.coalesce(F.sum(F.when(F.col("action").isin("new", "update"), F.col("chunk_count"))), F.lit(0)).alias("chunks"))
        row = counters(told).join(sums).first()  # one row each
        tables: dict[str, DataFrame] = {}
        if row["gone"]:
            tables["tombstones"] = decided.where(gone).select("path")
        if row["indexed"]:
            numbered = chunker.number_chunks(chunks.withColumnRenamed("path", "parsed"), "parsed", "block_no").join(taken, "parsed")
            full = numbered.select((F.col("first_chunk") + F.col("chunk_index")).alias("chunk_id"), F.col("path").alias("file_path"), F.col("sha1").alias("file_hash"), "display_name", "page", "chunk_index", "text", "indexed_at")
            embedded = lambda rows: rows.select("chunk_id", embed.embed(F.col("text"), models.make_embedder).alias("embedding"))
            share = max(1, row["chunks"] // knn.SAMPLE)
            sample = lambda: self._staged(embedded(full.where(F.pmod(F.xxhash64("chunk_id"), F.lit(share)) == 0)), store, "sample")
            tables |= {"chunks": full, "vectors": self.project.grouped(embedded(full), m.live_chunks + row["chunks"], sample), "postings": bm25.postings(full), "lengths": bm25.lengths(full), "files": taken}
        if tables:
            self.project.commit(tables, row["chunks"], row["dead"])
        result.files_indexed += row["indexed"] - row["updated"]
        result.files_updated += row["updated"]
        result.files_renamed += row["renamed"]
        result.files_skipped_same += row["skipped"]
        result.files_failed += row["failed"]
        result.files_empty += row["empty"]
        result.chunks_created += row["chunks"]
        if row["failed"] and len(result.errors) < NAMED:
            result.errors |= {r["path"]: r["error"] for r in decided.where("action = 'failed'").orderBy(path_order()).limit(NAMED - len(result.errors)).collect()}
        return row["chunks"]
