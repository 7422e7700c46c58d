"""Projects: named, persistent indexes made of Parquet batches and a manifest.

A batch is one folder in each table and one number. A commit writes the batch's files first and then replaces the
manifest, so a reader sees all of a batch or nothing of it, and a batch whose commit never came is ignored. A row lives unless a later
batch has a tombstone for its path, so an update is one batch with the tombstone and the new rows. A file's chunks have
consecutive ids, so what is dead in the postings is told by ids, which are broadcast while they are few.
Vectors are sorted by group, postings by term, so that the filter of a query skips what lies elsewhere; beside them stand the groups' radii, how many chunks of a block have a
term and the highest tf and least length there. A commit that takes chunks away adds rows with what they had, less than nothing, so that
these counts, and those of chunks and terms in the manifest, hold for what lives.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema
from tessera.operators import bm25, knn
from tessera.operators.files import file_counts, path_order
from tessera.session import aside
from tessera.sources.storage import Store

TABLES = {"chunks": schema.CHUNKS, "vectors": schema.VECTORS, "groups": schema.GROUPS, "postings": schema.POSTINGS, "lengths": schema.LENGTHS, "terms": schema.TERMS, "files": schema.FILES, "tombstones": schema.TOMBSTONES}


#: Layout of a project's tables. 1: without terms and first chunks of files. 2: without blocks, and with vectors in the
#: chunks' table. compact() brings a project to this one, and so does the first commit to it.
VERSION = 3
#: Dead chunks whose ids are broadcast, 8 bytes each; beyond, they are joined.
DEAD = 1_000_000
SALTS = 16


def safe_name(name: str) -> str:
    return re.sub("[^A-Za-z0-9_-]", "_", name.strip()).strip("_") or "project"


def now_iso() -> str:
    return datetime.now(UTC).isoformat()


@dataclass
class Manifest:
    name: str
    dim: int
    batches: list[int] = field(default_factory=list)
    tables: dict[str, list[int]] = field(default_factory=dict)  # batches that have rows of a table
    next_batch: int = 1
    next_chunk_id: int = 1
    source_paths: list[str] = field(default_factory=list)
    last_indexed_at: str | None = None
    settings: dict[str, str] = field(default_factory=dict)
    dead_chunks: int = 0
    version: int = 1
    live_chunks: int = 0  # from version 3 on: chunks that live, and their terms
    live_terms: int = 0


class Project:
    def __init__(self, spark: SparkSession, home: str, name: str):
        self.spark, self.name = spark, safe_name(name)
        self.store = Store(spark, f"{home.rstrip('/')}/{self.name}")

    def exists(self) -> bool:
        return self.store.exists("manifest.json")

    def create(self, dim: int) -> Project:
        if not self.exists():
            self.save(Manifest(self.name, dim, version=VERSION))
        return self

    def manifest(self) -> Manifest:
        return Manifest(**json.loads(self.store.read("manifest.json")))

    def save(self, manifest: Manifest) -> None:
        self.store.replace("manifest.json", json.dumps(asdict(manifest)))

    def sources(self) -> list[str]:
        return self.manifest().source_paths

    def has_source(self, path: str) -> bool:
        return path in self.sources()

    def setting(self, key: str, default: str | None = None) -> str | None:
        return self.manifest().settings.get(key, default)

    def set_setting(self, key: str, value: str) -> None:
        m = self.manifest()
        m.settings[key] = value
        self.save(m)

    def file_by_path(self, path: str) -> dict | None:
        return self._one(self.files().where(F.col("path") == path))

    def file_by_hash(self, sha1: str) -> dict | None:
        """The first in path order of the files with some content."""
        return self._one(self.files().where(F.col("sha1") == sha1))

    def name_in_use(self, display_name: str, other_than: str | None = None) -> bool:
        rows = self.files().where(F.col("display_name") == display_name)
        return bool((rows if other_than is None else rows.where(F.col("path") != other_than)).limit(1).count())

    @staticmethod
    def _one(rows: DataFrame) -> dict | None:
        row = rows.orderBy(path_order()).first()
        return row.asDict() if row else None

    def add_source(self, path: str) -> None:
        m = self.manifest()
        if path not in m.source_paths:
            m.source_paths.append(path)
            self.save(m)

    def table(self, name: str, manifest: Manifest | None = None) -> DataFrame:
        """All rows of the committed batches, with their batch."""
        m = manifest or self.manifest()
        kind = schema.struct(TABLES[name])
        paths = [f"{self.store.root}/{name}/batch={b}" for b in m.tables.get(name, ())]
        if not paths:
            return self.spark.createDataFrame([], kind).withColumn("batch", F.lit(0).cast("long"))
        return self._read(paths, name, kind)

    def _read(self, paths: list[str], name: str, kind) -> DataFrame:
        rows = self.spark.read.schema(kind.add("batch", "long")).option("basePath", f"{self.store.root}/{name}").parquet(*paths)
        return rows.select(*[f.name for f in kind if f.name != "batch"], "batch")

    def _dead(self, manifest: Manifest) -> DataFrame:
        return self.table("tombstones", manifest).groupBy("path").agg(F.max("batch").alias("until"))

    def live(self, name: str, path: str, manifest: Manifest | None = None) -> DataFrame:
        m = manifest or self.manifest()
        if not m.tables.get("tombstones"):
            return self.table(name, m).drop("batch")
        rows, dead = self.table(name, m), self._dead(m).withColumnRenamed("path", "__path")
        return rows.join(dead, (F.col(path) == F.col("__path")) & (F.col("batch") < F.col("until")), "left_anti").drop("batch")

    def chunks(self, manifest: Manifest | None = None) -> DataFrame:
        return self.live("chunks", "file_path", manifest)

    def vectors(self, manifest: Manifest | None = None) -> DataFrame:
        """chunk_id, grp, far, embedding of the chunks that live."""
        m = manifest or self.manifest()
        if m.version < 3:
            kind = schema.struct(f"{schema.CHUNKS}, embedding array<float>")
            paths = [f"{self.store.root}/chunks/batch={b}" for b in m.tables.get("chunks", ())]
            rows = self._read(paths, "chunks", kind).join(self.live("chunks", "file_path", m).select("chunk_id"), "chunk_id", "left_semi") if paths else self.spark.createDataFrame([], kind)
            return rows.select("chunk_id", F.lit(knn.UNGROUPED).alias("grp"), F.lit(0.0).alias("far"), "embedding")
        return self._without_dead(self.table("vectors", m).drop("batch"), m)

    def centres(self) -> np.ndarray | None:
        """Centres of the vectors' groups, if there are some yet."""
        if not self.store.exists("centres"):
            return None
        rows = self.spark.read.schema(schema.struct(schema.CENTRES)).parquet(f"{self.store.root}/centres").orderBy("grp").collect()
        return np.array([r["centre"] for r in rows], np.float64)

    def groups(self, manifest: Manifest | None = None) -> knn.Groups | None:
        """The groups of vectors, one row each."""
        m, found = manifest or self.manifest(), self.centres()
        if m.version < 3:
            return None
        found = np.zeros((0, m.dim)) if found is None else found
        rows = self.table("groups", m).groupBy("grp").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).orderBy("grp").collect()
        return knn.Groups.made([(r["grp"], r["radius"], r["n"]) for r in rows], found)

    def grouped(self, vectors: DataFrame, total: int, sample: Callable[[], DataFrame] | None = None) -> DataFrame:
        """vectors (chunk_id, embedding) with their groups. total: how many there are, with those stored; few need no groups.

        sample: makes some of the vectors, for the centres, if there are none yet."""
        found = self.centres()
        if found is None and total <= knn.FEW:
            return vectors.select("chunk_id", F.lit(knn.UNGROUPED).alias("grp"), F.lit(0.0).alias("far"), "embedding")
        if found is None:
            found = knn.centres(sample() if sample else vectors, total=total)
            rows = [(k, c.tolist()) for k, c in enumerate(found)]
            self.spark.createDataFrame(rows, schema.CENTRES).write.mode("overwrite").parquet(f"{self.store.root}/centres")
        return vectors.withColumn("g", knn.group_of(F.col("embedding"), found)).select("chunk_id", "g.grp", "g.far", "embedding")

    def files(self) -> DataFrame:
        return self.live("files", "path")

    def index(self, manifest: Manifest | None = None) -> tuple[DataFrame, DataFrame]:
        """Postings and lengths of the chunks that live."""
        m = manifest or self.manifest()
        return tuple(self._without_dead(self.table(t, m).drop("batch"), m) for t in ("postings", "lengths"))

    def _without_dead(self, rows: DataFrame, m: Manifest) -> DataFrame:
        """rows (chunk_id, ...) of the chunks that live."""
        if not m.tables.get("tombstones"):
            return rows
        if m.version < 2:
            return rows.join(self.live("chunks", "file_path", m).select("chunk_id"), "chunk_id", "left_semi")
        dead = self._dead(m).withColumnRenamed("path", "__path")
        gone = self.table("files", m).join(dead, (F.col("path") == F.col("__path")) & (F.col("batch") < F.col("until")))
        ids = gone.select(F.explode(F.sequence("first_chunk", F.col("first_chunk") + F.col("chunk_count") - 1)).alias("chunk_id"))
        return rows.join(F.broadcast(ids) if m.dead_chunks <= DEAD else ids, "chunk_id", "left_anti")

    def facts(self, manifest: Manifest | None = None) -> tuple[int, int] | None:
        """Chunks that live, and their terms, if that is known without counting."""
        m = manifest or self.manifest()
        return (m.live_chunks, m.live_terms) if m.version >= 3 else None

    def term_bounds(self, terms: list[str], manifest: Manifest | None = None, table: DataFrame | None = None) -> list[tuple] | None:
        """Rows of bm25.bounds() for some terms: one for each term and block. What has gone counts less than nothing. table: the terms', if it is at hand."""
        m = manifest or self.manifest()
        if m.version < 3:
            return None
        rows = (self.table("terms", m) if table is None else table).where(F.col("term").isin(*terms)).groupBy("term", "block").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))
        return [tuple(r) for r in rows.collect()] if terms else []

    def commit(self, tables: dict[str, DataFrame], chunks: int, dead_chunks: int = 0) -> int:
        """Write a batch's tables, then make them seen. Of the postings, and of those that go, the terms' table is made, and of vectors the groups'."""
        if self.manifest().version < VERSION:
            self.compact()
        m = self.manifest()
        batch = m.next_batch
        gone = None
        if "tombstones" in tables and m.tables.get("chunks"):
            gone = self._gone(tables["tombstones"], m)
        self._write(tables, batch, gone)
        m.batches.append(batch)
        for name in (*tables, *(["terms"] if "postings" in tables or gone is not None else []), *(["groups"] if "vectors" in tables else [])):
            m.tables.setdefault(name, []).append(batch)
        m.next_batch, m.next_chunk_id, m.last_indexed_at = batch + 1, m.next_chunk_id + chunks, now_iso()
        m.dead_chunks += dead_chunks
        added = bm25.corpus_facts(self._of("lengths", batch)) if "lengths" in tables else (0, 0)
        lost = bm25.corpus_facts(bm25.lengths(gone)) if gone is not None else (0, 0)
        m.live_chunks, m.live_terms = m.live_chunks + added[0] - lost[0], m.live_terms + added[1] - lost[1]
        self.save(m)
        return batch

    def _gone(self, tombstones: DataFrame, m: Manifest) -> DataFrame:
        """The chunks that live and go with these tombstones. Paths and ids are joined; texts are shuffled only if these are many."""
        paths = tombstones.select(F.col("path").alias("file_path")).distinct()
        ids = self.live("chunks", "file_path", m).select("file_path", "chunk_id").join(paths, "file_path", "left_semi").select("chunk_id")
        return self.table("chunks", m).drop("batch").join(F.broadcast(ids) if ids.count() <= DEAD else ids, "chunk_id", "left_semi")

    def _of(self, name: str, batch: int) -> DataFrame:
        return self.spark.read.schema(schema.struct(TABLES[name])).parquet(f"{self.store.root}/{name}/batch={batch}")

    def _write(self, tables: dict[str, DataFrame], batch: int, gone: DataFrame | None = None) -> None:
        """All tables of a batch side by side, then those that are made of them."""
        for done in [aside(lambda name=name, rows=rows: self._write_one(name, rows, batch)) for name, rows in tables.items()]:
            done()
        made: dict[str, DataFrame] = {}
        if "vectors" in tables:
            made["groups"] = self._of("vectors", batch).groupBy("grp").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
        if "postings" in tables:
            made["terms"] = bm25.bounds(self._of("postings", batch))
        if gone is not None:
            less = bm25.bounds(bm25.postings(gone).withColumn("block", bm25.block_of(F.col("chunk_id")))).select("term", "block", (-F.col("df")).alias("df"), F.lit(None).cast("int").alias("max_tf"), F.lit(None).cast("int").alias("min_dl"))
            made["terms"] = made["terms"].unionByName(less) if "terms" in made else less
        for done in [aside(lambda name=name, rows=rows: self._write_one(name, rows, batch)) for name, rows in made.items()]:
            done()

    def _write_one(self, name: str, rows: DataFrame, batch: int) -> None:
        if name != "postings":
            rows = rows.select(*schema.struct(TABLES[name]).names)
        else:  # by term, so that a query's filter reads only where its terms lie
            # a common term is in SALTS files, so that no task has it whole
            rows = rows.select("chunk_id", "term", "tf", "positions", "dl").repartition("term", F.pmod("chunk_id", F.lit(SALTS))).sortWithinPartitions("term", "chunk_id")
            rows = rows.withColumn("block", bm25.block_of(F.col("chunk_id"))).select(*schema.struct(TABLES[name]).names)
        if name == "terms":
            rows = rows.sortWithinPartitions("term", "block")
        if name == "vectors":  # by group, so that a search reads the groups it needs; a large one is in SALTS files
            rows = rows.repartition("grp", F.pmod("chunk_id", F.lit(SALTS))).sortWithinPartitions("grp", "chunk_id")
        if name == "chunks":  # what a search finds is read by ids
            rows = rows.sortWithinPartitions("chunk_id")
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.store.root}/{name}/batch={batch}")

    def compact(self) -> None:
        """Rewrite all that lives as one batch; what it replaces is deleted after the commit."""
        m = self.manifest()
        old, batch = list(m.batches), m.next_batch
        postings, lengths = self.index()
        chunks, files, vectors = self.live("chunks", "file_path", m), self.live("files", "path", m), self.vectors(m).select("chunk_id", "embedding")
        if m.version < 2:  # without first chunks
            files = files.drop("first_chunk").join(chunks.groupBy(F.col("file_path").alias("path")).agg(F.min("chunk_id").alias("first_chunk")), "path", "left")
        rows = {"chunks": chunks, "files": files, "postings": postings, "lengths": lengths, "vectors": self.grouped(vectors, vectors.count())}
        self._write(rows, batch)
        m.batches, m.tables, m.next_batch, m.dead_chunks, m.version = [batch], {name: [batch] for name in (*rows, "terms", "groups")}, batch + 1, 0, VERSION
        m.live_chunks, m.live_terms = bm25.corpus_facts(self._of("lengths", batch))
        self.save(m)
        for name in TABLES:
            for b in old:
                self.store.delete(f"{name}/batch={b}")

    def stats(self) -> dict:
        row = file_counts(self.files()).first()
        return {"doc_count": row["doc_count"], "chunk_count": row["chunk_count"], "size_mb": round(self.store.size() / 1048576, 2)}

    def delete(self) -> dict:
        if not self.exists():
            return {"deleted": False, "reason": "not found"}
        freed = round(self.store.size() / 1048576, 2)
        self.store.delete()
        return {"deleted": True, "name": self.name, "freed_mb": freed}


def list_projects(spark: SparkSession, home: str) -> DataFrame:
    """One row a project; one that can't be read has its error only."""
    rows = []
    for name in Store(spark, home).names():
        p = Project(spark, home, name)
        if not p.exists():
            continue
        try:
            m, s = p.manifest(), p.stats()
            rows.append((name, m.source_paths, m.source_paths[0] if m.source_paths else None, m.last_indexed_at, s["doc_count"], s["chunk_count"], s["size_mb"], None))
        except Exception as e:  # a broken project must not hide the others
            rows.append((name, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:160]))
    return spark.createDataFrame(rows, schema.PROJECTS).orderBy("name")
