"""The engine: projects, indexing jobs and hybrid search."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import l2_distance, literal
from tessera.operators import bm25, embed, fusion, knn, rerank
from tessera.operators.fusion import SearchFilter
from tessera.plans import catalog
from tessera.plans.catalog import Project
from tessera.plans.indexer import Indexer, Models
from tessera.plans.jobs import Jobs
from tessera.plans.search import hybrid
from tessera.session import prepare

MODES = ("auto", "fail", "replace", "append")


class Engine:
    """home: a folder that driver and executors share. make_reranker: None for the built-in lexical score."""

    def __init__(self, spark: SparkSession, home: str, models: Models | None = None, make_reranker: Callable | None = None, notify: Callable | None = None):
        prepare(spark)
        self.spark, self.home, self.models, self.make_reranker = spark, home, models or Models(), make_reranker
        self.jobs = Jobs(notify, spark)
        self._model, self._known = None, {}
        #: The share of vectors that lay in groups which the last search had to read.
        self.read_share: float | None = None

    def project(self, name: str) -> Project:
        return Project(self.spark, self.home, name)

    def _existing(self, name: str) -> Project:
        p = self.project(name)
        if not p.exists():
            raise ValueError(f"unknown project: {name}")
        return p

    def list_projects(self) -> DataFrame:
        return catalog.list_projects(self.spark, self.home)

    def delete_project(self, project: str) -> dict:
        """Waits for jobs on the project."""
        p = self.project(project)
        with self.jobs.alone(p.name):
            return p.delete()

    def index_project(self, folder_path: str, project: str | None = None, mode: str = "auto") -> dict:
        """Start a job: a plain index of a new project, else what the mode says.

        fail: an error. replace: drop and index. append: index the folder too. auto: reindex all folders if this is one
        of them, else an error.
        """
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        folder = os.path.abspath(os.path.expanduser(folder_path))
        if not os.path.isdir(folder):
            raise FileNotFoundError(folder)
        p = self.project(project or os.path.basename(folder))
        operation = "index"
        if p.exists():
            if mode == "fail":
                raise ValueError(f"project {p.name} exists")
            if mode == "auto" and folder not in p.sources():
                raise ValueError(f"project {p.name} has other folders; use append or replace")
            if mode == "auto":
                operation = "reindex"
        return self._launch(operation, p, mode, lambda i: i.reindex() if operation == "reindex" else i.index_folder(folder))

    def reindex_project(self, project: str) -> dict:
        return self._launch("reindex", self._existing(project), None, lambda i: i.reindex())

    def _launch(self, operation: str, p: Project, mode: str | None, act: Callable) -> dict:
        if not p.exists():
            p.create(self.models.make_embedder().dim)

        def work(progress) -> dict:
            if mode == "replace":  # here, where no other job works on the project
                p.delete()
                p.create(self.models.make_embedder().dim)
            result = act(Indexer(self.spark, p, self.models, progress)).as_dict()
            return result | p.stats() | {"source_paths": p.sources()}

        job = self.jobs.start(operation, p.name, work)
        return {"job_id": job.id, "status": job.status, "operation": operation, "project": p.name, "mode": mode}

    def index_status(self, job_id: str) -> dict:
        return self.jobs.get(job_id)

    def await_index(self, job_id: str, timeout_sec: float = 25) -> dict:
        return self.jobs.wait(job_id, timeout_sec)

    def cancel_index(self, job_id: str) -> dict:
        return self.jobs.cancel(job_id)

    def list_jobs(self, active_only: bool = False) -> list[dict]:
        return self.jobs.list(active_only)

    def search(self, project: str, query: str, k: int = 5, candidate_pool: int = 75, file_glob: str | None = None, subdirectory: str | None = None, page_min: int | None = None, page_max: int | None = None, min_similarity: float = 0.0, prefilter: bool = False, strict_similarity: bool = False) -> DataFrame:
        """The k best chunks: text, source_file, display_name, page, chunk_index, rerank_score, vector_similarity.

        candidate_pool rows of each side are fused, then filtered, so filters can leave fewer than k; prefilter applies the
        file and page filters before. A chunk that only the keywords found has similarity 1, unless strict_similarity has
        it computed.
        """
        p = self._existing(project)
        keep = SearchFilter(file_glob, subdirectory, page_min, page_max, min_similarity)
        m = p.manifest()  # one state for all that follows
        chunks, vectors, postings, lengths, terms = self._kept(p, m, "tables", lambda: (p.chunks(m).withColumnRenamed("file_path", "source_file"), p.vectors(m), *p.index(m), p.table("terms", m)))
        whole = not (prefilter and keep.metadata())
        if not whole:
            for c in keep.metadata():
                chunks = chunks.where(c)
            ids = chunks.select("chunk_id")
            vectors, postings, lengths = (t.join(ids, "chunk_id", "left_semi") for t in (vectors, postings, lengths))
        facts = (p.facts(m) or self._kept(p, m, "facts", lambda: bm25.corpus_facts(lengths))) if whole else None
        groups = self._kept(p, m, "groups", lambda: p.groups(m))
        vector = self._embedder().query(query)

        def nearest() -> DataFrame:
            if groups is None or not whole:
                return knn.search(vectors, vector, candidate_pool)
            found, read = knn.near(vectors, groups, vector, candidate_pool)
            self.read_share = float(groups.count[np.isin(groups.ids, read)].sum()) / max(1, int(groups.count.sum()))
            return found

        def keywords() -> DataFrame:
            return bm25.search(postings, lengths, query, candidate_pool, facts, p.term_bounds(bm25.literal_terms(self.spark, query), m, terms) if whole else None)

        def distances(wanted) -> DataFrame:
            return vectors.where(wanted).select("chunk_id", l2_distance(F.col("embedding"), literal(vector)).alias("distance"))

        return hybrid(chunks, nearest, keywords, query, k, keep, distances if strict_similarity else None, self.make_reranker)

    def _embedder(self):
        if self._model is None:
            self._model = self.models.make_embedder()
        return self._model

    def _kept(self, p: Project, m: catalog.Manifest, name: str, make: Callable):
        """Something of a project's state, kept until its next commit."""
        key = m.next_batch, m.last_indexed_at
        if self._known.get((p.name, name), (None,))[0] != key:
            self._known[p.name, name] = key, make()
        return self._known[p.name, name][1]

    def search_many(self, project: str, queries: list[tuple[int, str]], k: int = 5, candidate_pool: int = 75) -> DataFrame:
        """query_id, chunk_id, rrf and rank of the k best fused chunks of each of some queries, in one plan."""
        p = self._existing(project)
        embedder = self._embedder()
        postings, lengths = p.index()
        table = self.spark.createDataFrame(queries, "query_id long, query string")
        v = knn.batch_search(p.vectors(), [(i, embedder.query(q).tolist()) for i, q in queries], candidate_pool)
        w = bm25.top(bm25.scores(postings, lengths, table), candidate_pool)
        return fusion.fuse_many(v, w, k)

    def warm_up(self) -> None:
        """Make the models on the workers, which keep them, so that the first search needn't."""
        text = self.spark.range(self.spark.sparkContext.defaultParallelism).select(F.col("id").cast("string").alias("text"))
        text.select(embed.embed(F.col("text"), self.models.make_embedder)).write.format("noop").mode("overwrite").save()
        if self.make_reranker:
            rerank.with_model(text, "warm up", self.make_reranker).write.format("noop").mode("overwrite").save()
