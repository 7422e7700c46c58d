"""Reciprocal rank fusion, and the filters and projection after it."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import basename
from tessera.functions.vectors import similarity

# A fixed value: what is added to ranks.
RRF_K = 60


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, key: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """Full outer merge of (key, rank, distance) and (key, rank): key, vec_rank, kw_rank, distance, rrf.

    A chunk that only the keywords found has distance 0, and so the greatest similarity.
    """
    v = vector_hits.select(F.col(key), F.col("rank").alias("vec_rank"), "distance")
    w = keyword_hits.select(F.col(key), F.col("rank").alias("kw_rank"))
    part = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    return v.join(w, key, "full_outer").select(key, "vec_rank", "kw_rank", F.coalesce("distance", F.lit(0.0)).alias("distance"), (part("vec_rank") + part("kw_rank")).alias("rrf"))


def fuse_lists(vector_hits: list[tuple[int, float]], keyword_hits: list[int], k: int = RRF_K) -> list[tuple]:
    """fuse() for two short lists in order, (chunk_id, distance) and chunk_id: rows (chunk_id, vec_rank, kw_rank, distance, rrf)."""
    vec = {c: (n, d) for n, (c, d) in enumerate(vector_hits, 1)}
    kw = {c: n for n, c in enumerate(keyword_hits, 1)}
    rows = []
    for c in dict.fromkeys([*vec, *kw]):
        v, w = vec.get(c), kw.get(c)
        rows.append((c, v[0] if v else None, w, v[1] if v else 0.0, (1 / (k + v[0]) if v else 0.0) + (1 / (k + w) if w else 0.0)))
    return rows


#: Order of fused rows; ties keep the vector side's order, then the keyword side's.
RRF_ORDER = (F.desc, "rrf"), (F.asc_nulls_last, "vec_rank"), (F.asc_nulls_last, "kw_rank")


def rrf_order() -> list[Column]:
    return [f(c) for f, c in RRF_ORDER]


def fuse_many(vector_hits: DataFrame, keyword_hits: DataFrame, k: int, key: str = "chunk_id", constant: int = RRF_K) -> DataFrame:
    """query_id, key, rrf and rank of the k best of each query, from (query_id, key, rank) of either side."""
    part = 1.0 / (constant + F.col("rank"))
    v = vector_hits.select("query_id", key, part.alias("part"), F.col("rank").alias("vec_rank"))
    w = keyword_hits.select("query_id", key, part.alias("part"), F.lit(None).cast("int").alias("vec_rank"))
    fused = v.unionByName(w).groupBy("query_id", key).agg(F.sum("part").alias("rrf"), F.max("vec_rank").alias("vec_rank"))
    order = Window.partitionBy("query_id").orderBy(F.round("rrf", 12).desc(), F.asc_nulls_last("vec_rank"), key)
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", key, "rrf", "rank")


def matches_glob(name: Column, pattern: str) -> Column:
    """Shell pattern, case-sensitive; * crosses /."""
    return name.rlike(r"\A" + fnmatch.translate(pattern).replace(r"\Z", r"\z"))


@dataclass(frozen=True)
class SearchFilter:
    """Conditions on found chunks, all of which must hold. What isn't given, or empty, is no condition."""

    file_glob: str | None = None
    subdirectory: str | None = None
    page_min: int | None = None
    page_max: int | None = None
    min_similarity: float = 0.0

    def metadata(self) -> list[Column]:
        parts = []
        if self.file_glob:
            parts.append(matches_glob(F.col("display_name"), self.file_glob) | matches_glob(basename(F.col("source_file")), self.file_glob))
        if self.subdirectory:
            parts.append(F.contains(F.col("source_file"), F.lit(self.subdirectory)))
        if self.page_min is not None:
            parts.append(F.coalesce(F.col("page") >= self.page_min, F.lit(False)))
        if self.page_max is not None:
            parts.append(F.coalesce(F.col("page") <= self.page_max, F.lit(False)))
        return parts

    def conditions(self) -> list[Column]:
        return self.metadata() + ([similarity(F.col("distance")) >= self.min_similarity] if self.min_similarity > 0 else [])

    def is_active(self) -> bool:
        return len(self.conditions()) > 0

    def apply(self, rows: DataFrame) -> DataFrame:
        parts = self.conditions()
        return rows.where(reduce(lambda a, b: a & b, parts)) if parts else rows


RESULT = ["text", "source_file", "display_name", "page", "chunk_index", "rerank_score", "vector_similarity"]


def project_results(scored: DataFrame, k: int) -> DataFrame:
    """The k best by rerank_score; ties keep the fused order."""
    if k < 0:
        raise ValueError("k must not be negative")
    best = scored.orderBy(F.desc("rerank_score"), *rrf_order()).limit(k)
    return best.select("text", "source_file", "display_name", "page", "chunk_index", F.round("rerank_score", 4).alias("rerank_score"), F.round(similarity(F.col("distance")), 4).alias("vector_similarity"))
