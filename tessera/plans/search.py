"""One hybrid search: two candidate lists side by side, fused, filtered, reranked and cut. What the engine and the registered query run."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import fusion, rerank
from tessera.operators.fusion import SearchFilter
from tessera.session import aside


FUSED = pa.schema([("chunk_id", pa.int64()), ("vec_rank", pa.int32()), ("kw_rank", pa.int32()), ("distance", pa.float64()), ("rrf", pa.float64())])


def candidates(nearest: Callable[[], DataFrame], keywords: Callable[[], DataFrame]) -> list[tuple]:
    """Fused rows (chunk_id, vec_rank, kw_rank, distance, rrf) of the two sides' best; the few rows are put in order here."""
    near = aside(lambda: nearest().select("distance", "chunk_id").collect())
    words = sorted(tuple(r) for r in keywords().select(F.round("bm25", 9), "chunk_id").collect())
    return fusion.fuse_lists([(c, d) for d, c in sorted(tuple(r) for r in near())], [c for _, c in words])


def hybrid(chunks: DataFrame, nearest: Callable[[], DataFrame], keywords: Callable[[], DataFrame], query: str, k: int, keep: SearchFilter | None = None, distances: Callable[[Column], DataFrame] | None = None, make_reranker: Callable | None = None) -> DataFrame:
    """The k best of chunks (chunk_id, text, source_file, display_name, page, chunk_index) that the filter keeps.

    distances: chunk_id and distance where a condition on chunk_id holds, if they are to be computed for what only the keywords found.
    """
    spark = chunks.sparkSession
    fused = candidates(nearest, keywords)
    # as many rows as both sides have at most
    ranked = spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(zip(*fused, strict=True) if fused else [()] * 5, FUSED.types, strict=True)], schema=FUSED))
    wanted = F.expr(f"chunk_id IN ({', '.join(str(int(r[0])) for r in fused)})") if fused else F.lit(False)
    rows = chunks.where(wanted).join(F.broadcast(ranked), "chunk_id")
    if distances:
        rows = rows.drop("distance").join(distances(wanted), "chunk_id")
    rows = (keep or SearchFilter()).apply(rows.drop("embedding", "indexed_at"))
    scored = rerank.with_model(rows, query, make_reranker) if make_reranker else rows.withColumn("rerank_score", rerank.lexical_score(query, F.col("text")))
    return fusion.project_results(scored, k)
