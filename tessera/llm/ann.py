"""Approximate nearest neighbours by inner product: score-aware anisotropic quantisation, four-bit tables, exact reranking.

Codebooks of 16 entries for each pair of dimensions are fitted on a bounded sample, and all rows are encoded, by the loss
h * |r|^2 + (g - h) * (r . x/|x|)^2 of the residual r: errors along a vector change its high inner products most, so
they weigh more. Rows go in blocks of ids, vectors and packed codes, queries in groups; each block meets each group once. There
the codes of distinct vectors are scored by table look-ups, two codes a look-up, the best are reranked by exact products in double precision,
and the best of all blocks are each query's result.

Defined results: vectors that are null, empty, zero, of another length than the commonest (of equally common ones the longest), or hold null or
non-finite components take no part; repeated rows are one; an id with several vectors is one query and one candidate, by the best
score of any of them; ties go to the smaller id; a query with fewer candidates than k gets all; a row is never
the candidate of a query of its own id; rows without an id take no part; a product that overflows counts as infinite, and one whose
parts overflow both ways, which is no number, ranks after all others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import regrouped, trimmed

PAIR, ENTRIES = 2, 16
#: Rows of the fit, rounds of it, and the share of a norm above which products should be kept.
SAMPLE, ROUNDS, SHARE = 4096, 6, 0.2
#: Rows of a block, queries of a group, and candidates of a block that are reranked, in times k.
BLOCK, GROUP, WIDTH = 8192, 2048, 6
#: Standard deviations of the codes' error within which further candidates are reranked.
SPREAD = 4.0


class Codec:
    def __init__(self, books: np.ndarray, extra: float):
        self.books, self.extra = books, extra  # (pairs, ENTRIES, PAIR); weight of the parallel part over that of the rest, less 1

    @staticmethod
    def fit(x: np.ndarray) -> Codec:
        n, d = x.shape
        x = np.pad(x, ((0, 0), (0, -d % PAIR)))
        pairs = x.shape[1] // PAIR
        extra = max(0.0, (d - 1) * SHARE**2 / (1 - SHARE**2) - 1)
        rng = np.random.default_rng(7)
        parts = x.reshape(n, pairs, PAIR)
        start = parts[rng.choice(n, ENTRIES, replace=n < ENTRIES)]
        codec = Codec(start.transpose(1, 0, 2).copy(), extra)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        along = (unit * x).sum(1)
        for _ in range(ROUNDS):
            codes = codec.encode(x)
            # normal equations of all entries: each row has one entry a pair
            at = ((np.arange(pairs) * ENTRIES + codes)[:, :, None] * PAIR + np.arange(PAIR)).reshape(n, -1)
            z = np.zeros((n, pairs * ENTRIES * PAIR), np.float32)
            z[np.arange(n)[:, None], at] = unit
            left = extra * (z.T @ z).astype(np.float64)
            left[np.diag_indices_from(left)] += np.bincount(at.ravel(), minlength=z.shape[1]) + 1e-6
            right = np.bincount(at.ravel(), weights=x.ravel(), minlength=z.shape[1]) + extra * (z.T @ along)
            codec.books = np.linalg.solve(left, right).reshape(pairs, ENTRIES, PAIR)
        return codec

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows, pairs): nearest entries first, then each pair in turn by the whole loss."""
        n = len(x)
        x = np.pad(x, ((0, 0), (0, self.books.shape[0] * PAIR - x.shape[1])))
        parts = x.reshape(n, -1, PAIR)
        unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(parts.shape)
        error = parts[:, :, None, :] - self.books[None]  # rows, pairs, entries
        own = np.einsum("npec,npec->npe", error, error)
        along = np.einsum("npec,npc->npe", error, unit)
        codes = own.argmin(2)
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        rows = np.arange(n)
        for _ in range(sweeps):
            for p in range(codes.shape[1]):
                rest = total - along[rows, p, codes[:, p]]
                codes[:, p] = (own[:, p] + self.extra * (rest[:, None] + along[:, p]) ** 2).argmin(1)
                total = rest + along[rows, p, codes[:, p]]
        return codes

    def pack(self, x: np.ndarray) -> np.ndarray:
        codes = np.concatenate([self.encode(x[a : a + 1024]) for a in range(0, len(x), 1024)]).astype(np.uint8)
        codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
        return codes[:, ::2] | codes[:, 1::2] << 4

    def scores(self, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate products (queries, rows) by look-ups of two four-bit codes at a time."""
        q = np.pad(queries, ((0, 0), (0, self.books.shape[0] * PAIR - queries.shape[1]))).reshape(len(queries), -1, PAIR)
        table = np.einsum("qpc,pec->qpe", q, self.books).astype(np.float32)
        table = np.pad(table, ((0, 0), (0, table.shape[1] % 2), (0, 0)))
        out = np.zeros((len(queries), len(packed)), np.float32)
        for p in range(packed.shape[1]):
            both = table[:, 2 * p + 1, :, None] + table[:, 2 * p, None, :]
            out += np.take(both.reshape(len(q), -1), packed[:, p], axis=1)
        return out


def nearest(codec: Codec, scale: float, ids: np.ndarray, counts: np.ndarray, vectors: np.ndarray, packed: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, exact products) of a block's k best for each query. ids: of each distinct vector in turn, ascending.

    scale: a power of two that brings vectors near 1, as the codes have them; scores are products of the vectors as they are.
    """
    width = min(len(vectors), max(WIDTH * k, 64))
    first = np.cumsum(counts) - counts
    for a in range(0, len(queries), 128):
        q, own = queries[a : a + 128], query_ids[a : a + 128]
        approx = codec.scores(q.astype(np.float64) * scale, packed)
        best = np.argpartition(-approx, width - 1, axis=1)[:, :width] if width < len(vectors) else np.broadcast_to(np.arange(width), approx.shape)
        exact = ((vectors[best].astype(np.float64) * scale) * (q[:, None, :].astype(np.float64) * scale)).sum(2)
        error = exact - np.take_along_axis(approx, best, 1)
        kth = np.partition(exact, max(0, width - k), axis=1)[:, max(0, width - k)]
        # all that the error seen so far leaves possible: many vectors may lie closer together than the codes tell apart
        possible = approx >= (kth - error.mean(1) - SPREAD * error.std(1))[:, None]
        np.put_along_axis(possible, best, True, 1)
        for j in range(len(q)):
            found = np.flatnonzero(possible[j])
            with np.errstate(over="ignore", invalid="ignore"):
                products = (vectors[found].astype(np.float64) * q[j].astype(np.float64)).sum(1)
                if not np.isfinite(products).all():  # products that overflow are equal: all must be seen
                    found = np.arange(len(vectors))
                    products = (vectors.astype(np.float64) * q[j].astype(np.float64)).sum(1)
            n = counts[found]
            i = ids[np.repeat(first[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            use = i != own[j]
            i, s = i[use], np.repeat(products, n)[use]
            top = np.lexsort((i, -np.where(np.isnan(s), -np.inf, s), np.isnan(s)))[:k]
            yield int(own[j]), i[top], s[top]


_BLOCKS = "ids binary, counts binary, vectors binary, packed binary"


def _pack_blocks(codec, scale: float, kind: str, k: int):
    """With a codec, each distinct vector once, with its first k + 1 ids: of equal products no more can be among k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in regrouped(batches, 64 << 20):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind)
            vectors = flat.reshape(len(ids), -1)
            counts, packed = np.ones(len(ids), np.int64), np.empty((0, 0), np.uint8)
            if codec:
                same = np.ascontiguousarray(vectors + 0.0).astype(kind).view(f"V{vectors.shape[1] * vectors.itemsize}").ravel()
                _, at, which = np.unique(same, return_index=True, return_inverse=True)
                order = np.lexsort((ids, which))
                counts = np.bincount(which)
                place = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
                ids, counts, vectors = ids[order][place <= k], np.minimum(counts, k + 1), vectors[at]
                packed = codec.value.pack(vectors.astype(np.float64) * scale)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (ids.tobytes(), counts.tobytes(), vectors.tobytes(), packed.tobytes())], ["ids", "counts", "vectors", "packed"])

    return run


def usable(vector: str):
    """Neither null, empty nor zero, and all components finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def search(rows: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row for which is_query(id column) holds."""
    spark = rows.sparkSession
    element = rows.schema[vector].dataType.elementType
    kind = "float32" if isinstance(element, T.FloatType) else "float64"
    good = rows.where(usable(vector) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    top = F.max(F.array_max(F.transform("v", F.abs)).cast("double")).alias("top")
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("count"), top).orderBy(F.desc("count"), F.desc("d")).first()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, count, scale = sizes[0], sizes[1], 2.0 ** -int(np.floor(np.log2(sizes[2])))
    good = good.where(F.size("v") == d)
    part = max(1, count // SAMPLE)
    sample = [r[0] for r in good.where(F.pmod(F.xxhash64("vec_id"), F.lit(part)) == 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * SAMPLE).select("v").collect()]
    codec = spark.sparkContext.broadcast(Codec.fit(np.array(sample, np.float64) * scale))
    # with so many candidates, an id with several vectors takes no other's place
    each_id = good.select("vec_id", F.xxhash64("v").alias("h")).distinct().groupBy("vec_id").count().agg(F.max("count")).first()[0]
    wide = (k + 1) * each_id - 1
    good = good.dropDuplicates(["vec_id", "v"])
    blocks = good.repartition(max(1, -(-count // BLOCK))).mapInArrow(_pack_blocks(codec, scale, kind, wide), _BLOCKS).withColumn("b", F.spark_partition_id())
    asked = good.where(is_query(F.col("vec_id")))
    groups = asked.repartition(max(1, -(-asked.count() // GROUP))).mapInArrow(_pack_blocks(None, scale, kind, wide), _BLOCKS).withColumn("g", F.spark_partition_id())
    n_blocks, n_groups = max(1, -(-count // BLOCK)), max(1, -(-asked.count() // GROUP))
    # the stated queries against all rows, block by block: each block meets each group of queries once
    left = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    right = groups.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[int, list[int], list[float]]] = []
        for block in a.to_pylist():
            ids = np.frombuffer(block["ids"], np.int64)
            counts = np.frombuffer(block["counts"], np.int64)
            vectors = np.frombuffer(block["vectors"], kind).reshape(len(counts), -1)
            packed = np.frombuffer(block["packed"], np.uint8).reshape(len(counts), -1)
            for group in b.to_pylist():
                qi = np.frombuffer(group["ids"], np.int64)
                for q, i, s in nearest(codec.value, scale, ids, counts, vectors, packed, qi, np.frombuffer(group["vectors"], kind).reshape(len(qi), -1), wide):
                    out.append((q, i.tolist(), s.tolist()))
        q, i, s = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_ids": pa.array(i, pa.list_(pa.int64())), "scores": pa.array(s, pa.list_(pa.float64()))})

    found = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInArrow(trimmed(meet), "query_id long, vec_ids array<long>, scores array<double>")
    each = found.select("query_id", F.inline(F.arrays_zip("vec_ids", "scores"))).select("query_id", F.col("vec_ids").alias("vec_id"), F.col("scores").alias("score"))
    if each_id > 1:
        each = each.groupBy("query_id", "vec_id").agg(F.max_by("score", F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
