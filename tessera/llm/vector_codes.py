"""Vector code compression: product quantisation in integers, with partial-distance search.

Components become floor(4096 * x); vectors are cut into PARTS consecutive parts, each with a codebook of ENTRIES. The codebooks
begin as the parts of the first vectors by id and are refined in rounds of a pass over all vectors each: a task assigns its vectors' parts
and adds them up per entry, Spark adds up the tasks' sums, and to the driver come 16 sums a component, whatever the number of rows.

A part's nearest entry is found by partial distances: dimensions come in descending variance of the codebook, and for each entry the
vectors whose integer distance so far strictly exceeds their best complete one are masked out. The first complete distance of a
vector is that of the entry nearest in the first dimension. What equals the best stays in, so that ties go to the lower index.

Defined results: vectors that are null, empty, of another length than the commonest (of equally common ones the longest), or hold null or
non-finite components take no part; if 8 doesn't divide the length, part j is components j * d // 8 to (j + 1) * d // 8; fewer than 16 vectors
make fewer entries; repeated rows count each; rows without an id come last, and their codes are returned too; integers are
exact at any size, and a result over the largest long is held to it; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import regrouped, stage_table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers under which distances and a task's sums can't overflow 64 bits; beyond, Python's integers are used.
SAFE = 1 << 24
TOP = (1 << 63) - 1


def cuts(d: int) -> list[tuple[int, int]]:
    return [(j * d // PARTS, (j + 1) * d // PARTS) for j in range(PARTS)]


def integers(x: np.ndarray, exact: bool) -> np.ndarray:
    """floor(4096 * x), of any size if exact."""
    if not exact:
        return np.floor(x * float(SCALE)).astype(np.int64)
    big = [int(v) * SCALE if abs(v) > 1e300 else math.floor(v * SCALE) for v in x.ravel().tolist()]
    return np.array(big, object).reshape(x.shape)


def by_variance(book: np.ndarray) -> np.ndarray:
    """Dimensions of a codebook in descending variance, exactly; ties in order."""
    whole = book.astype(object)
    spread = [len(whole) * sum(c * c for c in whole[:, d]) - sum(whole[:, d]) ** 2 for d in range(book.shape[1])]
    return np.array(sorted(range(book.shape[1]), key=lambda d: -spread[d]), np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row of x, ties to the lower entry, by partial distances."""
    if not x.shape[1] or not len(x):
        return np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
    order = by_variance(book)
    columns = x.T.copy()
    first = np.abs(columns[order[0]][:, None] - book[:, order[0]][None, :]).argmin(1).astype(np.int64)
    code = first.copy()
    gap = x - book[first]
    best = (gap * gap).sum(1)
    for e in range(len(book)):
        rows = np.flatnonzero(first != e)
        so_far = np.zeros(len(rows), x.dtype)
        for d in order:
            gap = columns[d][rows] - book[e, d]
            so_far = so_far + gap * gap
            alive = (so_far <= best[rows]).astype(bool)
            if not alive.all():
                rows, so_far = rows[alive], so_far[alive]
                if not len(rows):
                    break
        better = ((so_far < best[rows]) | (e < code[rows])).astype(bool)
        best[rows[better]], code[rows[better]] = so_far[better], e
    return code, best


def assign(flat: np.ndarray, d: int, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(integer vectors, codes, distances), the latter of each part, of vectors given one after another."""
    x = flat.reshape(-1, d).astype(np.float64)
    exact = books.dtype == object or bool(len(x)) and float(np.abs(x).max()) * SCALE >= SAFE
    v, b = integers(x, exact), books.astype(object) if exact else books
    found = [nearest(v[:, p:q], b[:, p:q]) for p, q in cuts(d)]
    return v, np.stack([c for c, _ in found], 1), np.stack([e for _, e in found], 1)


def _limbs(slots: np.ndarray, sums: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(slot, limb, value) of sums, cut into limbs of 32 bits of which only the last has a sign: Spark adds them up without overflow."""
    for slot, s in zip(slots.tolist(), sums.tolist(), strict=True):
        limb = 0
        while True:
            high = s >> 32
            if -(1 << 31) <= s < 1 << 31:
                yield slot, limb, s
                break
            yield slot, limb, s - (high << 32)
            s, limb = high, limb + 1


def _sums(d: int, books: np.ndarray):
    """mapInArrow: one task's sums of the vectors of each entry (slot entry * d + component), then its counts of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(books)
        sums, counts = np.zeros((m, d), object), np.zeros((PARTS, m), np.int64)
        for b in regrouped(batches, 4 << 20):
            v, code, _ = assign(b.column(0).flatten().to_numpy(zero_copy_only=False), d, books)
            for j, (p, q) in enumerate(cuts(d)):
                counts[j] += np.bincount(code[:, j], minlength=m)
                for e in range(m):
                    sums[e, p:q] += v[code[:, j] == e, p:q].sum(0).astype(object)
        rows = list(_limbs(np.arange(m * d + PARTS * m), np.concatenate([sums.ravel(), counts.ravel().astype(object)])))
        slot, limb, value = zip(*[r for r in rows if r[2] or not r[1]], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(limb, pa.int32()), pa.array(value, pa.int64())], ["slot", "limb", "value"])

    return run


def _as_books(rows: list[list[int]], d: int) -> np.ndarray:
    big = any(abs(c) >= SAFE for r in rows for c in r)
    return np.array(rows, object if big else np.int64).reshape(len(rows), d)


def fit(vectors: DataFrame, d: int, start: list[list[float]]) -> np.ndarray:
    """Codebooks (entry, component) after ROUNDS passes over all vectors (one column); start: the first vectors."""
    exact = integers(np.array(start, np.float64), True).tolist()
    books = _as_books(exact, d)
    for _ in range(ROUNDS):
        added = vectors.mapInArrow(_sums(d, books), "slot int, limb int, value long").groupBy("slot", "limb").agg(F.sum("value").alias("value"))
        total: dict[int, int] = {}
        for slot, limb, value in added.collect():  # a few rows for each of the codebooks' integers
            total[slot] = total.get(slot, 0) + (value << 32 * limb)
        m, new = len(books), books.astype(object)
        for j, (p, q) in enumerate(cuts(d)):
            for e in range(m):
                if n := total.get(m * d + j * m + e, 0):
                    new[e, p:q] = [total.get(e * d + c, 0) // n for c in range(p, q)]
        books = _as_books(new.tolist(), d)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of the entries' integers in decimal, by part, entry and place in the part."""
    return hashlib.sha256(",".join(str(c) for p, q in cuts(books.shape[1]) for r in books.tolist() for c in r[p:q]).encode()).hexdigest()


def _codes(d: int, books: np.ndarray):
    """mapInArrow over (vec_id, label, vector): the same with code and error in place of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in regrouped(batches, 4 << 20):
            _, code, error = assign(b.column(2).flatten().to_numpy(zero_copy_only=False), d, books)
            text = code.astype(np.uint8).tobytes().hex()
            held = [min(TOP, int(e)) for e in error.sum(1).tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([text[k : k + 2 * PARTS] for k in range(0, len(text), 2 * PARTS)], pa.string()), pa.array(held, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def usable(vector: str):
    """Neither null nor empty, and all components finite."""
    v = F.col(vector)
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def compress(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each row of rows that takes part."""
    spark = rows.sparkSession
    good = rows.where(usable(vector)).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    length = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kinds = f"vec_id {good.schema['vec_id'].dataType.simpleString()}, label {good.schema['label'].dataType.simpleString()}, code string, error long"
    if not length:
        return spark.createDataFrame([], kinds).select("vec_id", "code", "error", F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    d = length["d"]
    good = good.where(F.size("v") == d)
    start = [r["v"] for r in good.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).collect()]
    books = fit(good.select("v"), d, start)
    coded = stage_table(good.mapInArrow(_codes(d, books), kinds), "codes")
    # one row a label; nulls are one label
    of = F.struct("label").alias("of")
    held = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(TOP).cast("decimal(30,0)")).cast("long")
    totals = coded.groupBy(of).agg(held.alias("label_error"))
    return coded.select("vec_id", "code", "error", of).join(totals, "of").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
