"""Exact nearest neighbours by Euclidean distance.

Queries are a stated set that meets all vectors: each partition of the vectors keeps its k best for each query of a block, so what is
shuffled is k rows for each query and partition, and the distances are NumPy's, in double precision. Many queries meet a slice of vectors by one
product of matrices, which tells with a margin what can't be among the k nearest; the distance is then taken of the few others only.

Vectors that are dealt into groups around centres needn't all be met: by the triangle inequality no vector of a group is nearer than its
centre's distance less the group's radius. near() first searches the nearest groups, and then those that may still hold one of the k.

Vectors that are null, of another length than the query, or hold a component that is null or no number have no distance
and are never found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import l2_distance, literal, similarity, usable

#: Queries a block: so many vectors are sent to every task at a time.
BLOCK = 16_384
#: Queries from which on a product of matrices comes first, products of a slice, and the margin for their rounding, relative to the squared lengths.
MANY, PRODUCTS, MARGIN = 64, 1 << 23, 1e-11
#: Vectors that centres are fitted on, rounds of that, vectors of a group on average, and groups at most.
SAMPLE, ROUNDS, GROUP, GROUPS = 16_384, 5, 1000, 1024


#: Vectors up to which one query is answered by expressions, as starting Python takes longer than they do; and up to which groups save nothing.
NATIVE, FEW = 2_000, 20_000


def search(vectors: DataFrame, query, k: int, key: str = "chunk_id", vector: str = "embedding", few: bool = False) -> DataFrame:
    """key, distance, rank, score of the k nearest; ties to the smaller key. few: there are no more than about NATIVE vectors."""
    if few:
        found = vectors.where(usable(F.col(vector), len(query))).select(key, l2_distance(F.col(vector), literal(query)).alias("distance"))
    else:
        found = _found(vectors, [(0, query)], k, key, vector)
    found = found.select(key, "distance").orderBy("distance", key).limit(k)
    return found.select(key, "distance", F.row_number().over(Window.orderBy("distance", key)).alias("rank"), similarity(F.col("distance")).alias("score"))


def batch_search(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """query_id, key, distance, rank, score for given queries of one length, taken in blocks of BLOCK."""
    spark = vectors.sparkSession
    if not queries:
        return spark.createDataFrame([], f"query_id long, {key} long, distance double, rank int, score double")
    found = None
    for a in range(0, len(queries), BLOCK):
        part = _found(vectors, queries[a : a + BLOCK], k, key, vector)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy("distance", key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("score", similarity(F.col("distance")))


def _found(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int, key: str, vector: str) -> DataFrame:
    """query_id, key, distance: each partition's k nearest of each query."""
    dim = len(queries[0][1])
    shared = vectors.sparkSession.sparkContext.broadcast((np.array([q for q, _ in queries], np.int64), np.array([v for _, v in queries], np.float64).reshape(-1, dim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        if len(ids) > MANY:
            best_id, best_d = _nearest(ids, q, _slices(batches, dim, max(256, PRODUCTS // len(ids))), k)
            at, rank = np.nonzero(best_id != NONE)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(best_id[at, rank]), pa.array(best_d[at, rank])], ["query_id", key, "distance"])
            return
        step = max(256, 16_384 // len(ids))
        best_id, best_d = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
        for own, part in _slices(batches, dim, step):
            d = np.sqrt(((q[:, None, :] - part[None]) ** 2).sum(2))
            d = np.concatenate([best_d, d], 1)
            i = np.concatenate([best_id, np.broadcast_to(own, (len(ids), len(part)))], 1)
            order = np.lexsort((i, d), axis=1)[:, :k]
            best_d, best_id = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best_id.shape[1])), pa.array(best_id.ravel()), pa.array(best_d.ravel())], ["query_id", key, "distance"])

    rows = vectors.where(F.col(key).isNotNull() & (F.size(vector) == dim)).select(F.col(key).cast("long"), vector)
    return rows.mapInArrow(run, f"query_id long, {key} long, distance double")


#: No vector's id: what stands where fewer than k are found so far.
NONE = np.iinfo(np.int64).min


def _slices(batches: Iterator[pa.RecordBatch], dim: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of at most step rows, without those that hold a component that is null or no number; small batches are put together."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        own = b.column(0).to_numpy(zero_copy_only=False)
        v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), dim)
        good = ~np.isnan(v).any(1)
        held.append((own[good], v[good]))
        if sum(len(o) for o, _ in held) >= step:
            own, v = (np.concatenate(x) for x in zip(*held, strict=True))
            whole = len(own) - len(own) % step
            for a in range(0, whole, step):
                yield own[a : a + step], v[a : a + step]
            held = [(own[whole:], v[whole:])]
    own, v = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.empty(0, np.int64), np.empty((0, dim)))
    if len(own):
        yield own, v


def _nearest(ids: np.ndarray, q: np.ndarray, slices: Iterator[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of each query, ids (NONE beyond the last) and distances; ties to the smaller id."""
    best_id, best_d = np.full((len(ids), k), NONE), np.full((len(ids), k), np.inf)
    full = np.zeros(len(ids), bool)
    with np.errstate(over="ignore", invalid="ignore"):
        qq = (q**2).sum(1)
        for own, v in slices:
            vv = (v**2).sum(1)
            both = qq[:, None] + vv[None]
            low = q @ v.T
            low *= -2
            low += both
            reach = np.where(full, best_d[:, -1] ** 2, np.inf)
            if not full.all() and len(own) >= k:  # the k-th of this slice is no nearer than the k-th of all
                some = ~full
                high = low[some] + MARGIN * both[some]
                reach[some] = np.partition(np.where(np.isnan(high), np.inf, high), k - 1, axis=1)[:, k - 1]
            both *= MARGIN
            low -= both
            low -= (reach * (1 + MARGIN))[:, None]
            at, j = np.nonzero(~(low > 0))  # what can't be told is compared too
            d = np.concatenate([np.sqrt(((q[at[a : a + 65_536]] - v[j[a : a + 65_536]]) ** 2).sum(1)) for a in range(0, len(at), 65_536)] or [np.empty(0)])
            rows = np.unique(at)
            old = best_id[rows] != NONE
            r = np.nonzero(old)[0]
            near = np.concatenate([best_d[rows][old], d])
            of, name = np.concatenate([rows[r], at]), np.concatenate([best_id[rows][old], own[j]])
            order = np.lexsort((name, near, of))
            of, name, near = of[order], name[order], near[order]
            place = np.arange(len(of)) - np.searchsorted(of, of)
            use = place < k
            best_id[rows], best_d[rows] = NONE, np.inf
            best_id[of[use], place[use]], best_d[of[use], place[use]] = name[use], near[use]
            full = (best_id[:, -1] != NONE) & ~np.isnan(best_d[:, -1])
    return best_id, best_d


def centres(vectors: DataFrame, vector: str = "embedding", each: int = GROUP, total: int | None = None) -> np.ndarray:
    """Centres for groups of about each of total vectors (of these, if it isn't given), fitted on a bounded sample of those of the commonest length (of equally common ones the longest).

    They decide how many groups a search reads and not what it finds."""
    sized = vectors.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if not sized:
        return np.zeros((0, 0))
    rows = vectors.where(F.size(vector) == sized["d"]).select(F.col(vector).alias("v"))
    part = max(1, sized["count"] // SAMPLE)
    taken = rows.where(F.pmod(F.xxhash64("v"), F.lit(part)) == 0).orderBy(F.xxhash64("v")).limit(SAMPLE).collect()
    x = np.array([[np.nan if c is None else c for c in r["v"]] for r in taken], np.float64).reshape(-1, sized["d"])
    x = x[np.isfinite(x).all(1)]
    m = min(GROUPS, max(1, (total or sized["count"]) // each), len(x))
    found = x[np.linspace(0, len(x) - 1, m).astype(int)] if m else np.zeros((0, sized["d"]))
    for _ in range(ROUNDS):
        own, far = _nearest_centre(x, found)
        n = np.bincount(own, minlength=m)
        sums = np.zeros_like(found)
        np.add.at(sums, own, x)
        found = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], found)
        # the smallest group's centre goes to the vector that lies farthest from its own, as long as it is far from others too
        if len(x) and far.max() > 2 * np.median(far):
            found[n.argmin()] = x[far.argmax()]
    return found


def _nearest_centre(x: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centre, distance) of each vector, the distance by the same sum as a search's."""
    if not len(found) or not len(x):
        return np.full(len(x), -1), np.zeros(len(x))
    own = np.concatenate([((found**2).sum(1) - 2 * x[a : a + 4096] @ found.T).argmin(1) for a in range(0, len(x), 4096)])
    return own, np.sqrt(((x - found[own]) ** 2).sum(1))


#: The group of vectors that were not dealt into groups; it is always read.
UNGROUPED = -2


def group_of(vector: Column, found: np.ndarray) -> Column:
    """grp and far, the distance to that centre; -1 for vectors that have no finite distance to one."""

    @F.pandas_udf("grp int, far double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        d = found.shape[1]
        for b in batches:
            v = np.array([x if x is not None and len(x) == d else np.full(d, np.nan) for x in b], np.float64).reshape(len(b), d)
            good = np.isfinite(v).all(1)
            grp, far = np.full(len(b), -1), np.zeros(len(b))
            grp[good], far[good] = _nearest_centre(v[good], found)
            yield pd.DataFrame({"grp": grp.astype(np.int32), "far": far}, index=b.index)

    return run(vector)


@dataclass(frozen=True)
class Groups:
    """What a search needs to know of groups: their numbers, centres, radii and how many vectors they have."""

    ids: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    count: np.ndarray

    @staticmethod
    def of(grouped: DataFrame, found: np.ndarray) -> Groups:
        """From vectors with grp and far; one row a group comes to the driver."""
        rows = grouped.groupBy("grp").agg(F.max("far").alias("radius"), F.count("*").alias("n")).orderBy("grp").collect()
        return Groups.made([(r["grp"], r["radius"], r["n"]) for r in rows], found)

    @staticmethod
    def made(rows: list[tuple[int, float, int]], found: np.ndarray) -> Groups:
        ids = np.array([r[0] for r in rows], np.int64)
        centre = np.array([found[g] if g >= 0 else np.zeros(found.shape[1]) for g in ids]).reshape(len(ids), found.shape[1])
        return Groups(ids, centre, np.array([r[1] for r in rows], np.float64), np.array([r[2] for r in rows], np.int64))

    def least(self, query) -> np.ndarray:
        """No vector of a group is nearer to the query; a little less, for the sums' rounding. Those of group -1 are infinitely far or have no
        distance, those of UNGROUPED may be anywhere."""
        far = np.sqrt(((self.centre - np.asarray(query, np.float64)) ** 2).sum(1))
        return np.where(self.ids < 0, np.where(self.ids == UNGROUPED, 0.0, np.inf), np.maximum(0.0, far - self.radius - 1e-9 * (1 + far)))


def near(grouped: DataFrame, groups: Groups, query, k: int, key: str = "chunk_id", vector: str = "embedding", always: bool = False) -> tuple[DataFrame, np.ndarray]:
    """search() over vectors with grp, and the groups it reads: those that may hold one of the k nearest; all of few vectors, unless always."""
    if (groups.count.sum() <= FEW and not always) or len(query) != groups.centre.shape[1]:
        return search(grouped, query, k, key, vector, bool(groups.count.sum() <= NATIVE)), groups.ids
    least = groups.least(query)
    order = np.argsort(least + groups.radius, kind="stable")
    first = order[: int(np.searchsorted(np.cumsum(groups.count[order]), k)) + 1]
    few = bool(groups.count[first].sum() <= NATIVE)
    within = search(grouped.where(F.col("grp").isin(groups.ids[first].tolist())), query, k, key, vector, few).agg(F.count("*"), F.max("distance")).first()
    reach = within[1] if within[0] == k and within[1] is not None else np.inf
    read = least <= reach
    few = bool(groups.count[read].sum() <= NATIVE)
    return search(grouped.where(F.col("grp").isin(groups.ids[read].tolist())), query, k, key, vector, few), groups.ids[read]
