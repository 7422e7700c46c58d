"""MinHash near-dedup: circulant signatures, bands, exact verification.

A document is its set of distinct five-word shingles. Two permutations make all coordinates of its signature: the first deals the
shingles to places of a circle, the second gives each place a rank and is shifted by one place for each further coordinate; a
coordinate is the least rank among the set's places. A band is ROWS coordinates; sets that agree in a band are candidates. Bands only
propose: a link is confirmed by the exact intersection of the full sets. Of sets with the least similarity that links, 17/20, a pair meets in
no band with a chance of (1 - 0.85 ** 8) ** 64 = 1.4e-9, of closer ones with less; equal sets are one class and need no band.

Groups of sets that agree in a band are matched, spared their crowds and verified as those of the Jaccard join: against leaders in turns, then
by the rarest tokens of what is still apart. No group is expanded into its pairs.

Defined results: null and word-less texts have no shingles and stand alone; a text of one to four words is one shingle; rows with one
doc_id are one node; a row with null doc_id links with nothing, has a null component and is kept; an empty table gives no rows.
Ids are integers. Longer sets than PLACES fill the circle, which proposes more candidates and loses none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, mix64, plan_bytes, stage_table, trimmed, unused
from tessera.llm.jaccard import FOUND, PACKED, frequent_tokens, matched, resolved, signed

#: Similarity of at least 17/20, in exact integers: 20 * intersection >= 17 * union.
NUM, DEN = 17, 20
BANDS, ROWS = 64, 8
WIDTH = BANDS * ROWS
#: Places of the circle, a power of two.
PLACES = 1 << 20
#: Shingles whose ranks are looked up at a time: 512 of them take 1 MB.
STEP = 512


@lru_cache(1)
def circle() -> np.ndarray:
    """Row p: the ranks that a shingle at place p has in the WIDTH coordinates. A view of one permutation, shifted."""
    order = np.argsort(mix64(np.arange(PLACES, dtype=np.uint64) + U64(0x9E3779B97F4A7C15)), kind="stable")
    rank = np.empty(PLACES, np.uint32)
    rank[order] = np.arange(PLACES, dtype=np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([rank, rank[: WIDTH - 1]]), WIDTH)


def places(tokens: np.ndarray) -> np.ndarray:
    """The first permutation: of the tokens' 64 bits, of which the first choose the place."""
    return (mix64(tokens ^ U64(0xC2B2AE3D27D4EB4F)) >> U64(64 - PLACES.bit_length() + 1)).astype(np.int64)


def coordinates(tokens: np.ndarray) -> np.ndarray:
    """The signature of one set."""
    at, ranks = places(tokens), circle()
    least = ranks[at[:STEP]].min(0)
    for k in range(STEP, len(at), STEP):
        np.minimum(least, ranks[at[k : k + STEP]].min(0), out=least)
    return least


_FACTORS = mix64(np.arange(1, ROWS + 1, dtype=np.uint64)) | U64(1)
_BAND = mix64(np.arange(BANDS, dtype=np.uint64) + U64(77))


def bands(tokens: np.ndarray, text: np.ndarray, size: np.ndarray, probing: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Signatures of each set's bands, for signed(): all of them ask and answer."""
    at = np.concatenate([[0], np.cumsum(size)])
    live = np.flatnonzero((size > 0) & probing)
    low = np.array([coordinates(tokens[at[t] : at[t + 1]]) for t in live], np.uint64).reshape(-1, BANDS, ROWS)
    sums = mix64((low * _FACTORS).sum(2, dtype=np.uint64) ^ _BAND)
    yield (sums & ~U64(7) | U64(1)).ravel(), np.repeat(live, BANDS), np.zeros(len(size), bool)


def minhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = rows.where(F.col("doc_id").isNotNull())
    k = max(256, plan_bytes(rows) // bucket_bytes)
    common = docs.sparkSession.sparkContext.broadcast(frequent_tokens(named, named.count()))  # at most 200,000 tokens
    found = stage_table(named.mapInArrow(signed(k, 0, bands), PACKED).groupBy("bucket").applyInArrow(trimmed(matched), FOUND), "groups")
    out = resolved(rows, found, NUM, DEN, common)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose id is their component's smallest."""
    found = minhash_components(docs, doc_id, text).where("not kept").select("doc_id").distinct().withColumnRenamed("doc_id", gone := unused("gone", docs))
    return docs.join(found, docs[doc_id].cast("long") == F.col(gone), "left_anti")
