"""Inverted index and BM25.

Postings are (chunk_id, term, positions); a query's tokens meet them by term. The ranks use

    -sum over tokens of idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean length)),
    idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6,

so less is better. A token given twice counts twice; a token of several terms is a phrase. Postings hold their chunk's
length too, so that one query of plain terms is a filter that reaches the scan, a sum per chunk that is combined before the
shuffle, and an order of the best rows only: no join.

A block is a run of BLOCK_CHUNKS chunk ids. bounds() keeps the highest tf and the least length of each term in each block, so that no
chunk of a block scores better than the sum of its terms' best; blocks that can't reach the n-th best chunk seen are not read.

Texts that have no postings are searched in two passes (search_texts): one counts, one scores. A batch of chunks meets a stated set of
queries in NumPy and leaves each query's best rows, so what is shuffled is n rows for each query and partition, and neither
postings nor pairs of chunks and queries are ever made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import index_terms, query_tokens
from tessera.session import spread

# Fixed values of the ranking function.
K1, B = 1.2, 0.75


#: Chunk ids of a block.
BLOCK_CHUNKS = 65_536
#: Blocks, those with the highest bounds, that are read first to learn what the n-th best chunk scores at least.
FIRST_BLOCKS = 4


def block_of(chunk_id: Column) -> Column:
    return F.floor(chunk_id / F.lit(BLOCK_CHUNKS)).cast("int")


def postings(chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """chunk_id, term, tf, positions (from 0, ascending), dl: the chunk's number of terms. A chunk is one row, so that nothing is shuffled."""
    terms = chunks.select(F.col(chunk_id).cast("long").alias("chunk_id"), index_terms(F.col(text)).alias("terms"))
    return terms.mapInArrow(_inverted, "chunk_id long, term string, tf int, positions array<int>, dl int")


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (chunk_id, terms): the postings of each chunk."""
    for b in batches:
        dl = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        named = pc.dictionary_encode(b.column(1).flatten())
        row = np.repeat(np.arange(len(dl)), dl)
        at = np.arange(len(row)) - np.repeat(np.cumsum(dl) - dl, dl)
        key = row * max(1, len(named.dictionary)) + named.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(key, kind="stable")  # places stay in order
        key = key[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        first, end = order[start], np.append(start, len(key))
        places = pa.ListArray.from_arrays(pa.array(end.astype(np.int32)), pa.array(at[order].astype(np.int32)))
        own = pa.array(row[first])
        yield pa.RecordBatch.from_arrays([b.column(0).take(own), named.dictionary.take(named.indices.take(pa.array(first))), pa.array(np.diff(end).astype(np.int32)), places, pa.array(dl[row[first]].astype(np.int32))], ["chunk_id", "term", "tf", "positions", "dl"])


def lengths(chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """chunk_id, dl: the number of terms, 0 too."""
    return chunks.select(F.col(chunk_id).alias("chunk_id"), F.coalesce(F.size(index_terms(F.col(text))), F.lit(0)).alias("dl"))


def bounds(postings_: DataFrame) -> DataFrame:
    """term, block, df, max_tf, min_dl of postings with block."""
    return postings_.groupBy("term", "block").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))


def vocabulary(postings_: DataFrame) -> DataFrame:
    return postings_.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def query_phrases(queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """query_id, phrase (its terms), times: the tokens of each query with at least one term."""
    tokens = queries.select(F.col(query_id).alias("query_id"), F.explode(query_tokens(F.col(query))).alias("token"))
    return tokens.select("query_id", index_terms(F.col("token")).alias("phrase")).where(F.size("phrase") > 0).groupBy("query_id", "phrase").agg(F.count("*").alias("times"))


def _occurrences(postings_: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrase, chunk_id, tf and dl of every phrase."""
    distinct = phrases.select("phrase").distinct()
    single = distinct.where(F.size("phrase") == 1).select("phrase", F.element_at("phrase", 1).alias("term"))
    one = postings_.join(single, "term").select("phrase", "chunk_id", F.col("tf").cast("long").alias("tf"), "dl")
    # of a phrase, the places where its first term would be; they must meet in all its terms
    parts = distinct.where(F.size("phrase") > 1).select("phrase", F.posexplode("phrase").alias("k", "term"))
    starts = postings_.join(parts, "term").select("phrase", "chunk_id", "dl", "k", F.explode("positions").alias("at"))
    whole = starts.groupBy("phrase", "chunk_id", "dl", (F.col("at") - F.col("k")).alias("start")).agg(F.count("*").alias("n")).where(F.col("n") == F.size("phrase"))
    return one.unionByName(whole.groupBy("phrase", "chunk_id", "dl").agg(F.count("*").alias("tf")).select("phrase", "chunk_id", "tf", "dl"))


def scores(postings_: DataFrame, lengths_: DataFrame, queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """query_id, chunk_id, bm25 for every chunk with a token of the query."""
    phrases = query_phrases(queries, query_id, query)
    found = _occurrences(postings_, phrases)
    used = found.groupBy("phrase").agg(F.count("*").alias("n"))
    corpus = lengths_.agg(F.count("*").alias("total"), F.sum("dl").alias("terms"))
    facts = F.broadcast(corpus)  # one row
    weights = phrases.join(used, "phrase").join(facts).withColumn("idf", F.ln((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5)))
    weights = weights.select("query_id", "phrase", (F.col("times") * F.when(F.col("idf") <= 0, F.lit(1e-6)).otherwise(F.col("idf"))).alias("weight"), (F.col("terms") / F.col("total")).alias("mean"))
    hits = found.join(weights, "phrase")
    part = -F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    return hits.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("bm25"))


def top(scored: DataFrame, n: int) -> DataFrame:
    """The n best chunks of each query, with rank; ties to the smaller chunk_id."""
    order = Window.partitionBy("query_id").orderBy(F.round("bm25", 9), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


@lru_cache(256)
def literal_phrases(spark: SparkSession, query: str) -> list[tuple[list[str], int]]:
    """(terms, times) of the query's tokens. A constant expression, which needs no job."""
    row = spark.sql("SELECT 1").select(F.transform(query_tokens(F.lit(query)), index_terms).alias("p")).first()
    counts: dict[tuple[str, ...], int] = {}
    for phrase in row["p"]:
        if phrase:
            counts[tuple(phrase)] = counts.get(tuple(phrase), 0) + 1
    return [(list(p), n) for p, n in counts.items()]


def literal_terms(spark: SparkSession, query: str) -> list[str]:
    """The terms of a query none of whose tokens is a phrase; else none."""
    phrases = literal_phrases(spark, query)
    return [p[0] for p, _ in phrases] if all(len(p) == 1 for p, _ in phrases) else []


def corpus_facts(lengths_: DataFrame) -> tuple[int, int]:
    """Number of chunks and of terms."""
    row = lengths_.agg(F.count("*").alias("total"), F.coalesce(F.sum("dl"), F.lit(0)).alias("terms")).first()
    return row["total"], row["terms"]


def _weights(times: dict[str, int], used: dict[str, int], total: int) -> dict[str, float]:
    return {t: times[t] * (max(math.log((total - n + 0.5) / (n + 0.5)), 0.0) or 1e-6) for t, n in used.items() if n and t in times}


def _scored(hits: DataFrame, weights: dict[str, float], mean: float) -> DataFrame:
    """chunk_id, bm25 of postings of the terms in weights."""
    weight = F.lit(0.0)
    for term, w in weights.items():
        weight = F.when(F.col("term") == term, F.lit(w)).otherwise(weight)
    part = -weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
    return hits.groupBy("chunk_id").agg(F.sum(part).alias("bm25"))


def blocks_to_read(hits: DataFrame, known: list[tuple[str, int, int, int]], weights: dict[str, float], mean: float, n: int) -> tuple[list[int], int]:
    """(blocks that may hold one of the n best chunks, blocks that hold a term); known: term, block, max_tf, min_dl."""
    best: dict[tuple[int, str], float] = {}
    for term, block, tf, dl in known:
        if tf is not None and term in weights:
            bound = weights[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
            best[block, term] = max(bound, best.get((block, term), 0.0))
    reach: dict[int, float] = {}
    for (block, _), bound in best.items():
        reach[block] = reach.get(block, 0.0) + bound
    order = sorted(reach, key=lambda b: (-reach[b], b))
    first = FIRST_BLOCKS
    while first < len(order):
        seen = _scored(hits.where(F.col("block").isin(order[:first])), weights, mean).orderBy("bm25").limit(n).agg(F.count("*"), F.max("bm25")).first()
        if seen[0] == n:
            return [b for b in order if reach[b] >= -seen[1] * (1 - 1e-9) - 1e-8], len(order)
        first *= 4
    return order, len(order)


def search(postings_: DataFrame, lengths_: DataFrame, query: str, n: int, facts: tuple[int, int] | None = None, known: list[tuple[str, int, int, int, int]] | None = None) -> DataFrame:
    """chunk_id, bm25, rank for one query; facts: corpus_facts(lengths_), known: rows of bounds() for the query's terms (term, block, df, max_tf, min_dl)."""
    spark: SparkSession = postings_.sparkSession
    phrases = literal_phrases(spark, query)
    if all(len(p) == 1 for p, _ in phrases):
        times = {p[0]: k for p, k in phrases}
        hits = postings_.where(F.col("term").isin(*times)) if times else postings_.where(F.lit(False))
        used: dict[str, int] = {}
        if known is None:
            used = {r["term"]: r["n"] for r in hits.groupBy("term").agg(F.count("*").alias("n")).collect()} if times else {}
        else:
            for term, _, df, _, _ in known:
                used[term] = used.get(term, 0) + df
        total, terms = facts or corpus_facts(lengths_)
        mean = terms / max(1, total) or 1.0
        weights = _weights(times, used, total)
        if known is not None:
            read, all_ = blocks_to_read(hits, [(t, b, tf, dl) for t, b, _, tf, dl in known], weights, mean, n)
            hits = hits.where(F.col("block").isin(read)) if len(read) < all_ else hits
        scored = _scored(hits, weights, mean)
    else:
        scored = scores(postings_, lengths_, spark.range(1).select(F.lit(0).alias("query_id"), F.lit(query).alias("query")))
    order = F.round("bm25", 9), "chunk_id"  # sums of the same parts may differ in their last digits
    best = scored.orderBy(*order).limit(n)
    return best.select("chunk_id", "bm25", F.row_number().over(Window.orderBy(*order)).alias("rank"))


#: Queries whose scores a task holds at a time, for each of a batch's chunks.
BLOCK = 64


class Wanted:
    """What a stated set of queries looks for: single terms, then phrases; weights are of these features."""

    def __init__(self, asked: list[tuple[int, tuple[str, ...], int]]):
        """asked: (query_id, phrase, times)."""
        self.queries = np.array(sorted({q for q, _, _ in asked}), np.int64)
        self.terms = sorted({t for _, p, _ in asked for t in p})
        at = {t: k for k, t in enumerate(self.terms)}
        self.phrases = sorted({tuple(at[t] for t in p) for _, p, _ in asked if len(p) > 1})
        of = {(k,): k for k in range(len(self.terms))} | {p: len(self.terms) + k for k, p in enumerate(self.phrases)}
        self.features = len(of)
        self.asked = [(int(np.searchsorted(self.queries, q)), of[tuple(at[t] for t in p)], n) for q, p, n in asked]

    def found(self, terms: pa.ListArray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of terms of each chunk, then chunk, feature and times of what is found), chunks ascending."""
        dl = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = pc.fill_null(pc.index_in(terms.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(dl)), dl)
        use = ids >= 0
        keys = [row[use] * self.features + ids[use]]
        for k, p in enumerate(self.phrases):
            m = len(p)
            if len(ids) < m:
                continue
            here = row[: len(row) - m + 1] == row[m - 1 :]
            for j, t in enumerate(p):
                here &= ids[j : len(ids) - m + 1 + j] == t
            keys.append(row[: len(here)][here] * self.features + len(self.terms) + k)
        key, tf = np.unique(np.concatenate(keys), return_counts=True)
        return dl, key // self.features, key % self.features, tf


def _count(wanted: Wanted):
    """mapInArrow over terms: how many chunks have each feature; -1: chunks, -2: terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, n = pa.array(wanted.terms, pa.string()), np.zeros(wanted.features + 2, np.int64)
        for b in batches:
            dl, _, feature, _ = wanted.found(b.column(0), vocabulary)
            n[:-2] += np.bincount(feature, minlength=wanted.features)
            n[-2:] += dl.sum(), len(dl)
        have = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(have < wanted.features, have, have - len(n))), pa.array(n[have])], ["feature", "n"])

    return run


def _best(wanted: Wanted, weights: np.ndarray, mean: float, n: int, digits: int):
    """mapInArrow over (chunk_id, terms): a task's n best chunks of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(wanted.terms, pa.string())
        held = [(np.empty((0, len(q)), np.int64), np.empty((0, len(q)))) for q in np.array_split(wanted.queries, range(BLOCK, len(wanted.queries), BLOCK))]
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            dl, row, feature, tf = wanted.found(b.column(1), vocabulary)
            if not len(row):
                continue
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / mean))
            start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            for k in range(len(held)):
                some = weights[:, k * BLOCK : (k + 1) * BLOCK]
                score = np.add.reduceat(some[feature] * part[:, None], start, axis=0)
                score = np.concatenate([held[k][1], np.where(score > 0, -score, np.inf)])
                ids = np.concatenate([held[k][0], np.broadcast_to(own[row[start]][:, None], (len(start), some.shape[1]))])
                order = np.lexsort((ids, np.round(score, digits)), axis=0)[:n]
                held[k] = np.take_along_axis(ids, order, 0), np.take_along_axis(score, order, 0)
        for k, (ids, score) in enumerate(held):
            at, q = np.nonzero(np.isfinite(score))
            yield pa.RecordBatch.from_arrays([pa.array(wanted.queries[k * BLOCK + q]), pa.array(ids[at, q]), pa.array(score[at, q])], ["query_id", "chunk_id", "bm25"])

    return run


def best_of_texts(chunks: DataFrame, asked: list[tuple[int, tuple[str, ...], int]], n: int, chunk_id: str = "chunk_id", text: str = "text", digits: int = 9) -> DataFrame:
    """query_id, chunk_id, bm25, rank: the n best chunks of each of the queries asked (query_id, phrase, times), over texts without an index.

    Ranks are by the scores rounded to some digits, ties to the smaller chunk_id. A null text has no terms but counts as a chunk.
    """
    order = Window.partitionBy("query_id").orderBy(F.round("bm25", digits), "chunk_id")
    found = _found(chunks, asked, n, chunk_id, text, digits)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _found(chunks: DataFrame, asked: list[tuple[int, tuple[str, ...], int]], n: int, chunk_id: str, text: str, digits: int) -> DataFrame:
    """query_id, chunk_id, bm25: each partition's n best of each query."""
    if not asked:
        return chunks.sparkSession.createDataFrame([], "query_id long, chunk_id long, bm25 double")
    wanted = Wanted(asked)
    texts = spread(chunks.select(F.col(chunk_id).cast("long").alias("chunk_id"), F.col(text).alias("text")))
    terms = texts.select("chunk_id", index_terms(F.col("text")).alias("terms"))
    counted = terms.select("terms").mapInArrow(_count(wanted), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    have = {r["feature"]: r["n"] for r in counted.collect()}  # one row for each term and phrase asked for
    total = have.get(-1, 0)
    weights = np.zeros((wanted.features, len(wanted.queries)))
    for q, feature, times in wanted.asked:
        if used := have.get(feature, 0):
            weights[feature, q] += times * max(math.log((total - used + 0.5) / (used + 0.5)), 0.0) or times * 1e-6
    return terms.mapInArrow(_best(wanted, weights, have.get(-2, 0) / max(1, total) or 1.0, n, digits), "query_id long, chunk_id long, bm25 double")


def asked_by(queries: DataFrame, query_id: str = "query_id", query: str = "query") -> list[tuple[int, tuple[str, ...], int]]:
    """The phrases of a stated set of queries, for best_of_texts(). They come to the driver; for more than that, there is scores()."""
    return [(r["query_id"], tuple(r["phrase"]), r["times"]) for r in query_phrases(queries.where(F.col(query_id).isNotNull()), query_id, query).collect()]


#: Phrases of a query that search_texts() counts by an expression each.
EXPRESSIONS = 32


def _times_in(terms: Column, phrase: list[str]) -> Column:
    """How often a phrase stands in a list of terms."""
    if len(phrase) == 1:
        return F.size(terms) - F.size(F.array_remove(terms, phrase[0]))
    # terms are letters and digits only; nothing is consumed, so that occurrences may overlap
    return F.regexp_count(F.concat(F.lit(" "), F.array_join(terms, " "), F.lit(" ")), F.lit(f"(?<= )(?={' '.join(phrase)} )"))


def search_texts(chunks: DataFrame, query: str, n: int, chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """chunk_id, bm25, rank of one query over texts without an index. Built-in expressions only, but for very long queries."""
    phrases = literal_phrases(chunks.sparkSession, query)
    order = F.round("bm25", 9), "chunk_id"
    if 0 < len(phrases) <= EXPRESSIONS:
        texts = spread(chunks.select(F.col(chunk_id).alias("chunk_id"), F.col(text).alias("text")))
        tf = [f"tf{k}" for k in range(len(phrases))]
        # a list of one struct, so that a text is taken apart once and not for each column
        counted = lambda terms: F.struct(F.coalesce(F.size(terms), F.lit(0)).alias("dl"), *[F.coalesce(_times_in(terms, p), F.lit(0)).alias(c) for c, (p, _) in zip(tf, phrases, strict=True)])
        each = texts.select("chunk_id", F.inline(F.transform(F.array(index_terms(F.col("text"))), counted)))
        facts = each.agg(F.count("*").alias("total"), F.coalesce(F.sum("dl"), F.lit(0)).alias("terms"), *[F.count_if(F.col(c) > 0).alias(c) for c in tf]).first()
        length = K1 * (1 - B + B * F.col("dl") / F.lit(facts["terms"] / max(1, facts["total"])))
        scored = F.lit(0.0)
        for c, (_, times) in zip(tf, phrases, strict=True):
            if used := facts[c]:
                scored = scored - F.when(F.col(c) > 0, times * (max(math.log((facts["total"] - used + 0.5) / (used + 0.5)), 0.0) or 1e-6) * F.col(c) * (K1 + 1) / (F.col(c) + length)).otherwise(0.0)
        found = each.where(F.greatest(F.lit(0), *tf) > 0).select("chunk_id", scored.alias("bm25"))
    else:
        found = _found(chunks, [(0, tuple(p), k) for p, k in phrases], n, chunk_id, text, 9)
    best = found.orderBy(*order).limit(n)
    return best.select("chunk_id", "bm25", F.row_number().over(Window.orderBy(*order)).alias("rank"))
