"""Benchmark decontamination by winnowing.

Words are hashed, and of each six consecutive five-word grams the one with the least hash is kept, the rightmost of equal
ones. Every run of ten words that a document and a benchmark item share is such a window on both sides, so they share a kept
gram at the same place of it: every shared span of ten words or more is found. Kept grams of documents are looked up
among those of the benchmark; a hit is extended to the ten-word windows around it, and these are compared word by word.
An item of under ten words is one window; its length is looked up as a gram of that length.

A benchmark under ``limit`` bytes goes to the executors as a table, and the documents are read in one pass without a
shuffle. A larger one is joined: kept grams of both sides meet by hash, a document gets back which of its own grams some item has and
sends the windows around these, and windows meet with those of items by hash and words. So a gram or window that very many items have
is one row on the benchmark's side, and no item's text goes to a document; the items of a document are only named at the end.

Defined results: null text has no words; a document without hits has the digest of the empty string; items are counted by
item_id, so repeated items count once, and an item without words or without id has no windows; rows are judged one by one, so repeated rows repeat
their result; an empty benchmark marks nothing.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, U64, byte_table, find_words, gram_hash, prefix_hash, span_hash, stage_table, text_slices

WINDOW, GRAM = 10, 5
_KEPT = WINDOW - GRAM + 1
INSIDE = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))  # after lower-casing
#: Bytes of benchmark text up to which its windows are sent to every executor.
LIMIT = 4 << 20


class Words:
    """The words of some texts: lower-cased bytes, bounds, hashes, and the first word of each text."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.low = LOWER[data]
        self.start, self.end, self.first = find_words(self.low, offs, INSIDE)
        self.hash = span_hash(prefix_hash(self.low), self.start, self.end)
        self.count = np.diff(self.first)
        self.raw = self.low.tobytes()

    def span(self, at: int, n: int) -> bytes:
        return b" ".join([self.raw[a:b] for a, b in zip(self.start[at : at + n].tolist(), self.end[at : at + n].tolist(), strict=True)])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of the runs of n words within a text."""
        size = np.maximum(self.count - n + 1, 0)
        at = np.arange(size.sum()) + np.repeat(self.first[:-1] - (np.cumsum(size) - size), size)
        return gram_hash(self.hash, n)[at], at

    def winnowed(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of the kept grams."""
        size = np.maximum(self.count - WINDOW + 1, 0)
        at = np.arange(size.sum()) + np.repeat(self.first[:-1] - (np.cumsum(size) - size), size)
        gram = gram_hash(self.hash, GRAM)
        if not len(at):
            return np.empty(0, np.uint64), at
        n = len(gram) - _KEPT + 1
        best, place = gram[:n].copy(), np.arange(n)
        for j in range(1, _KEPT):
            less = gram[j : j + n] <= best
            best[less] = gram[j : j + n][less]
            place[less] = np.flatnonzero(less) + j
        kept = place[at]
        kept = kept[np.concatenate([[True], kept[1:] != kept[:-1]])]
        return gram[kept], kept


class Index:
    """Windows of items: kept grams (and whole short items by length) as sorted hashes, windows as words with their items."""

    def __init__(self, items: Iterable[tuple[str, str]]):
        self.items: list[str] = []
        self.windows: dict[bytes, set[int]] = defaultdict(set)
        number: dict[str, int] = {}
        kept, short, whole = [np.empty(0, np.uint64)], defaultdict(set), [np.empty(0, np.uint64)]
        for item, text in items:
            if item is None or not text:
                continue
            raw = np.frombuffer(text.encode(), np.uint8)
            words = Words(raw, np.array([0, len(raw)]))
            n = int(words.count[0])
            if not n:
                continue
            k = number.setdefault(item, len(number))
            width = min(n, WINDOW)
            for at in range(n - width + 1):
                self.windows[words.span(at, width)].add(k)
            whole.append(words.grams(width)[0])
            if width < WINDOW:
                short[width].update(words.grams(width)[0].tolist())
            else:
                kept.append(words.winnowed()[0])
        self.items = sorted(number, key=number.__getitem__)
        self.kept = np.unique(np.concatenate(kept))
        self.whole = np.unique(np.concatenate(whole))
        self.short = {n: np.array(sorted(v), np.uint64) for n, v in sorted(short.items())}
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.kept >> U64(44)).astype(np.int64)] = True

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, list[set[int]]]:
        """(first word, words, items) of each window of an item in the texts."""
        hash_, at = words.winnowed()
        near = self.maybe[(hash_ >> U64(44)).astype(np.int64)]
        at = at[near][_among(hash_[near], self.kept)]
        found = []
        if len(at):
            text = np.searchsorted(words.first, at, "right") - 1
            start = np.unique((at[:, None] + np.arange(1 - _KEPT, 1)).ravel()[((at[:, None] + np.arange(1 - _KEPT, 1)) >= words.first[text][:, None]).ravel() & ((at[:, None] + np.arange(1 - _KEPT, 1) + WINDOW) <= words.first[text + 1][:, None]).ravel()])
            # windows whose hash no item has needn't be compared
            start = start[_among(gram_hash(words.hash, WINDOW)[start], self.whole)]
            found += [(int(s), WINDOW) for s in start]
        for n, hashes in self.short.items():
            hash_, at = words.grams(n)
            found += [(int(s), n) for s in at[_among(hash_, hashes)]]
        spans = [(s, n, w) for s, n in found if (w := self.windows.get(words.span(s, n)))]
        return np.array([s for s, _, _ in spans], np.int64), np.array([n for _, n, _ in spans], np.int64), [w for _, _, w in spans]


def _among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def judge(index: Index, column: pa.Array) -> list[tuple[int, int, list[str]]]:
    """(words, words hit, items) of each text."""
    out: list[tuple[int, int, list[str]]] = []
    for _, _, data, offs in text_slices(column):
        words = Words(data, offs)
        start, length, items = index.hits(words)
        edge = np.zeros(len(words.start) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + length, -1)
        hit = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
        n_hit = np.diff(hit[words.first])
        got: dict[int, set[int]] = defaultdict(set)
        for t, w in zip((np.searchsorted(words.first, start, "right") - 1).tolist(), items, strict=True):
            got[t] |= w
        out += [(int(words.count[t]), int(n_hit[t]), sorted(index.items[k] for k in got.get(t, ()))) for t in range(len(offs) - 1)]
    return out


_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>"


def _columns(found: list[tuple[int, int, list[str]]]) -> list[pa.Array]:
    return [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([len(x[2]) for x in found], pa.int64()), pa.array([hashlib.sha256(",".join(x[2]).encode()).hexdigest() for x in found], pa.string()), pa.array([x[1] > 0 for x in found], pa.bool_()), pa.array([x[2] for x in found], pa.list_(pa.string()))]


def _small(docs: DataFrame, benchmark: DataFrame):
    return docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in benchmark.collect()])  # under LIMIT bytes


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    return benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where("item is not null and text is not null").distinct()


def _fits(items: DataFrame, limit: int) -> bool:
    return (items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) <= limit


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and item_ids of each row of docs."""
    items = _items(benchmark, item_id, item_text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    if not _fits(items, limit):
        return _joined(rows, items).select("__row.doc_id", *[c.split()[0] for c in _RESULT.split(", ")])
    shared = _small(docs, items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *_columns(judge(index, b.column(1)))], ["doc_id", *[c.split()[0] for c in _RESULT.split(", ")]])

    return rows.mapInArrow(run, f"doc_id {kind}, {_RESULT}")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """The rows of docs, unchanged, that hold no window of an item."""
    items = _items(benchmark, "item_id", "text")
    if not _fits(items, limit):
        return _joined(docs, items, text).where("n_hit = 0").select("__row.*")
    shared, at = _small(docs, items), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for b in batches:
            yield b.filter(pa.array([x[1] == 0 for x in judge(index, b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _fingerprints(rows: DataFrame, key: str, lengths: list[int]) -> DataFrame:
    """(key, fp): the kept grams of each text, and its grams of the given lengths under WINDOW."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, _, data, offs in text_slices(b.column(1)):
                words = Words(data, offs)
                for hash_, at in [words.winnowed(), *[words.grams(n) for n in lengths]]:
                    t = np.searchsorted(words.first, at, "right") - 1
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t + row)), pa.array(hash_.view(np.int64))], [key, "fp"])

    return rows.mapInArrow(run, f"{key} string, fp long").distinct()


def _windows(words: Words, at: np.ndarray, n: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(length, hash, words) of the windows of n words at some places."""
    return pa.array(np.full(len(at), n, np.int64)), pa.array(gram_hash(words.hash, n)[at].view(np.int64) if len(at) else [], pa.int64()), pa.array([words.span(int(a), n) for a in at], pa.binary())


def _item_windows(items: DataFrame) -> DataFrame:
    """item, n, hash and words of each window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, _, data, offs in text_slices(b.column(1)):
                words = Words(data, offs)
                width = np.minimum(words.count, WINDOW)
                for n in np.unique(width[width > 0]).tolist():
                    _, at = words.grams(n)
                    t = np.searchsorted(words.first, at, "right") - 1
                    at, t = at[width[t] == n], t[width[t] == n]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t + row)), *_windows(words, at, n)], ["item", "n", "hash", "words"])

    return items.select("item", "text").mapInArrow(run, "item string, n long, hash long, words binary")


def _near_windows(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """key, at, n, hash and words of the windows of (key, text, fps) that hold one of the kept grams fps, or are a short gram of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, end, data, offs in text_slices(b.column(1)):
                words = Words(data, offs)
                for n, (hash_, at) in [(WINDOW, words.winnowed()), *[(n, words.grams(n)) for n in lengths]]:
                    cut = np.searchsorted(at, words.first)
                    for t in range(end - row):
                        own = hash_[cut[t] : cut[t + 1]]
                        own = at[cut[t] : cut[t + 1]][np.isin(own, np.array(b.column(2)[row + t].as_py(), np.int64).view(np.uint64))]
                        if n == WINDOW:
                            own = np.unique((own[:, None] + np.arange(1 - _KEPT, 1)).ravel())
                            own = own[(own >= words.first[t]) & (own + WINDOW <= words.first[t + 1])]
                        if len(own):
                            yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[row + t].as_py()] * len(own), pa.string()), pa.array(own - words.first[t]), *_windows(words, own, n)], ["key", "at", "n", "hash", "words"])

    return texts.select("key", "text", "fps").mapInArrow(run, "key string, at long, n long, hash long, words binary")


def _joined(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """docs as the struct __row with the result's columns, for a benchmark of any size; equal texts are judged once."""
    windows = stage_table(_item_windows(items), "windows")
    lengths = sorted(r[0] for r in windows.where(f"n < {WINDOW}").select("n").distinct().collect())  # under WINDOW of them
    keyed = docs.select(F.struct("*").alias("__row"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("__key"))
    texts = stage_table(keyed.select(F.col("__key").alias("key"), F.col(f"__row.{text}").alias("text")).dropDuplicates(["key"]), "texts")
    wanted = stage_table(_fingerprints(items.select("item", "text"), "item", lengths).select("fp").distinct(), "grams")
    mine = _fingerprints(texts, "key", lengths).join(wanted, "fp", "left_semi").groupBy("key").agg(F.collect_list("fp").alias("fps"))  # of a text's own grams
    near = _near_windows(texts.join(mine, "key"), lengths)
    distinct = stage_table(windows.select("n", "hash", "words").distinct(), "distinct")
    hits = stage_table(near.join(distinct, ["n", "hash", "words"], "left_semi"), "hits")
    covered = hits.groupBy("key").agg(F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence("at", F.col("at") + F.col("n") - 1))))).cast("long").alias("n_hit"))
    named = hits.select("key", "n", "hash", "words").distinct().join(windows, ["n", "hash", "words"]).groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    judged = covered.join(named, "key").select(F.col("key").alias("__of"), "n_hit", "item_ids")
    met = keyed.join(judged, F.col("__key") == F.col("__of"), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    n_words = F.coalesce(F.regexp_count(F.col(f"__row.{text}"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    return met.select("__row", n_words.alias("n_words"), n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), ids.alias("item_ids"))
