"""Substring dedup by hashing lines and sentences.

A text's units are its lines, its sentences (up to a word that ends in . ! or ?, or a line's end), and, so that short
sentences within a repeated passage go with it, two sentences in a row of which one is too short to be a unit. A unit is normalised to
its words, runs of other bytes than white space, with A-Z lower-cased. Every line, and sentences of enough words, are hashed; of equal units the one of the
smallest (doc_id, place) is kept, the rest are removed, and the removed spans are given by their places in the original text.

Lines of few words also repeat by chance. Such a line goes only if it stands at PLACES places at least, and at ABOVE times as
many as if words were drawn one by one: the number of lines of so many words, times the shares of its words among those
of longer lines, the last one's among their ends. Batches count their own places and shares, and its bucket puts them together.

Documents are dealt by ranges of ids into batches; each batch sends its distinct unit hashes, packed, to their buckets and
gets back which of them an earlier batch has. So a line in a third of all documents costs its bucket one entry a batch.

Defined results: null text is empty; sentences under the least number of words stay; rows with one doc_id are ranked by text
(where they fill several batches, by its hash first); a null doc_id ranks last; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, U64, byte_table, find_words, mix64, powers, prefix_hash, span_hash, text_slices, trimmed
from tessera.llm.suffix_dedup import CODES, HASHES, Batch, answers, bucket_of, code, cuts, dealt, ddl, digest, joined, planes, table_of, unplanes

SPACE = byte_table((0x20, 0x20), (0x09, 0x0D))
STOPS = byte_table((0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))
#: Least words of a line and of a sentence that need no more than to repeat; shorter ones repeat by chance.
LINE_WORDS, SENTENCE_WORDS = 5, 6
#: Places at which a shorter line must stand to go, and how many times as many as by chance.
PLACES, ABOVE = 5, 10
_BASE = 0xD6E8FEB86659FD93
_COUNTED = pa.schema([*HASHES, ("places", pa.binary()), ("chance", pa.binary())])


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, other hash, text, start, end, words) of the units by place, words being 0 for those that need no more than to
    repeat; then the words' hashes of each line that isn't one of these (the last in the last column, 0 for none), and those
    of the longer lines, and of their ends."""
    low = LOWER[data]
    start, end, first = find_words(low, offs, ~SPACE)
    n = len(start)
    if not n:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 4 + (np.empty((0, LINE_WORDS - 1), np.uint64),) + (np.empty(0, np.uint64),) * 2
    words = span_hash(prefix_hash(low), start, end)
    breaks = np.concatenate([[0], np.cumsum(low == 0x0A)])
    text = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    line = np.ones(n, bool)  # whether a word is the last of its line
    line[:-1] = (breaks[start[1:]] > breaks[end[:-1]]) | (text[1:] != text[:-1])
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * powers(_BASE, n))]) for w in (words, mix64(words + U64(1)))]
    inverse = powers(pow(_BASE, -1, 1 << 64), n)
    out = []
    for kind, last, least in ((1, line, 1), (2, line | STOPS[low[end - 1]], SENTENCE_WORDS), (3, None, SENTENCE_WORDS)):
        if kind < 3:
            e = np.flatnonzero(last) + 1
            s = np.concatenate([[0], e[:-1]])
            use = e - s >= least
        else:  # of the sentences just seen
            s, e, short = s[:-1], e[1:], (e - s < least)
            use = (short[:-1] | short[1:]) & (e - s >= least) & (text[s] == text[e - 1])
        a, z = s[use], e[use]
        h = [mix64((p[z] - p[a]) * inverse[a] + U64(kind * _BASE % (1 << 64))) for p in sums]
        size = z - a
        out.append((*h, text[a], start[a], end[z - 1], np.where((size < LINE_WORDS) & (kind == 1), size, 0)))
        if kind == 1:
            few, many = size < LINE_WORDS, size >= LINE_WORDS
            own = np.zeros((few.sum(), LINE_WORDS - 1), np.uint64)
            own[:, -1] = words[z[few] - 1]
            for j in range(LINE_WORDS - 2):
                more = size[few] > j + 1
                own[more, j] = words[a[few][more] + j]
            lines = own, words[np.repeat(many, size)], words[z[many] - 1]
    h, c, t, s, e, size = (np.concatenate(x) for x in zip(*out, strict=True))
    return h, c, t, s - offs[t], e - offs[t], size, *lines


def by_chance(size: np.ndarray, own: np.ndarray, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many lines like each short one (its number of words and their hashes) would be expected among so many of that number of words."""
    known = np.unique(own)

    def share(x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        return np.bincount(at[known[at] == x], minlength=len(known)) / max(1, len(x))

    if not len(own):
        return np.empty(0)
    at = np.searchsorted(known, own)
    each = np.where(own[:, :-1] > 0, share(words)[at[:, :-1]], 1.0)
    return np.bincount(size)[size] * each.prod(1) * share(ends)[at[:, -1]]


class Units(Batch):
    """Their distinct hashes are in order, those of short lines first."""

    def scan(self) -> None:
        parts = []
        for row, _, data, offs in text_slices(self.text):
            h, c, t, *rest = units(data, offs)
            parts.append((h, c, t + row, *rest))
        self.h, self.c, self.row, self.first, self.end, self.size, *self.lines = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.h, self.c = self.h >> U64(16), self.c >> U64(16)
        long = self.size == 0
        order = np.lexsort((self.first, self.row, self.c, self.h, long))
        h, c, long = self.h[order], self.c[order], long[order]
        self.order = order
        self.new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (long[1:] != long[:-1])]) if len(h) else np.empty(0, bool)
        self.start = np.flatnonzero(self.new)
        self.uh, self.uc, self.short = h[self.start], c[self.start], ~long[self.start]

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct short line, its places in the batch and the number expected by chance."""
        few = self.size > 0
        chance = np.zeros(len(few), np.float32)
        chance[few] = by_chance(self.size[few], *self.lines)
        places = np.diff(np.append(self.start, len(self.order)))[self.short]
        return places.astype(np.uint32), chance[self.order[self.start[self.short]]]


def _send(k: int):
    """Buckets under k are those of short lines."""

    def run(table: pa.Table) -> pa.Table:
        b, batch = Units(table), table.column("batch")[0].as_py()
        b.scan()
        places, chance = b.counted()
        bucket = bucket_of(b.uh, k).astype(np.int64) + np.where(b.short, 0, k)
        return table_of(_COUNTED, [(x, batch, planes(b.uh[i:j]), planes(b.uc[i:j]), places[i:j].tobytes() if x < k else b"", chance[i:j].tobytes() if x < k else b"") for x, i, j in cuts(bucket)])

    return run


def _code(k: int, batches: int):
    """A bucket's answers. Bit 0: an earlier batch has the unit; bit 3: it stays, as a line that chance may repeat."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket >= k:
            return code(table)
        table = table.sort_by("batch")
        hs = [unplanes(x.as_py()) for x in table.column("h")]
        h, c = np.concatenate(hs), np.concatenate([unplanes(x.as_py()) for x in table.column("c")])
        places, chance = (np.concatenate([np.frombuffer(x.as_py(), t) for x in table.column(name)]) for name, t in (("places", np.uint32), ("chance", np.float32)))
        order = np.lexsort((c, h))  # stable, so the lowest batch comes first
        h, c = h[order], c[order]
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
        unit = np.cumsum(fresh) - 1
        many = np.bincount(unit, places[order])
        # batches that don't have the line are taken to have the mean of the others
        expected = np.bincount(unit, chance[order]) / np.bincount(unit) * batches
        stays = (many < PLACES) | (many < ABOVE * expected)
        codes = np.empty(len(h), np.uint8)
        codes[order] = (~fresh).astype(np.uint8) | stays[unit].astype(np.uint8) << 3
        cut = np.cumsum([0, *map(len, hs)])
        return table_of(CODES, [(x, bucket, codes[i:j].tobytes()) for x, i, j in zip(table.column("batch").to_pylist(), cut[:-1], cut[1:], strict=True)])

    return run


def _finish(docs: pa.Table, codes: pa.Table) -> pa.Table:
    b = Units(docs)
    b.scan()
    bits = answers(codes)
    assert len(bits) == len(b.start)
    each = np.diff(np.append(b.start, len(b.order)))
    gone = b.order[(np.repeat(bits & 1 == 1, each) | ~b.new) & ~np.repeat(bits & 8 == 8, each)]
    row, start, end = joined(b.row[gone], b.first[gone], b.end[gone])
    cut = np.searchsorted(row, np.arange(len(b.ids) + 1))
    each = (((t.as_py() or "").encode(), list(zip(start[i:j].tolist(), end[i:j].tolist(), strict=True))) for t, i, j in zip(b.text, cut[:-1], cut[1:], strict=True))
    return digest(b.table.drop_columns(["__id"]), each)


def repeated_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batch_bytes: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and spans: starts and ends, in bytes, of the removed runs in turn."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows, k, batches = dealt(slim, batch_bytes)
    by_batch = rows.groupBy("batch")
    codes = by_batch.applyInArrow(trimmed(_send(k)), ddl(_COUNTED)).groupBy("bucket").applyInArrow(trimmed(_code(k, batches)), ddl(CODES))
    return by_batch.cogroup(codes.groupBy("batch")).applyInArrow(trimmed(_finish), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
