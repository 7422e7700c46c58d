"""Removal of byte strings of 50 bytes or more that an earlier document has.

A byte goes if some 50-byte string over it also starts in a document with a smaller id. That is told by longest-previous-factor
arrays: in suffix order, the longest match of a suffix with an earlier document stands at the previous or the next position with
a smaller document; where that match has 50 bytes, they go. One suffix array of a corpus can't be built in one place, so the
strings that may match are brought together first, exactly, and arrays are built bucket by bucket:

1. Anchors. Of the 35 16-byte grams of a 50-byte window the one with the least hash is its anchor (the rightmost of equal
   ones), so equal windows have equal anchors at equal places. A run of windows with one anchor is a context.
2. Documents are dealt by ranges of ids into batches. Each batch sends its distinct (anchor, context) hashes, packed, to
   the anchor's bucket, and gets two bits for each: whether a batch of an earlier range has this context, and whether it may share
   a window with another context of the anchor. Contexts that an earlier document has whole are removed; they are told by two independent
   hashes of 48 bits, which no two of n different contexts share but by a chance of n * n / 2 ** 97. A window has 34 bytes beside its anchor,
   so 17 at least on one side: contexts with no others of their anchor that have the 17 bytes before or behind it (16 bits of hash a side)
   are done. In a large corpus most anchors stand in several contexts by chance, two or three words being the same; five or six seldom are.
3. Only of the others the bytes of each distinct context are sent. A bucket sorts the windows' suffixes by prefix
   doubling (8, 16, 32, then 50 bytes), finds previous and next smaller documents, takes the lengths of the matches from the
   ranks, and the longer one is the longest previous factor, counted up to 50 bytes.
4. Each batch joins the removed windows into spans and cuts them.

The batch exchange of the documents is one exchange in the plan, used three times. A batch sends a hash or context once
however many of its documents have it, so a passage in a third of all documents costs a bucket one entry a batch. At such
a passage's edges contexts differ from document to document; of an anchor with very many contexts (in all, or in one batch, which then doesn't send them) the windows go to
buckets of their own, where those in the passage are one again and the others are spread.

Defined results: null text is empty; texts under 50 bytes keep all; rows with one doc_id are one document and don't remove
each other's bytes; a null doc_id is later than all others, and such rows don't remove each other's bytes. Ids are integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, mix64, plan_bytes, powers, prefix_hash, span_hash, text_slices, trimmed

LENGTH, GRAM = 50, 16
_SPREAD = LENGTH - GRAM + 1
#: A window has at least so many bytes on one side of its anchor.
SIDE = (LENGTH - GRAM + 1) // 2
_AT = U64((1 << 28) - 1)
LAST = np.iinfo(np.int64).max
#: Bytes whose contexts are found at a time, few enough for their arrays to stay in a processor's cache.
SLICE_BYTES = 1 << 17
#: Contexts of an anchor from which on its windows go each to a bucket of its own, so that no bucket gathers them all.
CONTEXTS = 100_000
#: The same within one batch: such an anchor's contexts aren't sent, only that there are many.
OWN_CONTEXTS = 1000
#: A batch's number is its range of ids, and in the last SHIFT bits its part of the range.
SHIFT = 20
#: Least bytes of a batch, and input bytes per square byte of it: batches, like buckets, grow with the root of the input.
BATCH_BYTES, GROWTH = 4 << 20, 256
#: Sampled ids per batch and at most, for the bounds of ranges; ids that fill several batches which are dealt by hash, at most.
SAMPLED, SAMPLE, SPLIT_IDS = 20, 4_000_000, 1000
_INVERSE_BASE = pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, sides, text, first window, windows) of each context of some texts, in order."""
    n = len(data)
    if n < LENGTH:
        return (np.empty(0, np.uint64),) * 3 + (np.empty(0, np.int64),) * 3
    assert n < 1 << 28, "a text of 256 MB"
    prefix = prefix_hash(data)
    gram = (prefix[GRAM:] - prefix[:-GRAM]) * powers(_INVERSE_BASE, n - GRAM + 1)
    gram *= U64(0xBF58476D1CE4E5B9)
    gram ^= gram >> U64(29)
    gram *= U64(0x94D049BB133111EB)
    # the order of grams: hash, then place from the right
    key = gram & ~_AT | (_AT - np.arange(len(gram), dtype=np.uint64))
    for step in (1, 2, 4, 8, 16):
        key = np.minimum(key[:-step], key[step:])
    key = np.minimum(key[: -(_SPREAD - 32)], key[_SPREAD - 32 :])
    place = (_AT - (key & _AT)).astype(np.int64)
    text = np.repeat(np.arange(len(offs) - 1), np.maximum(np.diff(offs) - LENGTH + 1, 0))
    window = np.arange(len(text)) + np.repeat(offs[:-1] - (np.cumsum(size := np.maximum(np.diff(offs) - LENGTH + 1, 0)) - size), size)
    place = place[window]
    if not len(place):
        return (np.empty(0, np.uint64),) * 3 + (np.empty(0, np.int64),) * 3
    start = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.append(start, len(place)))
    first, at = window[start], place[start]
    end = first + count - 1 + LENGTH
    context = span_hash(prefix, first, end)
    anchor = mix64(gram[at])
    left, right = np.flatnonzero(at - SIDE >= first), np.flatnonzero(at + GRAM + SIDE <= end)
    sides = np.zeros(len(at), np.uint64)
    sides[left] = _side(span_hash(prefix, at[left] - SIDE, at[left])) << U64(16)
    sides[right] |= _side(span_hash(prefix, at[right] + GRAM, at[right] + GRAM + SIDE))
    return anchor, mix64(context + anchor + (at - first).astype(np.uint64) * U64(0x9FB21C651E98DF25)), sides, text[start], first - offs[text[start]], count


def _side(x: np.ndarray) -> np.ndarray:
    """A side's hash in 16 bits; 0 is the sign of a context that doesn't reach so far."""
    return np.maximum(x >> U64(48), U64(1))


def by_hash(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A stable order of hashes of 48 bits in which equal h, and equal (h, c), stand together: by h and the last bits of c, then by c."""
    key = h << U64(16) | c & U64(0xFFFF)
    order = np.argsort(key, kind="stable")
    key, c = key[order], c[order]
    apart = np.flatnonzero((key[1:] == key[:-1]) & (c[1:] != c[:-1]))
    if len(apart):
        run = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        mixed = np.zeros(run[-1] + 1, bool)
        mixed[run[apart]] = True
        at = np.flatnonzero(mixed[run])
        order[at] = order[at][np.lexsort((c[at], run[at]))]
    return order


class Batch:
    """The documents of a batch by id, their contexts, and the distinct ones of these in the order of hashes."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").combine_chunks().fill_null(int(LAST)).to_numpy(zero_copy_only=False)
        table = table.append_column("__id", pa.array(ids)).sort_by([("__id", "ascending"), ("text", "ascending")])
        self.ids, self.text, self.table = table.column("__id").to_numpy(), table.column("text"), table

    def scan(self) -> None:
        parts = []
        for row, _, data, offs in text_slices(self.text, SLICE_BYTES):
            h, c, s, t, first, count = _runs(data, offs)
            parts.append((h, c, s, t + row, first, count))
        self.h, self.c, self.s, self.row, self.first, self.count = (np.concatenate(x) if parts else np.empty(0, np.int64) for x in (zip(*parts, strict=True) if parts else [()] * 6))
        self.h, self.c = self.h.astype(np.uint64) >> U64(16), self.c.astype(np.uint64) & U64((1 << 48) - 1)
        order = by_hash(self.h, self.c)  # stable: of equal contexts the earliest document's comes first
        h, c = self.h[order], self.c[order]
        self.new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(h) else np.empty(0, bool)
        self.order, self.start = order, np.flatnonzero(self.new)
        self.uh, self.uc, self.us = h[self.start], np.maximum(c[self.start], U64(1)), self.s[order[self.start]].astype(np.uint64)
        anchor = np.flatnonzero(np.concatenate([[True], self.uh[1:] != self.uh[:-1]])) if len(self.uh) else np.empty(0, np.int64)
        kinds = np.diff(np.append(anchor, len(self.uh)))
        self.crowded = np.repeat(kinds > OWN_CONTEXTS, kinds)
        self.sent = ~self.crowded
        self.sent[anchor] = True
        self.uc[self.crowded] = 0  # the sign of very many


def planes(x: np.ndarray, n: int = 6) -> bytes:
    """Numbers of n bytes (48 bits) as so many byte planes, which compress where numbers are sorted."""
    return np.ascontiguousarray(x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - n :].T).tobytes()


def unplanes(b: bytes, n: int = 6) -> np.ndarray:
    p = np.frombuffer(b, np.uint8).reshape(n, -1)
    out = np.zeros((p.shape[1], 8), np.uint8)
    out[:, 8 - n :] = p.T
    return out.view(">u8").ravel().astype(np.uint64)


def bucket_of(h: np.ndarray, k: int) -> np.ndarray:
    """The bucket, from 0 to k - 1, of 48-bit hashes; equal hashes have one bucket, and it grows with the hash."""
    assert not len(h) or int(h.max()) < 1 << 48, "a hash of 48 bits"
    return (h >> U64(16)) * U64(k) >> U64(32)


def cuts(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    if not len(bucket):
        return []
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True)]


def table_of(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], t.type) for t in schema], schema=schema)


HASHES = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("h", pa.binary()), ("c", pa.binary())])
_SIDED = pa.schema([*HASHES, ("s", pa.binary())])
CODES = pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("codes", pa.binary())])
_PARTS = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary()), ("bytes", pa.binary()), ("uses", pa.binary()), ("rows", pa.binary()), ("firsts", pa.binary())])
_SPANS = pa.schema([("batch", pa.int64()), ("rows", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary())])


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary'}" for f in schema)


def _send_hashes(k: int):
    def run(table: pa.Table) -> pa.Table:
        b, batch = Batch(table), table.column("batch")[0].as_py()
        b.scan()
        h, c, s = b.uh[b.sent], b.uc[b.sent], b.us[b.sent]
        return table_of(_SIDED, [(x, batch, planes(h[i:j]), planes(c[i:j]), planes(s[i:j], 4)) for x, i, j in cuts(bucket_of(h, k))])

    return run


def _close(anchor: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Of different contexts, in the order of their anchors' numbers, which have a side in common with another of their anchor."""
    out = np.zeros(len(anchor), bool)
    for side in (sides >> U64(16), sides & U64(0xFFFF)):
        at = np.flatnonzero(side)
        key = anchor[at] << U64(16) | side[at]
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        out[at[order[1:][same]]] = True
        out[at[order[:-1][same]]] = True
    return out


def code(table: pa.Table, shift: int = 0) -> pa.Table:
    """A bucket's answers. Bit 0: a batch of an earlier range of ids has the context; bits 1 and 2: the anchor stands in other
    contexts too with which this one may share a window, in very many; both are 0 where no sides are sent. A batch's range is its
    number without the last ``shift`` bits."""
    table = table.sort_by("batch")
    batch = table.column("batch").to_numpy()
    hs = [unplanes(x.as_py()) for x in table.column("h")]
    h, c = np.concatenate(hs), np.concatenate([unplanes(x.as_py()) for x in table.column("c")])
    s = np.concatenate([unplanes(x.as_py(), 4) for x in table.column("s")]) if "s" in table.column_names else np.zeros(len(h), np.uint64)
    n = [len(x) for x in hs]
    del hs
    order = by_hash(h, c)  # stable, so the lowest batch comes first
    h, c = h[order], c[order]
    ranges = np.repeat(batch >> shift, n)[order]
    anchor = np.concatenate([[True], h[1:] != h[:-1]])
    fresh = anchor | np.concatenate([[True], c[1:] != c[:-1]])
    start = np.flatnonzero(anchor)
    size = np.diff(np.append(start, len(h)))
    each = np.flatnonzero(fresh & np.repeat(np.add.reduceat(fresh.astype(np.int64), start) > 1, size))
    close = np.zeros(len(h), bool)
    close[each] = _close(np.cumsum(anchor)[each].astype(np.uint64), s[order[each]])
    # a batch's sign of very many contexts keeps their sides to itself, so all of the anchor's may have one in common
    signed = np.logical_or.reduceat(c == 0, start)
    kinds = np.repeat(np.add.reduceat(close.astype(np.int64), start) + signed * (CONTEXTS + 1), size)
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))
    open_ = close[first] | np.repeat(signed, size)
    codes = np.empty(len(h), np.uint8)
    codes[order] = (ranges > ranges[first]).astype(np.uint8) | open_.astype(np.uint8) << 1 | (open_ & (kinds > CONTEXTS)).astype(np.uint8) << 2
    cut = np.cumsum([0, *n])
    bucket = table.column("bucket")[0].as_py()
    return table_of(CODES, [(int(x), bucket, codes[i:j].tobytes()) for x, i, j in zip(batch, cut[:-1], cut[1:], strict=True)])


def code_by_range(table: pa.Table) -> pa.Table:
    return code(table, SHIFT)


def answers(codes: pa.Table) -> np.ndarray:
    """A batch's answers, in the order of its hashes."""
    return np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in codes.sort_by("bucket").column("codes")]) if codes.num_rows else np.empty(0, np.uint8)


def joined(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each row, overlapping and touching ones made one."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    wide = row * (1 << 32)
    reach = np.maximum.accumulate(end + wide)
    new = np.concatenate([[True], start[1:] + wide[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return row[at], start[at], reach[np.append(at[1:], len(row)) - 1] - wide[at]


def _span_row(batch: int, row, start, end) -> tuple:
    return (batch, *[np.asarray(x, np.int32).tobytes() for x in joined(np.asarray(row, np.int64), np.asarray(start, np.int64), np.asarray(end, np.int64))])


def _send_contexts(k: int):
    """A batch with its answers: spans that are settled (bucket under 0), and the contexts that are not."""

    def run(docs: pa.Table, codes: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return table_of(_PARTS, [])
        b, batch = Batch(docs), docs.column("batch")[0].as_py()
        b.scan()
        bits = np.full(len(b.start), 6, np.uint8)
        got = answers(codes)
        assert len(got) == b.sent.sum()
        bits[b.sent & ~b.crowded] = got[~b.crowded[b.sent]]
        each = np.diff(np.append(b.start, len(b.order)))
        owner = b.ids[b.row[b.order[b.start]]]
        later = b.ids[b.row[b.order]] > np.repeat(owner, each)
        out = b.order[np.repeat(bits & 1 == 1, each) | later]
        gone = [(b.row[out], b.first[out], b.first[out] + b.count[out] - 1 + LENGTH)]
        rows = []
        open_, many = np.flatnonzero(bits == 2), np.flatnonzero(bits == 6)
        if len(open_) or len(many):
            arr = b.text.combine_chunks().cast(pa.large_string()).fill_null("")
            _, off, data = arr.buffers()
            off, data = np.frombuffer(off, np.int64)[arr.offset :], np.frombuffer(data, np.uint8)
        if len(many):
            more, spans = _by_window(k, batch, data, off, b, b.order[np.repeat(bits == 6, each) & ~later])
            rows += more
            gone.append(spans)
        if len(open_):
            src = b.order[b.start[open_]]
            length = b.count[src] - 1 + LENGTH
            begin = off[b.row[src]] + b.first[src]
            flat = b.order[np.repeat(bits == 2, each) & ~later]
            uses = np.add.reduceat((~later).astype(np.int64), b.start)[open_]
            cut = np.cumsum([0, *uses])
            for x, i, j in cuts(bucket_of(b.uh[open_], k)):
                n = length[i:j]
                at = np.repeat(begin[i:j] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                use = flat[cut[i] : cut[j]]
                rows.append((x, batch, owner[open_[i:j]].astype(np.int64).tobytes(), n.astype(np.int32).tobytes(), data[at].tobytes(), uses[i:j].astype(np.int32).tobytes(), b.row[use].astype(np.int32).tobytes(), b.first[use].astype(np.int32).tobytes()))
        rows.append((-1 - batch, batch, b"", b"", b"", *_span_row(batch, *(np.concatenate(x) for x in zip(*gone, strict=True)))[1:]))
        return table_of(_PARTS, rows)

    return run


def _by_window(k: int, batch: int, data: np.ndarray, off: np.ndarray, b: Batch, at: np.ndarray) -> tuple[list[tuple], tuple]:
    """Each distinct window of some contexts as a context of its own, with its earliest document of the batch, and the spans of later ones."""
    length = b.count[at] - 1 + LENGTH
    text = data[np.repeat(off[b.row[at]] + b.first[at] - (np.cumsum(length) - length), length) + np.arange(length.sum())]
    of = np.repeat(np.arange(len(at)), b.count[at])
    place = np.arange(len(of)) - np.repeat(np.cumsum(b.count[at]) - b.count[at], b.count[at])
    start = place + (np.cumsum(length) - length)[of]
    hashed = span_hash(prefix_hash(text), start, start + LENGTH)
    row, first, ids = b.row[at][of], b.first[at][of] + place, b.ids[b.row[at]][of]
    order = np.lexsort((ids, hashed))
    hashed, row, first, ids, start = (x[order] for x in (hashed, row, first, ids, start))
    new = np.concatenate([[True], hashed[1:] != hashed[:-1]])
    head = np.flatnonzero(new)
    later = ids > ids[head][np.cumsum(new) - 1]
    uses = np.add.reduceat((~later).astype(np.int64), head)
    cut = np.cumsum([0, *uses])
    keep_row, keep_first = row[~later].astype(np.int32), first[~later].astype(np.int32)
    rows = []
    for x, i, j in cuts(bucket_of(hashed[head] >> U64(16), k)):
        bytes_ = text[start[head[i:j]][:, None] + np.arange(LENGTH)]
        rows.append((x, batch, ids[head[i:j]].astype(np.int64).tobytes(), np.full(j - i, LENGTH, np.int32).tobytes(), bytes_.tobytes(), uses[i:j].astype(np.int32).tobytes(), keep_row[cut[i] : cut[j]].tobytes(), keep_first[cut[i] : cut[j]].tobytes()))
    return rows, (row[later], first[later], first[later] + LENGTH)


def _ranks(x: np.ndarray) -> np.ndarray:
    """Dense ranks of some keys."""
    order = np.argsort(x)
    y = x[order]
    rank = np.empty(len(x), np.uint64)
    rank[order] = np.cumsum(np.concatenate([[0], y[1:] != y[:-1]]), dtype=np.uint64) if len(x) else 0
    return rank


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """Of each place the nearest one before it with a smaller value, -1 if there is none; by jumps along what is known so far."""
    at = np.arange(-1, len(x) - 1)
    todo = np.flatnonzero(at >= 0)
    while len(todo):
        todo = todo[x[at[todo]] >= x[todo]]
        at[todo] = at[at[todo]]
        todo = todo[at[todo] >= 0]
    return at


def longest_previous(data: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For the suffixes at some starts, how long the longest match with a suffix of a smaller owner is, counted up to LENGTH bytes.

    Suffix order by prefix doubling, cut at LENGTH bytes. The best match with a smaller owner stands at the previous or at the
    next smaller position in suffix order; how long each is, is told by the ranks of 32, 16 and 8 bytes and the last eight bytes.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.zeros(len(data), np.uint64)
    for j in range(8):
        eight = eight << U64(8) | padded[j : j + len(data)]
    ranks = {8: _ranks(eight)}
    for step in (8, 16):
        rank = ranks[step]
        ranks[2 * step] = _ranks(rank << U64(32) | np.concatenate([rank[step:], np.zeros(min(step, len(rank)), np.uint64)]))
    suffix = np.argsort(ranks[32][starts] << U64(32) | ranks[32][starts + LENGTH - 32])
    place, own = starts[suffix], owner[suffix]
    best = np.zeros(len(suffix), np.int64)
    back = len(suffix) - 1 - previous_smaller(own[::-1])[::-1]  # the next smaller position, or the length
    for other in (previous_smaller(own), np.where(back < len(suffix), back, -1)):
        at = np.flatnonzero(other >= 0)
        p, q = place[at], place[other[at]]
        whole = (ranks[32][p] == ranks[32][q]) & (ranks[32][p + LENGTH - 32] == ranks[32][q + LENGTH - 32])
        length = np.where(whole, LENGTH, 0)
        rest = np.flatnonzero(~whole)
        p, q = p[rest], q[rest]
        for step in (32, 16, 8):
            same = ranks[step][np.minimum(p, len(data) - 1)] == ranks[step][np.minimum(q, len(data) - 1)]
            p, q = p + step * same, q + step * same
        differ = eight[np.minimum(p, len(data) - 1)] ^ eight[np.minimum(q, len(data) - 1)]
        bytes_ = sum(((differ >> U64(56 - 8 * j)) == 0).astype(np.int64) for j in range(8))
        length[rest] = np.minimum(p + bytes_ - place[at][rest], LENGTH - 1)
        best[at] = np.maximum(best[at], length)
    out = np.empty(len(suffix), np.int64)
    out[suffix] = best
    return out


def earlier_windows(data: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, place) of the windows whose LENGTH bytes a context of a smaller id has: those of a longest previous match so long."""
    n = lengths - LENGTH + 1
    context = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(context)) - np.repeat(np.cumsum(n) - n, n)
    found = np.flatnonzero(longest_previous(data, place + np.repeat(np.cumsum(lengths) - lengths, n), ids[context]) >= LENGTH)
    return context[found], place[found]


def _settle(table: pa.Table) -> pa.Table:
    bucket = table.column("bucket")[0].as_py()
    if bucket < 0:
        return table_of(_SPANS, [(r["batch"], r["uses"], r["rows"], r["firsts"]) for r in table.to_pylist()])
    cols = {c: [x.as_py() for x in table.column(c)] for c in table.column_names}
    ids = [np.frombuffer(x, np.int64) for x in cols["ids"]]
    lengths = np.concatenate([np.frombuffer(x, np.int32) for x in cols["lengths"]]).astype(np.int64)
    context, place = earlier_windows(np.frombuffer(b"".join(cols["bytes"]), np.uint8), lengths, np.concatenate(ids))
    out, base = [], 0
    for k, batch in enumerate(cols["batch"]):
        n = len(ids[k])
        i, j = np.searchsorted(context, [base, base + n])
        own, at = context[i:j] - base, place[i:j]
        base += n
        if not len(own):
            continue
        uses = np.frombuffer(cols["uses"][k], np.int32).astype(np.int64)
        rows, firsts = np.frombuffer(cols["rows"][k], np.int32), np.frombuffer(cols["firsts"][k], np.int32)
        times = uses[own]
        use = np.repeat((np.cumsum(uses) - uses)[own] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        start = firsts[use].astype(np.int64) + np.repeat(at, times)
        out.append(_span_row(batch, rows[use], start, start + LENGTH))
    return table_of(_SPANS, out)


def _cut(finish):
    """A batch with its spans: finish(batch, for each document its bytes and spans) gives the result's table."""

    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        b = Batch(docs)
        got = [np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in spans.column(c)]).astype(np.int64) if spans.num_rows else np.empty(0, np.int64) for c in ("rows", "starts", "ends")]
        row, start, end = joined(*got)
        cut = np.searchsorted(row, np.arange(len(b.ids) + 1))

        def each() -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
            for k, t in enumerate(b.text):
                yield (t.as_py() or "").encode(), list(zip(start[cut[k] : cut[k + 1]].tolist(), end[cut[k] : cut[k + 1]].tolist(), strict=True))

        return finish(b.table.drop_columns(["__id"]), each())

    return run


def kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def digest(docs: pa.Table, each) -> pa.Table:
    rows = [(len(d), sum(b - a for a, b in s), len(s), hashlib.sha256(kept(d, s)).hexdigest(), [x for p in s for x in p]) for d, s in each]
    n, removed, spans, sha, at = zip(*rows, strict=True) if rows else [()] * 5
    return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "spans": pa.array(at, pa.list_(pa.int64()))})


def dealt(docs: DataFrame, batch_bytes: int | None = None) -> tuple[DataFrame, int, int]:
    """docs (doc_id, text, ...) with a batch, the number of buckets and that of batches.

    Batches are ranges of doc_id, null last. An id that fills several batches has a range of its own, of which each batch
    has a part by the text's hash; so have null ids.
    """
    size = plan_bytes(docs.select("doc_id", "text"))
    batch_bytes = batch_bytes or max(BATCH_BYTES, math.isqrt(size * GROWTH))
    parts = max(2, size // batch_bytes)
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    count, named = rows.agg(F.count("*"), F.count("doc_id")).first()
    share = min(1.0, min(SAMPLE, max(100_000, SAMPLED * parts)) / max(1, named))
    known = rows.where("doc_id is not null").select("doc_id")
    sample = np.sort((known if share == 1 else known.sample(share, 7)).toArrow().column(0).to_numpy())
    cut, times = np.unique(sample[np.arange(1, parts) * len(sample) // parts], return_counts=True) if len(sample) else (np.zeros(1, np.int64), np.ones(1, np.int64))
    many = cut[times > 1][np.argsort(-times[times > 1], kind="stable")][:SPLIT_IDS]
    split = {int(c): int(t) for c, t in zip(cut, times, strict=True) if c in many}
    bounds = np.unique(np.concatenate([cut, many + 1]).astype(np.float64))
    ranged = Bucketizer(splits=[float("-inf"), *bounds.tolist(), float("inf")], inputCol="__order", outputCol="__range").transform(rows.withColumn("__order", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("inf")))))
    nulls = max(1, -(-parts * (count - named) // max(1, count)))
    pieces = F.when(F.col("doc_id").isNull(), F.lit(nulls))
    if split:
        pieces = pieces.otherwise(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in split.items() for x in p]), F.col("doc_id")), F.lit(1)))
    own = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(F.col("__range")).cast("long")
    batch = F.shiftleft(own, SHIFT) + F.coalesce(F.pmod(F.xxhash64("text"), pieces.cast("long")), F.lit(0))
    return ranged.withColumn("batch", batch).drop("__order", "__range"), max(256, 2 * size // batch_bytes), parts


def _plan(docs: DataFrame, batch_bytes: int | None, finish, schema: str) -> DataFrame:
    rows, k, _ = dealt(docs, batch_bytes)
    by_batch = rows.groupBy("batch")
    hashes = by_batch.applyInArrow(trimmed(_send_hashes(k)), ddl(_SIDED))
    codes = hashes.groupBy("bucket").applyInArrow(trimmed(code_by_range), ddl(CODES))
    parts = by_batch.cogroup(codes.groupBy("batch")).applyInArrow(trimmed(_send_contexts(k)), ddl(_PARTS))
    spans = parts.groupBy("bucket").applyInArrow(trimmed(_settle), ddl(_SPANS))
    return by_batch.cogroup(spans.groupBy("batch")).applyInArrow(trimmed(_cut(finish)), schema)


def removed_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batch_bytes: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and spans: starts and ends of the removed runs in turn."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _plan(slim, batch_bytes, digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")


def cut_documents(docs: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """docs with the text that is left, and its length in n_chars; a text that loses all goes. Halves of a character at a cut go too."""
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))

    def finish(table: pa.Table, each) -> pa.Table:
        texts, keep, changed = [], [], []
        for (data, spans), old in zip(each, table.column("text"), strict=True):
            new = kept(data, spans).decode("utf-8", "ignore") if spans else old.as_py()
            texts.append(new)
            keep.append(not spans or bool(new.strip()))
            changed.append(bool(spans))
        return pa.table({"row": table.column("row"), "left": pa.array(texts, pa.string()), "changed": pa.array(changed, pa.bool_())}).filter(pa.array(keep, pa.bool_()))

    cut = _plan(rows, batch_bytes, finish, f"row {rows.schema['row'].dataType.simpleString()}, left string, changed boolean")
    new = {"text": F.col("left"), "n_chars": F.when(F.col("changed"), F.length("left")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return cut.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
