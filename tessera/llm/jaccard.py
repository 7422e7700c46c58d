"""N-gram Jaccard join by universe partition and the pigeonhole principle.

A document is its set of distinct five-word shingles, each a 52-bit hash. Sets fall into size bands wide enough that linked
sets lie in one band or two adjacent ones. If two sets link, they differ in at most H = (sum of sizes) / 9 tokens. A band's
universe of tokens is hashed into m segments. A set gives each segment j a number v_j of differences it wants to exclude,
with a sum over H: then some segment differs by less than its v_j. v = 1 asks for equal segment subsets; v = 2 for
subsets one token apart, found by one-deletion neighbourhoods; v = 0 asks for nothing. Allocation is by cost: empty
segments get 0, segments of frequent tokens come last, small ones late; in bands of small sets
neighbourhoods make up for missing segments. Tokens are rare or frequent at some level (estimated on a bounded sample), and the
universe is partitioned by level first, so that a passage in a third of all documents spoils no segment of rare tokens. Where
a set must still ask for a segment of frequent tokens, that segment is told apart by ranges of the sets' numbers of rare tokens,
which linked sets have nearly alike. A set whose tokens fall into too few segments is run again with another seed.

Signatures travel as packed arrays per batch and bucket; of many sets of a batch with one signature the smallest goes for all.
Equal sets are one class, for which the smallest id stands. Groups of equal signatures are not expanded into pairs: their members are
verified exactly against a few leaders, components are formed of the labels that links join, and so on in turns as long as that finds
much. Sets of groups that are still in different components then meet by the tokens of their prefixes, rarest first: linked sets
share one, and members of a crowd that have only its passage in common don't. Of tokens that the same sets have, one goes for all, so that
a pair doesn't come up once for each token it shares. In all turns, pairs that differ too much by size or by their parity bitmaps are left out
before, first by bitmaps of one width and then by sketches, bitmaps as wide as the set asks for; no linked pair differs so. So no link that
decides a component is lost. Staged tables are deleted when their last reader is done.

Defined results: null and word-less texts have no shingles and stand alone; a text of one to four words is one shingle;
rows with one doc_id are one node; a row with null doc_id links with nothing and has a null component; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, U64, byte_table, drop_table, find_words, gram_hash, mix64, plan_bytes, prefix_hash, regrouped, span_hash, stage_table, text_slices, trim, trimmed, unused

SHINGLE = 5
#: Similarity of at least 4/5, in exact integers: 5 * intersection >= 4 * union.
NUM, DEN = 4, 5
SPACE = byte_table((0x20, 0x20), (0x09, 0x0D))
SMALL = 64
TOKEN_BITS = 52
FLUSH = 600_000
#: Sets of one batch with one signature from which on the batch sends the smallest for all; the others go another way.
CROWD = 64
#: Sample for the cost estimate: at most about so many documents; a token is frequent from this many of them on.
SAMPLE, FREQUENT = 10_000, 12
#: How many times as frequent the tokens of the next level are. Each level has segments of its own.
LEVEL = 4
#: Bytes of token sets of an Arrow batch of pairs.
BATCH_BYTES = 16 << 20
#: Words of the parity bitmap of a set: the differing bits of two bitmaps are at most the sets' differing tokens.
BITS = [f"b{k}" for k in range(8)]
#: Bits of a sketch for each token, at least; a sketch is a parity bitmap, a power of two wide.
SKETCH = 2
#: Places of the bitmap of the documents whose sets are wanted: 8 MB at most. Others at their places come along, which changes nothing.
PLACES = 1 << 26
#: Members of a group that lead in a turn. Turns go on until one finds under one link for YIELD members; then all that is
#: still apart is tested.
LEADERS, YIELD = 4, 100
#: Tokens before one that come along with it, to tell whether two sets have met before.
BEFORE = 8
_MASK = U64((1 << TOKEN_BITS) - 1)


@lru_cache(1)
def bands(top: int = 1 << 40) -> np.ndarray:
    """First size of each band: a set links with none smaller than four fifths of it, so within a band or its neighbour."""
    out = [1]
    while out[-1] < top:
        out.append(out[-1] * DEN // NUM + 1)
    return np.array(out)


@lru_cache(1)
def segments() -> np.ndarray:
    """Segments of each band."""
    last = bands()[1:] - 1
    need = 2 * last // 9 + 1
    return np.where(last < SMALL, np.where(need == 1, 1, 2 * need + 4), need + -(-need // 10) + 8)


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, text of each token, set sizes), tokens ascending within a text. At most 4096 texts at a time."""
    low = LOWER[data]
    starts, ends, first = find_words(low, offs, ~SPACE)
    words = span_hash(prefix_hash(low), starts, ends)
    count = np.diff(first)
    grams = gram_hash(words, SHINGLE)
    n = np.maximum(count - SHINGLE + 1, 0)
    text = np.repeat(np.arange(len(count)), n)
    at = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][text]
    tokens = [grams[at]]
    texts = [text]
    for length in range(1, SHINGLE):
        short = np.flatnonzero(count == length)
        if len(short):
            tokens.append(mix64(gram_hash(words, length)[first[:-1][short]] + U64(length)))
            texts.append(short)
    keys = np.concatenate(texts).astype(np.uint64) << U64(TOKEN_BITS) | np.concatenate(tokens) >> U64(64 - TOKEN_BITS)
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    text = (keys >> U64(TOKEN_BITS)).astype(np.int64)
    return keys & _MASK, text, np.bincount(text, minlength=len(count))


def bitmaps(hashed: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Parity bitmap of each set, one row a word."""
    width = 64 * len(BITS)
    odd = np.bincount(text * width + (hashed >> U64(20) & U64(width - 1)).astype(np.int64), minlength=n * width) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, width), axis=1).view(np.uint64).T.copy()


def slices(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b, data, offs in text_slices(column):
        for k in range(0, b - a, 4096):
            e = min(b - a, k + 4096)
            yield a + k, a + e, data[offs[k] : offs[e]], offs[k : e + 1] - offs[k]


def signatures(tokens: np.ndarray, text: np.ndarray, size: np.ndarray, upper: bool, seed: int, common: np.ndarray, probing: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, their texts, texts that could not allocate). Bit 0: asks; bit 1: it is of the band below.

    upper: in the scheme of the next band, where a set only asks; else of its own, where it also answers.
    """
    band = np.searchsorted(bands(), np.maximum(size, 1), "right") - 1
    scheme = band + upper
    if upper:
        partner = np.minimum(bands()[scheme + 1] - 1, size * DEN // NUM)
        need = np.where(partner >= bands()[scheme], (size + partner) // 9 + 1, 0)
    else:
        need = 2 * size // 9 + 1
    m = segments()[scheme]
    mixed = mix64(tokens + U64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    level = levels_of(tokens, common)
    seg = ((mixed >> U64(32)) * m[text].astype(np.uint64) >> U64(32)) + level * m[text].astype(np.uint64)
    # by text and segment; one very long text has more tokens than fit beside them in 64 bits
    idx = np.lexsort((seg, text)) if len(text) >= 1 << 24 else (np.sort(text.astype(np.uint64) << U64(52) | seg << U64(24) | np.arange(len(text), dtype=np.uint64)) & U64(0xFFFFFF)).astype(np.int64)
    group = text[idx].astype(np.uint64) << U64(40) | seg[idx]
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    value = mix64(mixed)[idx]
    total = np.add.reduceat(value, start)
    n = np.diff(np.append(start, len(idx)))
    owner, gseg = text[idx[start]], seg[idx[start]]
    # cost: frequent tokens, then few tokens
    glevel = level[idx[start]].astype(np.int64)
    cost = level[idx[start]] << U64(7) | (U64(100) - np.minimum(n, 100).astype(np.uint64))
    by = owner.astype(np.uint64) << U64(44) | cost << U64(32) | np.arange(len(owner), dtype=np.uint64)
    by.sort()
    ranked = (by & U64(0xFFFFFFFF)).astype(np.int64)
    have = np.bincount(owner, minlength=len(size))
    rank = np.empty(len(owner), np.int64)
    rank[ranked] = np.arange(len(owner)) - (np.cumsum(have) - have)[owner[ranked]]
    v = (rank < need[owner]).astype(np.int64)
    lacking = need - have
    small = bands()[scheme + 1] - 1 < SMALL
    failed = np.zeros(len(size), bool)
    for t in np.flatnonzero((lacking > 0) & (size > 0)):
        mine = np.flatnonzero(owner == t)
        wide = mine[n[mine] > 1]
        if small[t] and len(wide) >= lacking[t]:
            v[wide[np.lexsort((n[wide], glevel[wide]))][: lacking[t]]] = 2
        else:
            v[mine] = 0
            failed[t] = True
    v[~probing[owner]] = 0
    # linked sets differ by less than need in their numbers of tokens that aren't frequent, so segments of frequent ones are
    # told apart by that number's range: a set answers in its own and asks in all that a partner's may be in
    rare = np.bincount(text[level == 0], minlength=len(size))
    width = (2 * (bands()[scheme + 1] - 1) // 9 + 1)[owner]
    own_range = np.where(glevel > 0, rare[owner] // width + 1, 0)
    low = np.where(glevel > 0, np.maximum(rare[owner] - need[owner] + 1, 0) // width + 1, 0)
    high = np.where(glevel > 0, (rare[owner] + need[owner] - 1) // width + 1, 0)
    place = scheme[owner].astype(np.uint64) << U64(32) | gseg
    flag = U64(2 if upper else 0)
    sig, own = [], []

    def put(at: np.ndarray, sums: np.ndarray, ranges: np.ndarray, asks: np.ndarray, mark: U64) -> None:
        sig.append(mix64(sums ^ mix64(place[at] | ranges.astype(np.uint64) << U64(44))) & ~U64(7) | asks.astype(np.uint64) | mark)
        own.append(owner[at])

    def send(at: np.ndarray, sums: np.ndarray, asks: np.ndarray) -> None:
        put(at, sums, own_range[at], asks, flag)
        for k in range(int((high - low)[at].max(initial=0)) + 1):
            ranges = low[at] + k
            use = asks & (ranges <= high[at]) & (ranges != own_range[at])
            put(at[use], sums[use], ranges[use], asks[use], U64(2))

    every = np.flatnonzero(v > 0) if upper else np.arange(len(owner))
    send(every, total[every], v[every] > 0)
    part = np.repeat(np.arange(len(start)), n)
    near = small[owner[part]] & (n[part] > 1)
    if upper:
        near &= v[part] == 2
    if near.any():
        p = part[near]
        send(p, total[p] - value[near], v[p] == 2)
    return np.concatenate(sig), np.concatenate(own), failed & probing


def _crowds(k: int, ids: np.ndarray, sig: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """Signatures that CROWD or more sets have are left to the smallest of these (bit 2); rows of kind 2 hold all members.

    Those rows go to any bucket and only pass through it, so a bucket gets one entry of a crowd from each batch.
    """
    key = sig >> U64(3)
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    start = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    n = np.diff(np.append(start, len(sig)))
    rows, drop, sigs, owns = [], np.zeros(len(sig), bool), [], []
    for g in np.flatnonzero(n >= CROWD):
        at = order[start[g] : start[g] + n[g]]
        members = np.unique(own[at])
        if len(members) < CROWD:
            continue
        name = mix64(sorted_[start[g] : start[g] + 1])
        asks, below = np.bitwise_or.reduce(sig[at] & U64(1)), np.bitwise_and.reduce(sig[at] & U64(2))
        drop[at] = True
        sigs.append(sorted_[start[g]] << U64(3) | U64(4) | below | asks)
        owns.append(members[ids[members].argmin()])
        rows.append((int((int(name[0]) + int(ids[members[0]])) % k), 2, ids[members].tobytes(), b"", name.tobytes()))
    if not rows:
        return sig, own, rows
    sig, own = np.concatenate([sig[~drop], np.array(sigs, np.uint64)]), np.concatenate([own[~drop], np.array(owns, np.int64)])
    order = np.argsort(own, kind="stable")
    return sig[order], own[order], rows


def _pack(k: int, ids: np.ndarray, sig: np.ndarray, own: np.ndarray):
    """Rows (bucket, kind 0, ids, counts, signatures): the signatures of a bucket, and runs of the documents they are of."""
    sig, own, rows = _crowds(k, ids, sig, own)
    bucket = (sig >> U64(32)) * U64(k) >> U64(32)
    order = np.argsort(bucket.astype(np.uint16) if k <= 65536 else bucket, kind="stable")
    bucket, sig, own = bucket[order], sig[order], own[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for a, b in zip(cut, np.append(cut[1:], len(sig)), strict=True):
        o = own[a:b]
        run = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
        rows.append((int(bucket[a]), 0, ids[o[run]].tobytes(), np.diff(np.append(run, len(o))).astype(np.uint32).tobytes(), sig[a:b].tobytes()))
    return rows


_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("sigs", pa.binary())])
PACKED = "bucket int, kind int, ids binary, counts binary, sigs binary"
FOUND = "kind int, gid long, doc_id long, n long, s1 long, s2 long, " + ", ".join(f"{b} long" for b in BITS)


def _to_batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)


def partitions(seed: int, common):
    """Signatures by universe partition, in the schemes of a set's own band and the next."""

    def make(tokens: np.ndarray, text: np.ndarray, size: np.ndarray, probing: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for upper in (False, True):
            yield signatures(tokens, text, size, upper, seed, common.value, probing)

    return make


def signed(k: int, seed: int, make, again=()):
    """mapInArrow over (doc_id, text): packed signatures of a batch, and its documents' sizes and set hashes (kind 1).

    make(tokens, texts, sizes, probing) yields (signatures, their texts, texts that could not be signed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in regrouped(batches):
            if not b.num_rows:
                continue
            b = b.take(pa.array(np.argsort(b.column(0).to_numpy(zero_copy_only=False), kind="stable")))  # of equal sets the least id signs
            ids = np.asarray(b.column(0).to_numpy(zero_copy_only=False), np.int64)
            sigs, owns, held, seen = [], [], 0, {}
            for first, end, data, offs in slices(b.column(1)):
                tokens, text, size = shingle_sets(data, offs)
                mine = ids[first:end]
                hashed = mix64(tokens)
                edge = (np.cumsum(size) - size)[size > 0]
                s1, s2 = np.zeros((2, len(size)), np.uint64)
                if len(edge):
                    s1[size > 0] = np.add.reduceat(hashed, edge)
                    s2[size > 0] = np.add.reduceat(mix64(hashed + U64(1)), edge)
                # of equal sets in a batch one signs for all
                probing = np.ones(len(size), bool)
                for t in range(len(size)):
                    key = (int(s1[t]), int(s2[t]))
                    if seen.setdefault(key, t + first) != t + first:
                        probing[t] = False
                if len(again):
                    probing &= np.isin(mine, again)
                fail = np.zeros(len(size), bool)
                if len(tokens):
                    live = np.isin(text, np.flatnonzero([seen[int(x), int(y)] == t + first for t, (x, y) in enumerate(zip(s1, s2, strict=True))]))
                    lt, lx = tokens[live], text[live]
                    for sig, own, bad in make(lt, lx, np.bincount(lx, minlength=len(size)), probing) if len(lt) else ():
                        sigs.append(sig)
                        owns.append(own + first)
                        held += len(sig)
                        fail |= bad
                info = (int(mine[0]) * 7919 + seed & 0x7FFFFFFF) % k, 1, mine.tobytes(), np.where(fail, -1 - size, size).astype(np.int64).tobytes(), s1.tobytes() + s2.tobytes() + bitmaps(hashed, text, len(size)).tobytes()
                yield _to_batch([info])
                if held > FLUSH:
                    yield _to_batch(_pack(k, ids, np.concatenate(sigs), np.concatenate(owns)))
                    sigs, owns, held = [], [], 0
            if held:
                yield _to_batch(_pack(k, ids, np.concatenate(sigs), np.concatenate(owns)))

    return run


def matched(table: pa.Table) -> pa.Table:
    """One bucket: kind 0 rows (gid, doc_id) of the groups of signatures that ask; kind 1 rows of the documents."""
    sigs, ids, info, crowds = [], [], [], []
    for kind, i, c, s in zip(*[table.column(x).to_pylist() for x in ("kind", "ids", "counts", "sigs")], strict=True):
        doc = np.frombuffer(i, np.int64)
        if kind == 2:
            crowds.append((np.full(len(doc), np.frombuffer(s, np.int64)[0]), doc))
        elif kind:
            h = np.frombuffer(s, np.int64)
            info.append((doc, np.frombuffer(c, np.int64), *h.reshape(-1, len(doc))))
        else:
            sigs.append(np.frombuffer(s, np.uint64))
            ids.append(np.repeat(doc, np.frombuffer(c, np.uint32)))
    gid = doc = np.empty(0, np.int64)
    if sigs:
        sig, own = np.concatenate(sigs), np.concatenate(ids)
        del sigs, ids
        order = np.argsort(sig)
        sig, own = sig[order], own[order]
        key = sig >> U64(3)
        same = key[1:] == key[:-1]
        many = np.concatenate([same, [False]]) | np.concatenate([[False], same]) | (sig & U64(4) > 0)
        sig, own, key = sig[many], own[many], key[many]
        if len(key):
            order = np.lexsort((own, key))
            sig, own, key = sig[order], own[order], key[order]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            asks = np.bitwise_or.reduceat(sig & U64(1), start) > 0
            answers = np.bitwise_and.reduceat(sig & U64(2), start) == 0
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
            members = np.add.reduceat(fresh.astype(np.int64), start)
            names = np.add.reduceat(np.where(fresh, mix64(own.astype(np.uint64)), U64(0)), start)
            crowd = np.bitwise_or.reduceat(sig & U64(4), start) > 0
            names = np.where(crowd, mix64(key[start]), names)
            good = asks & answers & (crowd | (members > 1))
            first = np.zeros(len(start), bool)
            first[np.unique(np.where(good, names, U64(0)), return_index=True)[1]] = True
            good &= first  # groups of the same members count once
            span = np.diff(np.append(start, len(key)))
            use = np.repeat(good, span) & fresh
            gid, doc = np.repeat(names, span)[use].view(np.int64), own[use]
    parts = [(np.zeros(len(d), np.int32), g, d, *[np.zeros(len(d), np.int64)] * (3 + len(BITS))) for g, d in [(gid, doc), *crowds]]
    parts += [(np.ones(len(x[0]), np.int32), np.zeros(len(x[0]), np.int64), *x) for x in info]
    return pa.table([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["kind", "gid", "doc_id", "n", "s1", "s2", *BITS])


def levels_of(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The level of each token: 0 for those that aren't frequent."""
    if not common.size:
        return np.zeros(len(tokens), np.uint64)
    known, level = common
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    return np.where(known[at] == tokens, level[at], U64(0))


def frequent_tokens(rows: DataFrame, count: int) -> np.ndarray:
    """Tokens in FREQUENT or more of about SAMPLE sampled documents, ascending, and in a second row their levels, one more with
    each factor of LEVEL; only a cost estimate, no result depends on it."""

    def run(batches):
        for b in batches:
            for _, _, data, offs in slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(data, offs)[0].view(np.int64))], ["token"])

    part = max(1, count // SAMPLE)
    tokens = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(part)) == 0).mapInArrow(run, "token long")
    top = tokens.groupBy("token").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "token").limit(200_000)
    found = sorted((r[0], r[1]) for r in top.collect())  # at most 200,000
    level = [1 + int(math.log(n / FREQUENT, LEVEL)) for _, n in found]
    return np.array([[t for t, _ in found], level], np.uint64)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set, in words. One of half as many words is the exclusive or of its halves."""
    width = 64 << max(0, (SKETCH * len(tokens) - 1).bit_length() - 6)
    return np.packbits((np.bincount((tokens & U64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).view(np.uint64)


def differing(p: np.ndarray, q: np.ndarray) -> int:
    """Differing bits of two sketches, which are at most the differing tokens of the sets."""
    if len(p) < len(q):
        p, q = q, p
    return int(np.bitwise_count(np.bitwise_xor.reduce(p.reshape(-1, len(q)), 0) ^ q).sum())


def _wanted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is in ids, and few others: a bitmap of ids goes to the rows, whatever their number, and no text is shuffled."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(PLACES))
    maps = ids.groupBy(F.bitmap_bucket_number(place).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("__map"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("__map"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    one = F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1
    return rows.join(F.broadcast(maps), F.bitmap_bucket_number(place) == F.col("__bucket")).where(one).select(*rows.columns)  # PLACES / 8 bytes at most


def _sets(rows: DataFrame) -> DataFrame:
    """doc_id, the packed tokens of its text and their sketch."""

    def run(batches):
        for b in batches:
            for first, end, data, offs in slices(b.column(1)):
                tokens, _, size = shingle_sets(data, offs)
                cut = np.concatenate([[0], np.cumsum(size)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.array(size.astype(np.int64)), *[pa.array([f(tokens[x:y]).tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for f in (lambda t: t, sketch)]], ["doc_id", "n", "tokens", "sketch"])

    return rows.mapInArrow(run, "doc_id long, n long, tokens binary, sketch binary")


@contextmanager
def _arrow_bytes(spark: SparkSession, n: int):
    """Bytes of an Arrow batch, for what runs within."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of pairs (a, b, la, lb) whose sets link, by exact intersection; most that don't are told by their sketches."""

    def near(p: np.ndarray, q: np.ndarray, na: int, nb: int) -> bool:
        return (num + den) * differing(p, q) <= (den - num) * (na + nb)

    def linked(p: np.ndarray, q: np.ndarray, na: int, nb: int) -> bool:
        both = len(np.intersect1d(p, q, assume_unique=True))
        return both > 0 and den * both >= num * (na + nb - both)

    def kept(links):
        def run(batches):
            for b in batches:
                use = [links(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), na.as_py(), nb.as_py()) for na, nb, p, q in zip(*b.columns[4:], strict=True)]
                yield b.filter(pa.array(use, pa.bool_())).select([0, 1, 2, 3])
                del b
                trim()

        return run

    for column, links, name in (("sketch", near, "near"), ("tokens", linked, "links")):
        left, right = (sets.select(F.col("doc_id").alias(k), F.col("n").alias(n), F.col(column).alias(t)) for k, n, t in (("a", "na", "p"), ("b", "nb", "q")))
        with _arrow_bytes(pairs.sparkSession, BATCH_BYTES):
            found = stage_table(pairs.join(left, "a").join(right, "b").select("a", "b", "la", "lb", "na", "nb", "p", "q").mapInArrow(kept(links), "a long, b long, la long, lb long"), name)
        drop_table(pairs)
        pairs = found
    return pairs


def components(edges: DataFrame) -> DataFrame:
    """doc_id and the smallest id reachable, for all ids in edges (a, b): smallest labels spread, then skip along labels."""
    many = 2 * edges.count()
    both = stage_table(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges", many)
    labels = stage_table(both.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels", many)
    while True:
        spread = both.join(labels, both["b"] == labels["doc_id"]).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(spread, labels["doc_id"] == spread["a"]).select("doc_id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("doc_id").alias("d"), F.col("label").alias("jump"))
        new = stage_table(new.join(up, F.col("label") == F.col("d"), "left").select("doc_id", F.least("label", "jump").alias("label"), (F.least("label", "jump") < F.col("old")).alias("moved")), "labels", many)
        drop_table(labels)
        labels = new.select("doc_id", "label")
        if not new.where("moved").limit(1).count():
            drop_table(both)
            return labels


def _plausible(num: int, den: int) -> Column:
    """Whether the sets a and b may link: other sizes, or more differing bits than linked sets can have, rule it out."""
    differ = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}_"))) for b in BITS), F.lit(0))
    return (den * F.least("na", "nb") >= num * F.greatest("na", "nb")) & ((num + den) * differ <= (den - num) * (F.col("na") + F.col("nb")))


def _prefixes(num: int, den: int, common):
    """mapInArrow over (doc_id, n, label, BITS, tokens): the last column becomes the first tokens of the set, the rarest first.

    A linked set has at least num / den of a set's tokens, so of n - ceil(n * num / den) + 1 tokens, in an order that all sets
    share, linked sets have one in common.
    """

    def run(batches):
        for b in batches:
            out = []
            for x in b.column(b.num_columns - 1):
                tokens = np.frombuffer(x.as_buffer(), np.uint64)
                keep = len(tokens) - -(-len(tokens) * num // den) + 1
                # a bijection of the tokens' bits, so that the order has no ties
                rank = levels_of(tokens, common.value) << U64(TOKEN_BITS) | tokens * U64(0x9E3779B97F4A7C15) & _MASK
                out.append(tokens[np.argpartition(rank, keep - 1)[:keep]] if keep < len(tokens) else tokens)
            cut = np.concatenate([[0], np.cumsum([len(t) for t in out])]).astype(np.int32)
            flat = np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(cut), pa.array(flat))], [*b.schema.names[:-1], "prefix"])
            trim()

    return run


def _spared(tokens: DataFrame, apart: str = "doc_id") -> DataFrame:
    """The rows of tokens (doc_id, token) without tokens whose sets have one value of apart, and with one for all tokens that the same sets have."""
    # sums of 36 bits, which don't overflow under 2^27 sets; with ends and number they tell lists of sets apart
    sums = [F.sum(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(k)), 28)).alias(f"s{k}") for k in range(2)]
    lists = tokens.groupBy("token").agg(F.count("*").alias("sets"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min(apart).alias("least"), F.max(apart).alias("most"), *sums).where("least <> most")
    one = stage_table(lists.groupBy("sets", "low", "high", "s0", "s1").agg(F.min("token").alias("token")).select("token"), "tokens")
    met = stage_table(tokens.join(one, "token", "left_semi").select("doc_id", "token").distinct(), "met")
    drop_table(one)
    return met


def _with_before(met: DataFrame) -> DataFrame:
    """The rows of met (doc_id, token), each with the BEFORE tokens of its set that come before it."""
    listed = met.groupBy("doc_id").agg(F.array_sort(F.collect_set("token")).alias("all")).select("doc_id", "all", F.posexplode("all").alias("at", "token"))
    return listed.select("doc_id", "token", F.slice("all", F.greatest(F.col("at") - BEFORE, F.lit(0)) + 1, F.least("at", F.lit(BEFORE))).alias("before"))


def _meeting(met: DataFrame, left: DataFrame, right: DataFrame, apart: Column) -> DataFrame:
    """Pairs of a row of left (a, ...) and one of right (b, ...) that have a token of met, with those before it, in common and are apart, a < b.

    A pair comes up at the first token that both have, as no set has an earlier one that the other has too. At later ones it doesn't
    if a token just before is in both: near copies, which have most tokens in common, come up a few times and not once for each.
    """
    a, b = (met.join(side.withColumnRenamed(key, "doc_id"), "doc_id").withColumnsRenamed({"doc_id": key, "before": before}) for side, key, before in ((left, "a", "before_"), (right, "b", "before")))
    return b.join(a, "token").where((F.col("a") < F.col("b")) & apart & ~F.arrays_overlap("before", "before_"))


def _in_order(pairs: DataFrame) -> DataFrame:
    """Each pair once, the smaller id first."""
    turned = F.col("a") > F.col("b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, F.col("lb")).otherwise(F.col("la")).alias("la"), F.when(turned, F.col("la")).otherwise(F.col("lb")).alias("lb")).distinct()


def linked_labels(members: DataFrame, sets: DataFrame, num: int, den: int, common) -> DataFrame:
    """doc_id and label of the documents that are in a component with another; members: gid, doc_id, n, BITS, label."""
    labels, turn, size = None, 0, members.count()
    member = [F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"), *BITS]
    partner = [F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"), *[F.col(b).alias(f"{b}_") for b in BITS]]
    apart = (F.col("la") != F.col("lb")) & _plausible(num, den)
    last = False
    while True:
        if not last:
            # the first members in this turn's orders lead: of clusters in a group, large ones are met first
            by = [F.max_by(F.struct(*partner), F.xxhash64("doc_id", F.lit(turn * LEADERS + k))) for k in range(LEADERS)]
            led = members.groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.array_distinct(F.array(*by)).alias("leaders")).where("low <> high")
            right = stage_table(led.select("gid", F.inline("leaders")), "leaders", size * LEADERS)
            pairs = members.select("gid", *member).join(right, "gid").where(apart)
        else:
            # all that is still apart in some group meets by prefixes, where what a crowd has in common stands last
            mixed = members.groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("gid")
            open_ = members.join(stage_table(mixed, "mixed", size), "gid", "left_semi").drop("gid").distinct()
            kinds = "doc_id long, n long, label long, " + ", ".join(f"{b} long" for b in BITS) + ", prefix array<long>"
            with _arrow_bytes(members.sparkSession, BATCH_BYTES):
                right = stage_table(open_.join(sets.select("doc_id", "tokens"), "doc_id").select("doc_id", "n", "label", *BITS, "tokens").mapInArrow(_prefixes(num, den, common), kinds), "prefixes")
            met = _spared(right.select("doc_id", "label", F.explode("prefix").alias("token")), "label")
            spared, met = met, stage_table(_with_before(met), "before")
            drop_table(spared)
            pairs = _meeting(met, right.select(*partner), right.select(*member), apart)
        pairs = stage_table(_in_order(pairs), "pairs")
        drop_table(right)
        links = _verify(pairs, sets, num, den)
        found = links.count()
        if found:
            moves = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")))
            to = moves.select(F.col("doc_id").alias("__from"), F.col("label").alias("__to"))
            moved = lambda df: df.join(to, F.col("label") == F.col("__from"), "left").withColumn("label", F.coalesce("__to", "label")).drop("__from", "__to")
            # whose label was its own until now has no row yet
            labels = moves if labels is None else stage_table(moved(labels).unionByName(moves.join(labels, "doc_id", "left_anti")), "labels", size)
            if not last:
                old, members = members, stage_table(moved(members).select("gid", "doc_id", "n", *BITS, "label"), "members")
                drop_table(old)
        drop_table(links)
        if last:
            drop_table(met)
            return labels
        last, turn = found * YIELD <= size, turn + 1


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = rows.where(F.col("doc_id").isNotNull())
    k = max(256, plan_bytes(rows) // bucket_bytes)
    common = spark.sparkContext.broadcast(frequent_tokens(named, named.count()))  # at most 200,000 tokens
    again, seed, found = np.empty(0, np.int64), 0, None
    while True:
        packed = named.mapInArrow(signed(k, seed, partitions(seed, common), again), PACKED)
        now = stage_table(packed.groupBy("bucket").applyInArrow(trimmed(matched), FOUND), "groups")
        found = now if found is None else found.unionByName(now.where("kind = 0"))
        # hardly ever: sets whose tokens fell into too few segments ask again under another seed
        again = np.array([r[0] for r in now.where("kind = 1 and n < 0").select("doc_id").collect()], np.int64)
        if not len(again):
            break
        seed += 1
    return resolved(rows, found, NUM, DEN, common)


def resolved(rows: DataFrame, found: DataFrame, num: int, den: int, common) -> DataFrame:
    """doc_id, n_shingles and component_id of rows (doc_id, text) from the groups found, whose sets link at num / den.

    common: frequent_tokens(), broadcast; with them it takes less time."""
    named = rows.where(F.col("doc_id").isNotNull())
    info = found.where("kind = 1").select("doc_id", F.when(F.col("n") < 0, -1 - F.col("n")).otherwise(F.col("n")).alias("n"), "s1", "s2", *BITS)
    full = info.where("n > 0")
    # equal sets are a class, named by the least id; it signs and so is in all the groups that the others are in
    copied = full.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    copied = stage_table(copied, "copied")  # a table, so that a join with a crowded key can be split
    of = stage_table(full.join(copied, ["n", "s1", "s2"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"), *BITS), "classes")
    reps = of.where("doc_id = rep").select("doc_id", "n", *BITS)
    members = found.where("kind = 0").select("gid", "doc_id").join(reps, "doc_id").distinct()
    members = stage_table(members.select("gid", "doc_id", "n", *BITS, F.col("doc_id").alias("label")), "members")
    several = members.groupBy("gid").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high").select("gid")
    ids = members.join(stage_table(several, "several", members.count()), "gid", "left_semi").select("doc_id").distinct()
    sets = stage_table(_sets(_wanted(named, ids)), "sets")
    labels = linked_labels(members, sets, num, den, common)
    drop_table(sets)
    # rows of one id with different texts are one node: their classes are one component
    twice = stage_table(of.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("doc_id", "low"), "twice")
    if twice.limit(1).count():
        more = of.join(twice, "doc_id").select(F.col("rep").alias("a"), F.col("low").alias("b"))
        labels = components(more if labels is None else more.union(labels.select("doc_id", "label")))
    to = of.select("doc_id", "rep")
    if labels is not None:
        to = to.join(labels.select(F.col("doc_id").alias("rep"), "label"), "rep", "left").withColumn("rep", F.coalesce("label", "rep"))
    to = stage_table(to.where("doc_id <> rep").groupBy("doc_id").agg(F.min("rep").alias("rep")), "components")
    named_out = info.join(to, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("component_id"))
    nameless = _sets(rows.where(F.col("doc_id").isNull())).select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return named_out.unionByName(nameless)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose id is their component's smallest."""
    found = jaccard_components(docs, doc_id, text).where("component_id < doc_id").select("doc_id").distinct().withColumnRenamed("doc_id", gone := unused("gone", docs))
    return docs.join(found, docs[doc_id].cast("long") == F.col(gone), "left_anti")
