"""Token counts of byte-level byte-pair encodings by heap-and-linked-list merging.

A text is split as the tokenizer's pre-tokenizer splits it; each piece starts as one symbol a byte in a linked list, and the
adjacent pair of the lowest rank, the leftmost of equal ones, is popped from a heap and merged until none is left. A piece's
count is its bytes less its merges; no identifiers are made. Counts of pieces are kept in a bounded store per worker.

The strings of added special tokens count one token each, as the library counts them by default.

Defined results: null and empty text have no tokens; repeated rows repeat their result; whole texts are counted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-tokenizer's pattern (a fixed value of this kind of tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces kept at a time, twice over.
KEPT = 100_000


def byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes for themselves, the others in turn from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def load_merges(path: str) -> tuple[list[tuple[bytes, bytes]], list[str]]:
    """Merges by rank, as bytes, and the special strings of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    letters = byte_of()
    raw = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
    return [(bytes(map(letters.__getitem__, a)), bytes(map(letters.__getitem__, b))) for a, b in raw], [t["content"] for t in data["added_tokens"]]


class _Store(dict):
    """A dict that makes missing values and forgets all but the last KEPT or two times as many."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        if len(self) >= KEPT:
            self.old = dict(self)
            self.clear()
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        self[key] = got
        return got


class Counter:
    def __init__(self, merges: list[tuple[bytes, bytes]], special: list[str]):
        import regex

        number = {bytes([b]): b for b in range(256)}
        self.right: list[dict[int, int]] = [{} for _ in range(256)]  # for each left symbol, ranks by the right one
        self.result: list[int] = []
        for rank, (a, b) in enumerate(merges):
            self.right[number[a]][number[b]] = rank
            made = number.setdefault(a + b, len(number))
            if made == len(self.right):
                self.right.append({})
            self.result.append(made)
        self.special = special
        self.cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pieces = regex.compile(PATTERN)
        # a break before a run of blanks and line ends is one of the pattern too, unless other white space is near
        self.chunk = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
        self.other = re.compile(r"[^\S \n]")
        self.of_piece = _Store(self.merge)
        self.of_chunk = _Store(lambda c: sum(map(self.of_piece.__getitem__, self.pieces.findall(c))))

    def merge(self, piece: str) -> int:
        symbols = list(piece.encode("utf-8"))
        n = len(symbols)
        if n < 2:
            return n
        right, result = self.right, self.result
        shift = 14 if n < 1 << 14 else 40  # heap entries of one machine digit where that does
        place = (1 << shift) - 1
        heap = [r << shift | i for i in range(n - 1) if (r := right[symbols[i]].get(symbols[i + 1])) is not None]
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            top = heappop(heap)
            r, i = top >> shift, top & place
            j = after[i]
            # a pair that has changed since isn't the one that was pushed
            if j >= n or symbols[i] < 0 or right[symbols[i]].get(symbols[j]) != r:
                continue
            symbols[i] = made = result[r]
            symbols[j] = -1
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := right[made].get(symbols[k])) is not None:
                    heappush(heap, r << shift | i)
            h = before[i]
            if h >= 0 and (r := right[symbols[h]].get(made)) is not None:
                heappush(heap, r << shift | h)
        return n - merges

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.cut.split(text) if self.cut and self.cut.search(text) else [text]
        total = len(parts) - 1
        for part in parts:
            if self.other.search(part):
                total += sum(map(self.of_piece.__getitem__, self.pieces.findall(part)))
            else:
                total += sum(map(self.of_chunk.__getitem__, self.chunk.findall(part)))
        return total


@lru_cache(2)
def _counter(raw: bytes) -> Counter:
    import pickle

    return Counter(*pickle.loads(raw))


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row; path: the tokenizer's file, read by the driver."""
    import pickle

    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(load_merges(path)))  # a vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for b in batches:
            texts = b.column(1)
            tokens = [counter(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
