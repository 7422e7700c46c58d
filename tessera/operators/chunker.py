"""Chunks of sentences.

Sentences are packed greedily up to a number of tokens; when a chunk is full, the longest run of its last sentences that
fits the overlap starts the next one, unless the sentence to come would not fit then. A sentence over the limit is cut
into windows of its own; what was held over from before it stays held, so a later chunk, or a last one, begins with it.
Each chunk's start depends on the one before, so packing runs as a function over Arrow batches, one text at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Tokens of a chunk and of its overlap with the next, and what ends a sentence.
CHUNK_TOKENS, OVERLAP_TOKENS = 384, 96
_BREAK = re.compile(r"(?<=[.!?])\s+|\n{2,}")


def split_sentences(text: str) -> list[str]:
    return [s for part in _BREAK.split(text) if (s := part.strip())]


class WordTokenizer:
    """The default: tokens are runs of anything but white space."""

    def encode(self, text: str) -> Sequence[str]:
        return text.split()

    def decode(self, tokens: Sequence[str]) -> str:
        return " ".join(tokens)


def runs(sizes: Sequence[int], limit: int, overlap: int) -> list[range | int]:
    """What each chunk is made of: a range of the short sentences, counted by themselves, or the number of an over-long sentence.

    With running sums of the sizes, a chunk's end is found by bisection, and so is the start of what the next one repeats. An
    over-long sentence is a wall that no chunk ends behind; what stands before it is repeated behind it.
    """
    short = [n for n in sizes if n <= limit]
    upto = list(accumulate(short, initial=0))
    before = list(accumulate((n <= limit for n in sizes), initial=0))
    walls = [(before[i], i) for i, n in enumerate(sizes) if n > limit]
    out: list[range | int] = []
    start = 0
    for wall, long in [*walls, (len(short), None)]:
        end = -1
        while end < wall:
            end = min(wall, bisect_right(upto, upto[start] + limit) - 1)
            if start < end:
                out.append(range(start, end))
            start = bisect_left(upto, upto[end] - overlap, start, end)
            if end < wall and upto[end + 1] - upto[start] > limit:
                start = end
        if long is not None:
            out.append(long)
    return out


def pack(parts: Sequence[str], tokenizer=None, limit: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[str]:
    """Chunks of the sentences in parts."""
    tokenizer = tokenizer or WordTokenizer()
    sizes = [len(tokenizer.encode(p)) for p in parts]
    short = [p for p, n in zip(parts, sizes, strict=True) if n <= limit]
    chunks: list[str] = []
    for run in runs(sizes, limit, overlap):
        if isinstance(run, range):
            chunks.append(" ".join(short[run.start : run.stop]))
        else:
            tokens = tokenizer.encode(parts[run])
            chunks += [tokenizer.decode(tokens[a : a + limit]) for a in range(0, len(tokens), max(1, limit - overlap))]
    return chunks


def chunk_blocks(blocks: DataFrame, keys: Sequence[str], text: str = "text", make_tokenizer: Callable = WordTokenizer, limit: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """(keys, text) -> (keys, block_chunk, text): the chunks of each block, numbered in it from 0. Null text has none."""
    rows = blocks.select(*keys, F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = make_tokenizer()
        for b in batches:
            found = [pack(split_sentences(t), tokenizer, limit, overlap) if t else [] for t in b.column(len(keys)).to_pylist()]
            row = pa.array([k for k, c in enumerate(found) for _ in c], pa.int64())
            place = pa.array([i for c in found for i in range(len(c))], pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(row) for k in range(len(keys))), place, pa.array([t for c in found for t in c], pa.string())], [*keys, "block_chunk", "text"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return rows.mapInArrow(run, f"{kinds}, block_chunk int, text string")


def number_chunks(chunks: DataFrame, file: str, block: str) -> DataFrame:
    """Adds chunk_index: places in the file, over its blocks in order, from 0. Only the blocks' sizes are put in order."""
    sizes = chunks.groupBy(file, block).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(file).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(file, block, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    return chunks.join(starts, [file, block]).withColumn("chunk_index", (F.col("__first") + F.col("block_chunk")).cast("int")).drop("__first")
