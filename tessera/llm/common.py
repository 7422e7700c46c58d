"""Shared pieces of the training-data operators: tables, shared folders, and NumPy text kernels.

The kernels work on the raw UTF-8 buffer of an Arrow string column, a bounded slice of whole documents at a time, so a
worker's memory is a small multiple of ``CHUNK_BYTES`` (or of the longest single document, if that is longer).
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache, wraps
from inspect import signature

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import prepare

CHUNK_BYTES = 1 << 19
U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where that is unset, a temporary one within one process, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Rows of a file of a small table.
FILE_ROWS = 100_000


def stage_table(df: DataFrame, name: str, at_most: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors.

    at_most: a bound of its rows, if one is known; so few rows aren't spread over more files than they need.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df if at_most is None else df.coalesce(max(8, at_most // FILE_ROWS))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a staged table whose last reader is done."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unused(name: str, *frames: DataFrame) -> str:
    """A column name like name that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


def plan_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of a relation's size; a default where it has none."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 58 else 1 << 30


def fold_is_train(doc_id: str = "doc_id"):
    """Rows whose crc32(doc_id as text) mod 3 is not 1; a null id counts as training data."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) != 1, F.lit(True))


@lru_cache(1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def trim() -> None:
    """Give freed memory back: a worker is kept for later tasks, and its executor's memory counts it."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def trimmed(f):
    """f for applyInArrow, with its memory given back after each group."""

    @wraps(f)
    def run(*tables):
        out = f(*tables)
        del tables
        trim()
        return out

    # the number of parameters tells Spark whether it is to pass keys
    run.__signature__ = signature(f)
    return run


def regrouped(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``limit`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= limit:
            b = pa.concat_batches(held)
            held, size = [], 0
            yield b
            trim()
    if held:
        yield pa.concat_batches(held)
        trim()


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole texts of about ``limit`` bytes; null is the empty text."""
    for base, arr in _chunks(column):
        arr = pc.fill_null(arr.cast(pa.large_string()), "")
        if not len(arr):
            continue
        _, off, data = arr.buffers()
        offs = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        row = 0
        while row < len(arr):
            end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
            end = min(end, len(arr))
            yield base + row, base + end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
            row = end


def _chunks(column):
    base = 0
    for arr in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        yield base, arr
        base += len(arr)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixing generator; a bijection."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * U64(0xD1342543DE82EF95))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2 ** 64, kept per worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        seed = np.full(max(n, CHUNK_BYTES + 1024), base, np.uint64)
        seed[0] = 1
        have = _powers[base] = np.cumprod(seed, dtype=np.uint64)
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash, one entry longer than the data."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end]; equal bytes give equal hashes wherever they stand."""
    inverse = powers(_INVERSE, len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * U64(0xA0761D6478BD642F))


def find_words(low: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the total) of maximal runs of bytes marked in ``inside``, within texts."""
    if not len(low):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    m = inside[low]
    before = np.empty_like(m)
    before[0] = False
    before[1:] = m[:-1]
    cut = offs[1:-1]
    before[cut[cut < len(low)]] = False
    starts = np.flatnonzero(m & ~before)
    after = np.empty_like(m)
    after[-1] = False
    after[:-1] = m[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def byte_table(*keep: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in keep:
        table[a : b + 1] = True
    return table


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (those that start at 0 .. len-n)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    factor = 0xC2B2AE3D27D4EB4F
    for j in range(n):
        out += words[j : j + count] * U64(pow(factor, j + 1, 1 << 64))
    return mix64(out)
