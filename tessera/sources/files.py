"""Folders as tables: listing, hashing and parsing of files.

Files are listed, read, hashed and parsed by the executors, which must see the folder under the same path as the driver does.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema
from tessera.functions.text import suffix
from tessera.sources import ocr, parsers


#: Folders that the driver looks for, so that tasks have something to share out, and levels it goes down for them.
UNITS, LEVELS = 256, 3


def _below(folder: str) -> list[str]:
    try:
        with os.scandir(folder) as found:
            return sorted(e.path for e in found if e.is_dir(follow_symlinks=False))
    except OSError:
        return []


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """path, size and mtime of every file below a folder, hidden ones too, whatever their kind.

    The driver looks for folders of the first levels only; tasks list what is in them, and all that is below the last ones.
    """
    units, frontier = [], [folder]
    for _ in range(LEVELS):
        if len(frontier) >= UNITS:
            break
        units += [(d, False) for d in frontier]
        frontier = [x for d in frontier for x in _below(d)]
    units += [(d, True) for d in frontier]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.float64())])
        for b in batches:
            for top, deep in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for base, inside, names in os.walk(top):
                    rows = []
                    for p in (os.path.join(base, n) for n in names):
                        try:
                            s = os.stat(p)
                        except OSError:
                            continue
                        rows.append({"path": p, "size": s.st_size, "mtime": s.st_mtime})
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)
                    if not deep:
                        inside.clear()

    tasks = min(len(units), 4 * spark.sparkContext.defaultParallelism)
    return spark.createDataFrame(units, "folder string, deep boolean").repartition(tasks).mapInArrow(run, schema.LISTING)


def supported(listing: DataFrame) -> DataFrame:
    return listing.where(suffix(F.element_at(F.split("path", "/"), -1)).isin(*sorted(parsers.SUPPORTED)))


def legacy(listing: DataFrame) -> DataFrame:
    """Files of old formats, which are reported and not read."""
    return listing.where(suffix(F.element_at(F.split("path", "/"), -1)).isin(*sorted(parsers.LEGACY)))


def with_hashes(listing: DataFrame) -> DataFrame:
    """Adds sha1 of the contents, read in pieces; null where a file can't be read."""

    def digest(path: str) -> str | None:
        h = hashlib.sha1()
        try:
            with open(path, "rb") as f:
                while piece := f.read(1 << 16):
                    h.update(piece)
        except OSError:
            return None
        return h.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("sha1", pa.array([digest(p) for p in b.column(0).to_pylist()], pa.string()))

    return listing.select("path", "size", "mtime").mapInArrow(run, f"{schema.LISTING}, sha1 string")


def parse_files(paths: DataFrame, registry: parsers.Registry | None = None, stage: Callable[[DataFrame], DataFrame] = lambda blocks: blocks) -> DataFrame:
    """(path) -> path, block_no, text, page, error. A file that fails gives one row with its error and no text.

    Images, and PDF pages with few letters, are recognised as rows of their own, spread over all tasks, if the registry has engines;
    stage: keeps the blocks in between, as they are used twice then.
    """
    blocks, own = _blocks(paths, registry), registry or parsers.Registry()
    if not (own.ocr or own.ocr_page):
        return blocks.where("error is not null or text <> ''")
    blocks = stage(blocks)
    kind = suffix(F.element_at(F.split("path", "/"), -1))
    image, page = kind.isin(*sorted(parsers.IMAGES)) & F.lit(own.ocr is not None), (kind == ".pdf") & F.lit(own.ocr_page is not None)
    read = ocr.recognise_pages(blocks.where(F.col("error").isNull() & (image | page) & ocr.needs_recognition(F.col("text"))).select("path", "block_no", "page"), own)
    text = F.when(F.col("error").isNull() & (image | page), ocr.better_text(F.col("text"), F.col("recognised"))).otherwise(F.col("text"))
    return blocks.join(read, ["path", "block_no"], "left").select("path", "block_no", text.alias("text"), blocks["page"], "error").where("error is not null or text <> ''")


def _blocks(paths: DataFrame, registry: parsers.Registry | None) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = registry or parsers.Registry()
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, error = [], None
                try:
                    with open(path, "rb") as f:
                        for text, page in own.parse(path, f.read()):
                            rows.append((path, len(rows), text, page, None))
                except Exception as e:  # one bad file must not fail the others
                    rows, error = [], f"{type(e).__name__}: {e}"[:160]
                if error:
                    rows = [(path, 0, None, None, error)]
                kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "block_no", "text", "page", "error"])

    return paths.select("path").mapInArrow(run, f"{schema.BLOCKS}, error string")


def text_blocks(content: DataFrame) -> DataFrame:
    """(path, content) of text files -> blocks, without Python: UTF-8 with replacements, line ends unified, stripped."""
    from tessera.functions.text import strip

    text = strip(F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n?", "\n"))
    return content.select("path", F.lit(0).alias("block_no"), text.alias("text"), F.lit(None).cast("int").alias("page")).where("text <> ''")
