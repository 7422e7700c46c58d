"""Optical recognition of page images as a distributed step: pages are rows, so tasks take the place of a pool of threads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import letter_count, strip
from tessera.sources.parsers import PAGE_LETTERS, Registry, keep_lines


def needs_recognition(text: Column, least: int = PAGE_LETTERS) -> Column:
    return letter_count(F.coalesce(text, F.lit(""))) < least


def better_text(layer: Column, recognised: Column, least: int = PAGE_LETTERS) -> Column:
    """A page's text layer, or what was recognised where the layer has few letters and recognition found more. Stripped."""
    a, b = strip(F.coalesce(layer, F.lit(""))), strip(F.coalesce(recognised, F.lit("")))
    return F.when(needs_recognition(a, least) & (letter_count(b) > letter_count(a)), b).otherwise(a)


def recognise(images: DataFrame, make_engine: Callable[[], Callable[[bytes], list]], image: str = "image", least: float = 0.5, tasks: int | None = None) -> DataFrame:
    """images with their text. Each task makes the engine once; an image that fails gives null.

    tasks: spread the images, each of which takes long, over so many tasks.
    """
    names = images.columns
    rows = images.repartition(tasks) if tasks else images

    def read(engine, content: bytes | None) -> str | None:
        try:
            return None if content is None else keep_lines(engine(content), least)
        except Exception:  # one bad image must not fail the others
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = make_engine()
        for b in batches:
            got = [read(engine, x.as_py()) for x in b.column(names.index(image))]
            yield b.append_column("recognised", pa.array(got, pa.string()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, recognised string")


def recognise_pages(pages: DataFrame, registry: Registry) -> DataFrame:
    """path, block_no, recognised of images and PDF pages (path, block_no, page), each a row, so that one long file is many tasks' work.

    A page that can't be read is null. A task reads a file once for the pages of it that stand together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, bytes] = "", b""
        for b in batches:
            got = []
            for path, page in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    if held[0] != path:
                        with open(path, "rb") as f:
                            held = path, f.read()
                    got.append(registry.recognised(path, held[1], page))
                except Exception:  # one bad page must not fail the others
                    got.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string())], ["path", "block_no", "recognised"])

    spread = pages.repartition(pages.sparkSession.sparkContext.defaultParallelism * 4)
    return spread.mapInArrow(run, "path string, block_no int, recognised string")
