"""Reranking of found passages by a pluggable model, in Arrow batches; the default needs no model files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import index_terms
from tessera.operators.models import keeper


class Reranker(Protocol):
    def score(self, query: str, passages: list[str]) -> list[float]: ...


class CrossModel:
    """A cross-encoder of the sentence_transformers library, if that is installed; more is better."""

    def __init__(self, name: str, batch: int = 16):
        from sentence_transformers import CrossEncoder

        self.model, self.batch = CrossEncoder(name), batch

    def score(self, query: str, passages: list[str]) -> list[float]:
        return [float(x) for x in self.model.predict([(query, p) for p in passages], batch_size=self.batch)] if passages else []


def lexical_score(query: str, text: Column) -> Column:
    """The default: share of the query's distinct terms that the passage has, plus a little for a short passage."""
    wanted = F.array_distinct(index_terms(F.lit(query)))
    have = index_terms(text)
    share = F.size(F.array_intersect(wanted, have)) / F.greatest(F.lit(1), F.size(wanted))
    return share + 0.1 / (1.0 + F.size(have))


def with_model(rows: DataFrame, query: str, make: Callable[[], Reranker], text: str = "text") -> DataFrame:
    """rows with rerank_score by a model that each worker makes once and keeps."""
    names = [c for c in rows.columns if c != "rerank_score"]
    slim = rows.select(*names)
    model_of = keeper(make)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of()
        for b in batches:
            got = [float(x) for x in model.score(query, b.column(names.index(text)).to_pylist())]
            yield b.append_column("rerank_score", pa.array(got, pa.float64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema)
    return slim.mapInArrow(run, f"{kinds}, rerank_score double")
