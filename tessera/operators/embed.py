"""Embeddings by a pluggable model, in Arrow batches; the default hashes terms and needs no model files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators.models import keeper


class Embedder(Protocol):
    dim: int

    def passages(self, texts: list[str]) -> np.ndarray: ...

    def query(self, text: str) -> np.ndarray: ...


class HashingEmbedder:
    """Signed hashed term counts, of unit length; a text without terms is the first axis."""

    def __init__(self, dim: int = 384):
        self.dim = dim

    def passages(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for k, text in enumerate(texts):
            for word in text.lower().split():
                h = xxhash.xxh64_intdigest(word.strip(".,;:!?\"'()").encode())
                out[k, h % self.dim] += 1.0 if h >> 63 else -1.0
        norms = np.linalg.norm(out, axis=1)
        out[norms == 0, 0] = 1.0
        return out / np.where(norms == 0, 1.0, norms)[:, None].astype(np.float32)

    def query(self, text: str) -> np.ndarray:
        return self.passages([text])[0]


# The prompt that this family of models was trained with for queries, and the batch of its passages.
QUERY_PROMPT = "Represent this sentence for searching relevant passages: "
BATCH = 32


def query_text(text: str, model: str) -> str:
    return QUERY_PROMPT + text if "bge-" in model.lower() else text


class SentenceModel:
    """A model of the sentence_transformers library, if that is installed; unit vectors."""

    def __init__(self, name: str):
        from sentence_transformers import SentenceTransformer

        self.name, self.model = name, SentenceTransformer(name)
        self.dim = self.model.get_sentence_embedding_dimension()

    def passages(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, self.dim), np.float32)
        return np.asarray(self.model.encode(texts, batch_size=BATCH, normalize_embeddings=True), np.float32)

    def query(self, text: str) -> np.ndarray:
        return self.passages([query_text(text, self.name)])[0]


def embed(text: Column, make: Callable[[], Embedder] = HashingEmbedder) -> Column:
    """Vectors of a text column. A worker keeps its model for later tasks; texts of a batch go to it by length, so that little is padded."""
    model_of = keeper(make)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = model_of()
        for b in batches:
            texts = b.fillna("").tolist()
            order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
            out = np.empty(len(texts), object)
            for k, v in zip(order, model.passages([texts[k] for k in order]), strict=True):
                out[k] = v
            yield pd.Series(out, index=b.index, dtype=object)

    return run(text)
