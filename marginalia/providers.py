"""Embedding and reranking: what a model must offer, and stand-ins that need none."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


class Embedder(Protocol):
    """``embed`` gives one unit vector per text. It is sent to the tasks, so it must load its model there, once per worker."""

    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    """``score`` gives one number per pair of query and text. It is sent to the tasks, like an embedder."""

    def score(self, queries: list[str], texts: list[str]) -> np.ndarray: ...


def model_scorer(model: Reranker) -> Callable[[Column, Column], Column]:
    """A scorer for ``search.rerank`` that asks a model, batch by batch."""

    @F.pandas_udf(DoubleType())
    def scored(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(model.score(queries.fillna("").tolist(), texts.fillna("").tolist()), np.float64))

    return scored


class HashingEmbedder:
    """Words and their halves of a pair hashed to signed dimensions, unit length; equal texts have equal vectors."""

    def __init__(self, dimension: int = 256):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts, strict=True):
            own = (text or "").lower().split()
            for feature in (*own, *map(" ".join, zip(own, own[1:], strict=False))):
                h = xxhash.xxh3_64_intdigest(feature)
                row[h % self.dimension] += 1.0 if h >> 63 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def embed_column(df: DataFrame, id_col: str, text_col: str, embedder: Embedder, batch: int = 64) -> DataFrame:
    """(``id_col``, vector array<float>) for every row; null and empty texts have a null vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts = part.column(1).to_pylist()
                vectors = embedder.embed([t or "" for t in texts])
                rows = [v.astype(np.float32) if t else None for t, v in zip(texts, vectors, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float32()))], names=[id_col, "vector"])

    return df.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, vector array<float>")


@lru_cache(1000)
def embed_query(embedder: Embedder, query: str) -> tuple[float, ...]:
    return tuple(embedder.embed([query])[0].tolist())
