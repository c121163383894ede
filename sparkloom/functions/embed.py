"""Embedders: an interface, and a deterministic one by hashed character n-grams that needs no model."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf


class Embedder(Protocol):
    dim: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class HashedNgrams:
    """Unit vectors of signed counts of hashed character n-grams."""

    def __init__(self, dim: int = 256, sizes: Sequence[int] = (2, 3)):
        self.dim, self.sizes = dim, tuple(sizes)

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts):
            t = f" {(text or '').lower()} "
            for n in self.sizes:
                for i in range(len(t) - n + 1):
                    h = xxhash.xxh64_intdigest(t[i : i + n])
                    row[h % self.dim] += 1 if h >> 63 else -1
            size = np.linalg.norm(row)
            if size:
                row /= size
        return out


def embedding(df: DataFrame, embedder: Embedder):
    """A Column function text -> array<float>; the embedder is sent once and called for whole batches."""
    shared = df.sparkSession.sparkContext.broadcast(embedder)

    @pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(shared.value.embed(s.fillna("").tolist())), dtype=object)

    return run
