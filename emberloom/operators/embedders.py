"""Embedders behind one interface: a function from texts to vectors, run over Arrow batches.

The hashing embedder is deterministic and needs no model: signed counts of hashed
character trigrams, of unit length."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dim: int = 64) -> Embedder:
    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            padded = f" {text} "
            for j in range(len(padded) - 2):
                h = zlib.crc32(padded[j : j + 3].encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)

    return embed


def embed(df: DataFrame, text_col: str, embedder: Embedder, out_col: str = "embedding", batch: int = 100) -> DataFrame:
    """df with a vector of each text, asked for in batches of 100."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch].copy()
                part[out_col] = list(embedder([t or "" for t in part[text_col]]))
                yield part

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, {out_col} array<float>")
