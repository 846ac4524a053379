"""A deterministic embedder for places without a model: signed token hashing, unit norm.

Any function from a pandas Series of texts to lists of floats can stand in for it (`embedded(..., model=f)`); a real
model is loaded once for each Python worker inside such a function.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.chunks import small_batches

DIMENSIONS = 64


def hashed(texts: pd.Series, dimensions: int = DIMENSIONS) -> list[list[float]]:
    out = []
    for text in texts:
        x = np.zeros(dimensions)
        for word in (text or "").lower().split():
            h = hashlib.md5(word.encode()).digest()
            x[int.from_bytes(h[:4], "little") % dimensions] += 1.0 if h[4] & 1 else -1.0
        n = np.linalg.norm(x)
        out.append((x / n if n else x).astype(np.float32).tolist())
    return out


def embedded(chunks: DataFrame, model: Callable[[pd.Series], list[list[float]]] = hashed, rows: int = 256) -> DataFrame:
    """(id, chunk_idx, embedding) of chunks (id, chunk_idx, chunk_text), in batches of `rows`."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, rows):
                piece = part.slice(at, rows)
                made = model(piece["chunk_text"].to_pandas())
                yield pa.RecordBatch.from_arrays([piece["id"], piece["chunk_idx"], pa.array(made, pa.list_(pa.float32()))], names=["id", "chunk_idx", "embedding"])

    small_batches(chunks.sparkSession)
    return chunks.select(F.col("id").cast("long").alias("id"), F.col("chunk_idx").cast("int").alias("chunk_idx"), "chunk_text").mapInArrow(run, "id long, chunk_idx int, embedding array<float>")
