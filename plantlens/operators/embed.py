"""The embedding stage: a pluggable text-to-matrix function run batch-wise on executors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: texts handed to the embedding function at a time.
BATCH = 64

Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dim: int = 256) -> Embedder:
    """Offline default: word counts in ``dim`` hash buckets."""
    words = re.compile(r"[a-z0-9]+")
    buckets: dict[str, int] = {}

    def bucket(word: str) -> int:
        if len(buckets) > 200_000:
            buckets.clear()
        spot = buckets[word] = int(hashlib.md5(word.encode()).hexdigest()[:6], 16) % dim
        return spot

    def embed(texts: list[str]) -> np.ndarray:
        cells: list[int] = []
        for row, text in enumerate(texts):
            for word in words.findall(text.lower()):
                spot = buckets.get(word)
                cells.append(row * dim + (bucket(word) if spot is None else spot))
        counted = np.bincount(np.array(cells, dtype=np.int64), minlength=len(texts) * dim)
        return counted.reshape(len(texts), dim).astype(float)

    return embed


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return (matrix / np.where(norms == 0, 1.0, norms)).astype("float32")


def embed_column(df: DataFrame, text: str, embedder: Embedder, name: str = "vec", batch: int = BATCH) -> DataFrame:
    """Adds the L2-normalised vector of ``text``."""

    @F.arrow_udf("array<float>")
    def vectors(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            texts = part.fill_null("").to_pylist()
            blocks = [
                unit_rows(np.asarray(embedder(texts[start : start + batch]), dtype=float))
                for start in range(0, len(texts), batch)
            ]
            matrix = np.vstack(blocks) if blocks else np.empty((0, 1), dtype="float32")
            offsets = np.arange(len(texts) + 1, dtype="int32") * matrix.shape[1]
            yield pa.ListArray.from_arrays(offsets, matrix.ravel())

    return df.withColumn(name, vectors(F.col(text)))
