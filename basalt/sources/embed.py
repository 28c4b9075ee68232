"""Vectors for texts: an interface, and a provider without a network for tests."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts in, one vector each out, in order.
Provider = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def hashed_words(dimension: int = 64) -> Provider:
    """Words at hashed places with hashed signs, at length 1; alike for like texts, and always the same.

    Where the signs of a text's words cancel out, they are left aside; only a text without a word has no length.
    """

    def embed(texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimension))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % dimension] += 1 if h >> 16 & 1 else -1
            if not row.any():
                for word in text.lower().split():
                    row[zlib.crc32(word.encode()) % dimension] += 1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-10)).tolist()

    return embed


def embedded(text: Column | str, provider: Provider, batch: int = 256) -> Column:
    """Vectors of a text column, ``batch`` texts a call; null for a null text, and for a call that failed."""

    def run(column: pa.Array) -> pa.Array:
        texts, out = column.to_pylist(), []
        for at in range(0, len(texts), batch):
            part = texts[at : at + batch]
            try:
                vectors = provider([t or "" for t in part])
            except Exception:  # a provider may fail in any way; the rows stay without a vector
                vectors = [None] * len(part)
            out += [v if t is not None else None for t, v in zip(part, vectors)]
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")(text)
