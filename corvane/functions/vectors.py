"""Vector functions on array<float> columns."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Unit length; null for zero vectors and those with a value that is not finite."""
    n = norm(v)
    return F.when(valid(v) & (n > 0), F.transform(v, lambda x: x / n))


def valid(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def hashing_embedder(dimension: int = 64):
    """A deterministic text embedder without a model: signed hashed tokens, unit length.

    A text without tokens, or whose tokens cancel out, has the one slot of the whole text's hash: every text has a vector.
    """

    @pandas_udf(ArrayType(FloatType()))
    def embed(text: pd.Series) -> pd.Series:
        @functools.lru_cache(1 << 16)
        def place(word: str) -> tuple[int, int]:
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            return h % dimension, 1 if h >> 63 else -1

        def one(t: str | None) -> np.ndarray:
            slots = [0] * dimension
            for word in (t or "").lower().split():
                slot, sign = place(word)
                slots[slot] += sign
            if not any(slots):
                slot, sign = place((t or "").lower())
                slots[slot] = sign
            v = np.array(slots, dtype=np.float32)
            return v / float(np.linalg.norm(v))

        return text.map(one)

    return embed
