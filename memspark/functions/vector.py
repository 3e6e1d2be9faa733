"""Vector functions on array columns, and the hash embedding that stands in for a model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine in double precision; 0 if a vector is zero. Norms that are at hand save their computation."""
    n = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def mean_pool(rows: Column) -> Column:
    """The mean of an array of vectors, by position."""
    zero = F.transform(rows[0], lambda x: x.cast("double") * 0)
    total = F.aggregate(rows, zero, lambda s, r: F.zip_with(s, r, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.size(rows))


# Fixed values of FNV-1a with 64 bits.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_hex(text: Column) -> Column:
    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f"{fnv1a(t.encode()):016x}")

    return apply(text)


def hash_vectors(texts: list[str], dims: int) -> np.ndarray:
    """Unit vectors of a generator seeded by each text's hash; all texts step together."""
    state = np.array([fnv1a(t.encode()) for t in texts], np.uint64)
    out = np.empty((len(texts), dims), np.float32)
    for i in range(dims):
        state ^= state << np.uint64(13)
        state ^= state >> np.uint64(7)
        state ^= state << np.uint64(17)
        out[:, i] = state.astype(np.float32) / np.float32(2**64) * np.float32(2) - np.float32(1)
    n = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, n, out=out, where=n > 0)


def mock_embedding(text: Column, dims: int = 384) -> Column:
    @F.pandas_udf("array<float>")
    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series(list(hash_vectors(texts.fillna("").tolist(), dims)), dtype=object)

    return apply(text)
