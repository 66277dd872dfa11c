"""Vector arithmetic on array columns, and its Arrow form for scans."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in vector])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def magnitude(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    size = magnitude(a) * magnitude(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def l2_similarity(a: Column, b: Column) -> Column:
    return 1 / (1 + F.sqrt(l2_squared(a, b)))


def normalize(a: Column) -> Column:
    size = magnitude(a)
    return F.when(size == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x / size))


def truncate(a: Column, dims: int) -> Column:
    """The first ``dims`` values, for embeddings trained so that prefixes serve."""
    return F.slice(a, 1, dims)


def scan_similarity(query: Sequence[float], metric: str = "cosine"):
    """An Arrow UDF that scores vectors against one query, a batch at a time."""
    q = np.asarray(query, np.float64)
    q_norm = np.linalg.norm(q)

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=float)
        m = np.vstack(vectors.to_numpy()).astype(np.float64)
        if metric == "l2":
            return pd.Series(1 / (1 + np.sqrt(((m - q) ** 2).sum(1))))
        size = np.linalg.norm(m, axis=1) * q_norm
        return pd.Series(np.divide(m @ q, size, out=np.zeros(len(m)), where=size > 0))

    return score


def scalar_quantize(a: Column) -> Column:
    """struct(codes 0..255, least, scale): scale is (most - least) / 255, or 1 if flat; half rounds away from 0."""
    least, most = F.array_min(a).cast("double"), F.array_max(a).cast("double")
    scale = F.when(most > least, (most - least) / 255).otherwise(1.0)
    return F.struct(F.transform(a, lambda x: F.floor((x - least) / scale + 0.5).cast("int")).alias("codes"), least.alias("least"), scale.alias("scale"))


def scalar_restore(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: c * q["scale"] + q["least"])


def binary_quantize(a: Column, dims: int) -> Column:
    """Bit i of word i / 64 is 1 where value i is not negative."""
    words = []
    for start in range(0, dims, 32):  # two halves a word: shifts of 32 bits stay exact as doubles
        part = F.slice(a, start + 1, 32)
        words.append(F.aggregate(F.transform(part, lambda x, i: F.when(x >= 0, F.pow(F.lit(2.0), i)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x).cast("long"))
    return F.array(*[words[i] if i + 1 == len(words) else words[i].bitwiseOR(F.shiftleft(words[i + 1], 32)) for i in range(0, len(words), 2)])


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def hamming_similarity(a: Column, b: Column, dims: int) -> Column:
    return 1 - hamming(a, b) / dims


def size_bytes(dims: int, kind: str = "float") -> int:
    """Bytes of a stored vector: 4 a value, 1 and two floats, or a bit."""
    return {"float": 4 * dims, "scalar": dims + 8, "binary": 8 * -(-dims // 64)}[kind]


def compression_ratio(dims: int, kind: str) -> float:
    return size_bytes(dims) / size_bytes(dims, kind)


def pool(vectors: Column, mode: str = "mean") -> Column:
    """An array of vectors as one: mean, first (cls) or max at each place."""
    if mode == "cls":
        return vectors[0]
    places = F.sequence(F.lit(0), F.size(vectors[0]) - 1)
    at = lambda i: F.transform(vectors, lambda v: v[i])
    if mode == "max":
        return F.transform(places, lambda i: F.array_max(at(i)))
    return F.transform(places, lambda i: F.aggregate(at(i), F.lit(0.0), lambda s, x: s + x) / F.size(vectors))
