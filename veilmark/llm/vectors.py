"""Helpers on vectors: validity, random rotations and coarse centroids."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors that a coarse index is fitted on, at most.
SAMPLE = 4_096


def usable(column: str) -> Column:
    """True for vectors with no null or non-finite component and some non-zero one."""
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & finite & F.exists(c, lambda x: x != 0), F.lit(False))


@functools.lru_cache(maxsize=16)
def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same for each dimension and seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def matrix(column) -> np.ndarray:
    """Rows of a batch of equally long vectors, in double precision."""
    return np.array([np.asarray(x, dtype=np.float64) for x in column])


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)  # so that squares neither over- nor underflow
    x = x / top
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sample(vectors: DataFrame, key: str, column: str, limit: int = SAMPLE) -> tuple[list, np.ndarray]:
    """Ids and rows of at most ``limit`` vectors of the most frequent dimension."""
    dims = vectors.groupBy(F.size(column).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return [], np.empty((0, 0))
    rows = (
        vectors.where(F.size(column) == dims["d"]).select(key, column)
        .orderBy(F.xxhash64(key, F.lit("vectors")), key).limit(limit).collect()
    )
    return [r[key] for r in rows], matrix([r[column] for r in rows])


def centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centroids of spherical k-means on the rows of ``x``."""
    x = unit(x)
    k = max(1, min(k, len(x)))
    out = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        own = (x @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        out = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), out)
    return out
