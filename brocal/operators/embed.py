"""A map of a sample of rows in two dimensions (t-SNE)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brocal.operators.ranking import sample_exact

#: Rows of the sample, at most: the method compares all of them with each other.
MOST = 2000


def _affinities(d: np.ndarray, perplexity: float) -> np.ndarray:
    """Symmetric neighbour probabilities whose entropy is that of `perplexity` neighbours, by bisection of all widths at once."""
    n = len(d)
    low, high, beta = np.zeros(n), np.full(n, np.inf), np.ones(n)
    goal = np.log(min(perplexity, max(1.0, (n - 1) / 3)))
    for _ in range(50):
        p = np.exp(-d * beta[:, None])
        np.fill_diagonal(p, 0)
        s = np.maximum(p.sum(axis=1), 1e-300)
        entropy = np.log(s) + beta * (d * p).sum(axis=1) / s
        wide = entropy > goal
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    p /= s[:, None]
    return np.maximum((p + p.T) / (2 * n), 1e-12)


def tsne(x: np.ndarray, perplexity: float = 30, steps: int = 250, seed: int = 42) -> np.ndarray:
    n = len(x)
    if n < 3:
        return np.zeros((n, 2))
    square = (x**2).sum(axis=1)
    p = _affinities(np.maximum(square[:, None] + square - 2 * x @ x.T, 0), perplexity)
    y = np.random.default_rng(seed).normal(scale=1e-4, size=(n, 2))
    move = np.zeros_like(y)
    for step in range(steps):
        s = (y**2).sum(axis=1)
        near = 1 / (1 + np.maximum(s[:, None] + s - 2 * y @ y.T, 0))
        np.fill_diagonal(near, 0)
        w = (p * (4 if step < 80 else 1) - np.maximum(near / near.sum(), 1e-12)) * near
        slope = 4 * (w.sum(axis=1)[:, None] * y - w @ y)
        move = (0.5 if step < 80 else 0.8) * move - max(n / 48, 10) * slope
        y = y + move
        y -= y.mean(axis=0)
    return y


def map_sample(df: DataFrame, key: str, columns: Sequence[str], rows: int = MOST, perplexity: float = 30) -> DataFrame:
    """`key`, x, y of an exact random sample of at most MOST rows that have all columns, standardised."""
    sample = sample_exact(df.dropna(subset=list(columns)), key, min(rows, MOST)).select(key, *[F.col(c).cast("double") for c in columns]).collect()
    kind = df.schema[key].dataType.simpleString()
    if not sample:
        return df.sparkSession.createDataFrame([], f"`{key}` {kind}, x double, y double")
    m = np.array([r[1:] for r in sample], float)
    sd = m.std(axis=0)
    at = tsne((m - m.mean(axis=0)) / np.where(sd == 0, 1, sd), perplexity)
    return df.sparkSession.createDataFrame([(r[0], float(a), float(b)) for r, (a, b) in zip(sample, at)], f"`{key}` {kind}, x double, y double")
