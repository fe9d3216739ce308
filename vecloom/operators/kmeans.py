"""Deterministic k-means on a bounded sample: farthest-first seeds, then Lloyd rounds.

TRAIN_ROWS bounds the sample, which is picked by a hash of the vid; indexes made
from the centroids hold every row. Seeds start from the smallest vid of the sample
and ties go to it, so the same rows always give the same centroids. An empty
cluster keeps its centroid; centroids are arithmetic means under every metric.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators.search import distances, matrix
from vecloom.plans.config import InvalidParameter

TRAIN_ROWS = 20_000


def training_sample(rows: DataFrame, rows_limit: int = TRAIN_ROWS) -> np.ndarray:
    """At most rows_limit vectors of the commonest dimension, in vid order."""
    picked = rows.filter("vec is not null").select("vid", "vec").orderBy(F.xxhash64("vid"), "vid").limit(rows_limit).toArrow()
    if not picked.num_rows:
        raise InvalidParameter("no vectors to train on")
    picked = picked.sort_by("vid")
    sizes = picked.column("vec").combine_chunks().value_lengths().to_numpy()
    return matrix(picked.column("vec"), int(np.bincount(sizes).argmax()))[1].astype(np.float64)


def nearest(metric: str, x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each vector; the first of equals."""
    out = np.empty(len(x), np.int64)
    for a in range(0, len(x), 8192):
        out[a : a + 8192] = np.argmin(distances(metric, centroids, x[a : a + 8192]), axis=0)
    return out


def seeds(metric: str, x: np.ndarray, k: int) -> np.ndarray:
    """Farthest-first: each seed is the vector farthest from those before it."""
    chosen = [0]
    gap = distances(metric, x[:1], x)[0]
    while len(chosen) < k:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, distances(metric, x[chosen[-1:]], x)[0])
    return x[chosen].copy()


def kmeans(x: np.ndarray, k: int, metric: str = "l2", max_iter: int = 20, tolerance: float = 1e-4) -> np.ndarray:
    if k < 1 or len(x) < k:
        raise InvalidParameter(f"{len(x)} vectors are too few for {k} clusters")
    centroids = seeds(metric, x, k)
    for _ in range(max_iter):
        owner = nearest(metric, x, centroids)
        count = np.bincount(owner, minlength=k)
        total = np.zeros_like(centroids)
        np.add.at(total, owner, x)
        moved = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
        shift = float(np.abs(moved - centroids).max())
        centroids = moved
        if shift <= tolerance:
            break
    return centroids
