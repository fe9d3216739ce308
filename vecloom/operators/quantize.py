"""Scalar and product quantization.

A scalar quantizer maps each element to one byte between its place's extremes. A
product quantizer cuts vectors into sub-vectors and keeps the number of the nearest
centroid of each. Encoders and decoders are Catalyst expressions where the book is
small arithmetic, and numpy blocks for indexes. Distances are asymmetric: a raw
query against decoded vectors, or, for product codes, sums from a lookup table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.operators.aggregates import dim_min_max
from vecloom.operators.kmeans import kmeans, nearest
from vecloom.operators.search import distances
from vecloom.plans.config import InvalidParameter


@dataclass
class ScalarQuantizer:
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def train(cls, rows: DataFrame) -> ScalarQuantizer:
        """From the extremes of every place over all rows; one row a place reaches the driver."""
        found = dim_min_max(rows).orderBy("pos").collect()
        if not found:
            raise InvalidParameter("no vectors to train on")
        return cls(np.array([r["mn"] for r in found]), np.array([r["mx"] for r in found]))

    @property
    def scale(self) -> np.ndarray:
        span = self.high - self.low
        return np.where(span > 1e-6, 255.0 / np.where(span > 1e-6, span, 1.0), 1.0)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.floor(np.clip((x - self.low) * self.scale, 0, 255) + 0.5).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.low + codes / self.scale

    def encode_column(self, vec: Column | str) -> Column:
        low, scale = F.lit(self.low.tolist()), F.lit(self.scale.tolist())
        v = F.col(vec) if isinstance(vec, str) else vec
        return F.transform(v, lambda x, i: F.floor(F.least(F.greatest((x.cast("double") - F.get(low, i)) * F.get(scale, i), F.lit(0.0)), F.lit(255.0)) + 0.5).cast("int"))


def sq_code(x: Column, low: Column, high: Column) -> Column:
    """Code 0..255 of one element between its place's extremes."""
    factor = F.when(high - low > 1e-6, 255.0 / (high - low)).otherwise(F.lit(1.0))
    return F.floor(F.least(F.greatest((x - low) * factor, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("int")


def sq_value(code: Column, low: Column, high: Column) -> Column:
    factor = F.when(high - low > 1e-6, 255.0 / (high - low)).otherwise(F.lit(1.0))
    return low + code / factor


@dataclass
class ProductQuantizer:
    books: np.ndarray  # sub-vector, code, element
    metric: str = "l2"

    @classmethod
    def train(cls, x: np.ndarray, nsub: int = 8, nbits: int = 8, metric: str = "l2", max_iter: int = 25) -> ProductQuantizer:
        if nsub < 1 or x.shape[1] % nsub:
            raise InvalidParameter("dim must be a multiple of nsub")
        if metric == "cosine":
            x = _unit(x)
        size = x.shape[1] // nsub
        codes = min(1 << nbits, len(x))
        return cls(np.stack([kmeans(x[:, s * size : (s + 1) * size], codes, "l2", max_iter) for s in range(nsub)]), metric)

    def encode(self, x: np.ndarray) -> np.ndarray:
        if self.metric == "cosine":
            x = _unit(x)
        size = self.books.shape[2]
        return np.stack([nearest("l2", x[:, s * size : (s + 1) * size], b) for s, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, s]] for s, b in enumerate(self.books)], axis=1)

    def table(self, query: np.ndarray) -> np.ndarray:
        """Lookup table [sub-vector][code]: squared distances, or negative products for IP."""
        size = self.books.shape[2]
        kind = "ip" if self.metric == "ip" else "l2"
        return np.stack([distances(kind, query[None, s * size : (s + 1) * size], b)[0] for s, b in enumerate(self.books)])

    def bytes_per_vector(self) -> int:
        bits = max(1, (self.books.shape[1] - 1).bit_length())
        return len(self.books) * -(-bits // 8)


def adc(codes: Column, table: Column, size: int) -> Column:
    """Asymmetric distance of product codes from a flat lookup table of `size` codes a sub-vector."""
    terms = F.transform(codes, lambda c, i: F.get(table, i * size + c))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.where(n > 1.1920929e-07, x / np.where(n > 0, n, 1), x)
