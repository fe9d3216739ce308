"""Vector functions as Catalyst expressions over array<float> columns.

Arithmetic is double precision and sums run from left to right, so results do not
depend on partitioning. A null vector gives null. Squared L2, L2 and cosine
distance are separate functions and never mixed within one ranking.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The smallest relevant divisor or norm, and the largest finite float32.
EPSILON = 1.1920929e-07
FLOAT_MAX = 3.4028234663852886e38


def _col(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def doubles(v: Column | str) -> Column:
    return F.transform(_col(v), lambda x: x.cast("double"))


def fold(v: Column | str) -> Column:
    """Sum of the elements, from the left, in double precision."""
    return F.aggregate(_col(v), F.lit(0.0), lambda s, x: s + x.cast("double"))


def _zip(a, b, f) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: f(x.cast("double"), y.cast("double")))


def constant(value: float, size: int) -> Column:
    """A vector of `size` equal elements."""
    return F.array_repeat(F.lit(float(value)), size)


def add(a, b) -> Column:
    return _zip(a, b, lambda x, y: x + y)


def sub(a, b) -> Column:
    return _zip(a, b, lambda x, y: x - y)


def scale(v, factor) -> Column:
    return F.transform(_col(v), lambda x: x.cast("double") * factor)


def div(v, divisor) -> Column:
    """Zeros where the divisor is as good as zero."""
    d = divisor if isinstance(divisor, Column) else F.lit(float(divisor))
    return F.transform(_col(v), lambda x: F.when(F.abs(d) <= EPSILON, F.lit(0.0)).otherwise(x.cast("double") / d))


def dot(a, b) -> Column:
    return fold(_zip(a, b, lambda x, y: x * y))


def cross(a, b) -> Column:
    """Cross product of three-dimensional vectors; null for others."""
    a, b = doubles(a), doubles(b)
    out = F.array(*[a[i] * b[j] - a[j] * b[i] for i, j in ((1, 2), (2, 0), (0, 1))])
    return F.when((F.size(a) == 3) & (F.size(b) == 3), out)


def l2_squared(a, b) -> Column:
    return fold(_zip(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a, b) -> Column:
    return F.sqrt(l2_squared(a, b))


def l1(a, b) -> Column:
    return fold(_zip(a, b, lambda x, y: F.abs(x - y)))


def hamming(a, b) -> Column:
    """Number of places in which the vectors differ."""
    return fold(_zip(a, b, lambda x, y: (x != y).cast("double")))


def ip_distance(a, b) -> Column:
    return -dot(a, b)


def norm_l2_squared(v) -> Column:
    return dot(v, v)


def norm_l2(v) -> Column:
    return F.sqrt(dot(v, v))


def norm_l1(v) -> Column:
    return fold(F.transform(_col(v), lambda x: F.abs(x.cast("double"))))


def cosine_distance(a, b) -> Column:
    """1 where either norm is as good as zero."""
    na, nb = norm_l2(a), norm_l2(b)
    return F.when((na < EPSILON) | (nb < EPSILON), F.lit(1.0)).otherwise(1.0 - dot(a, b) / (na * nb))


def cosine_similarity(a, b) -> Column:
    return 1.0 - cosine_distance(a, b)


def normalize(v) -> Column:
    """Unit L2 norm; null for a zero vector."""
    n = norm_l2(v)
    return F.when(n > EPSILON, F.transform(_col(v), lambda x: x.cast("double") / n))


def normalize_l1(v) -> Column:
    n = norm_l1(v)
    return F.when(n > EPSILON, F.transform(_col(v), lambda x: x.cast("double") / n))


def normalize_or_keep(v) -> Column:
    """Unit L2 norm; a zero vector stays as it is (the batch form)."""
    return F.coalesce(normalize(v), doubles(v))


def is_normalized(v, eps: float = 1e-6) -> Column:
    return F.abs(norm_l2(v) - 1.0) <= eps


def mean(v) -> Column:
    return F.when(F.size(_col(v)) > 0, fold(v) / F.size(_col(v)))


def variance(v) -> Column:
    """Of the population."""
    m = mean(v)
    return F.when(F.size(_col(v)) > 0, fold(F.transform(_col(v), lambda x: (x.cast("double") - m) * (x.cast("double") - m))) / F.size(_col(v)))


def stddev(v) -> Column:
    return F.sqrt(variance(v))


def argmax(v) -> Column:
    """Zero-based place of the first largest element; null for an empty vector."""
    v = _col(v)
    return F.when(F.size(v) > 0, (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def argmin(v) -> Column:
    v = _col(v)
    return F.when(F.size(v) > 0, (F.array_position(v, F.array_min(v)) - 1).cast("int"))


def is_valid(v) -> Column:
    """Not empty, no null, no NaN, all finite."""
    v = _col(v)
    return (F.size(v) > 0) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= FLOAT_MAX)), F.lit(False))


def equal(a, b, eps: float = 1e-6) -> Column:
    """Equal length and no element further apart than eps."""
    a, b = _col(a), _col(b)
    return (F.size(a) == F.size(b)) & F.forall(_zip(a, b, lambda x, y: F.abs(x - y) <= eps), lambda z: z)


def random_uniform(seed, size: int) -> Column:
    """Elements in [-1, 1) from a hash of seed and place: the same wherever it runs."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.pmod(F.xxhash64(seed, i), F.lit(1 << 24)) / float(1 << 23) - 1.0)


def random_gaussian(seed, size: int) -> Column:
    """Standard normal elements by Box and Muller, from a hash of seed and place."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)

    def uniform(i, salt):
        return (F.pmod(F.xxhash64(seed, i, F.lit(salt)), F.lit(1 << 24)) + 1) / float((1 << 24) + 1)

    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.sqrt(-2.0 * F.ln(uniform(i, 1))) * F.cos(2.0 * F.pi() * uniform(i, 2)))


def int8_quantize(v, low: float, high: float) -> Column:
    """Codes -128..127 of the range low..high (null where the range is empty)."""
    if high <= low:
        return F.lit(None).cast("array<int>")
    factor = 255.0 / (high - low)
    return F.transform(_col(v), lambda x: (F.floor(F.least(F.greatest((x.cast("double") - low) * factor, F.lit(0.0)), F.lit(255.0)) + 0.5) - 128).cast("int"))


def int8_dequantize(codes, low: float, high: float) -> Column:
    return F.transform(_col(codes), lambda c: (c + 128) * ((high - low) / 255.0) + low)


def int8_dot(a, b) -> Column:
    """Integer inner product of two code vectors."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("long") * y), F.lit(0).cast("long"), lambda s, x: s + x)


def distance(metric: str, a, b) -> Column:
    """Canonical ascending distance of a metric: l2 (squared), ip, cosine, l1 or hamming."""
    return {"l2": l2_squared, "ip": ip_distance, "cosine": cosine_distance, "l1": l1, "hamming": hamming}[str(getattr(metric, "value", metric))](a, b)


def score(metric: str, distance: Column) -> Column:
    """Index convention: squared distance for L2, similarity for cosine, inner product for IP."""
    kind = str(getattr(metric, "value", metric))
    return 1.0 - distance if kind == "cosine" else -distance if kind == "ip" else distance
