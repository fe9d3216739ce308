"""Scalar, string and hash functions as Catalyst expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def guarded_sqrt(x: Column) -> Column:
    """0 where x is not positive."""
    return F.when(x > 0, F.sqrt(x)).otherwise(F.lit(0.0))


def guarded_log(x: Column, sentinel: float = -1e300) -> Column:
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(sentinel))


def guarded_log1p(x: Column, sentinel: float = -1e300) -> Column:
    return F.when(x > -1, F.log1p(x)).otherwise(F.lit(sentinel))


def guarded_expm1(x: Column, limit: float = 50.0, sentinel: float = 1e20) -> Column:
    return F.when(x > limit, F.lit(sentinel)).otherwise(F.expm1(x))


def equals_ignore_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def compare(a: Column, b: Column, size: int | None = None, ignore_case: bool = False) -> Column:
    """-1, 0 or 1, of the first `size` characters if given."""
    if ignore_case:
        a, b = F.lower(a), F.lower(b)
    if size is not None:
        a, b = F.substring(a, 1, size), F.substring(b, 1, size)
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def find(s: Column, needle: str) -> Column:
    """Zero-based place of the first occurrence, -1 if there is none, 0 for an empty needle."""
    return F.locate(needle, s) - 1 if needle else F.when(s.isNotNull(), F.lit(0))


def find_last(s: Column, char: str) -> Column:
    """Zero-based place of the last occurrence of one character, or -1."""
    at = F.locate(char, F.reverse(s))
    return F.when(at > 0, F.length(s) - at).otherwise(F.when(s.isNotNull(), -1))


def split_chars(s: Column, chars: str, limit: int | None = None) -> Column:
    """Split at any of the characters; empty parts stay, an empty last part goes; a limit drops further parts."""
    parts = F.split(s, "[" + "".join(re.escape(c) for c in chars) + "]", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.slice(parts, 1, limit) if limit else parts


def parse_integer(s: Column) -> Column:
    """The number that a string starts with, else 0."""
    return F.coalesce(F.regexp_extract(s, r"^\s*([+-]?[0-9]+)", 1).try_cast("long"), F.lit(0).cast("long"))


def parse_double(s: Column) -> Column:
    return F.coalesce(F.regexp_extract(s, r"^\s*([+-]?[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))


def format_truncated(x: Column, digits: int) -> Column:
    """Decimal text with digits beyond `digits` cut off."""
    power = float(10**digits)
    whole = F.when(x < 0, F.ceil(x * power)).otherwise(F.floor(x * power)) / power
    return F.format_string(f"%.{digits}f", whole)


def hash_bits(*columns: Column) -> Column:
    """64-bit hash of strings, numbers or vectors."""
    return F.xxhash64(*columns)


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """The standard 32-bit MurmurHash3 of bytes, unsigned."""

    def spin(x: int, n: int) -> int:
        return ((x << n) | (x >> (32 - n))) & 0xFFFFFFFF

    def scramble(k: int) -> int:
        return spin(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF

    h, whole = seed, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = (spin(h ^ scramble(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    if whole < len(data):
        h ^= scramble(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> shift)) * factor & 0xFFFFFFFF
    return h ^ (h >> 16)


def murmur3(seed: int = 0):
    """Arrow UDF of a string column: the standard MurmurHash3, as a long (null counts as 0)."""
    @F.pandas_udf("long")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda x: 0 if x is None else murmur3_32(x.encode(), seed))

    return apply
