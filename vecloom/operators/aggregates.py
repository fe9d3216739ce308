"""Aggregations of vectors: element-wise sum, mean, weighted mean, minimum and maximum.

Elements are exploded with their places and combined by ordinary aggregates, which
combine before the shuffle: the shuffle carries (group, place) sums, not vectors.
With ordered=True the elements of a group are summed in vid order instead, so that
the result is the same to the last bit wherever it runs; that gathers a group's
elements per place and is meant for small groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _exploded(df: DataFrame, by: list[str], *more: str) -> DataFrame:
    return df.select(*by, *more, F.posexplode("vec").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def _packed(df: DataFrame, by: list[str], name: str) -> DataFrame:
    gathered = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return df.groupBy(*by).agg(F.transform(gathered, lambda e: e["v"]).alias(name))


def _ordered_sum(x="x"):
    x = F.col(x) if isinstance(x, str) else x
    return F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("vid", x.alias("x")))), lambda e: e["x"]), F.lit(0.0), lambda s, x: s + x)


def vector_sum(df: DataFrame, by: list[str], ordered: bool = False) -> DataFrame:
    sums = _exploded(df, by, "vid").groupBy(*by, "pos").agg((_ordered_sum() if ordered else F.sum("x")).alias("v"))
    return _packed(sums, by, "vec_sum")


def vector_mean(df: DataFrame, by: list[str], ordered: bool = False) -> DataFrame:
    total = _ordered_sum() / F.count(F.lit(1)) if ordered else F.avg("x")
    return _packed(_exploded(df, by, "vid").groupBy(*by, "pos").agg(total.alias("v")), by, "vec_mean")


def weighted_mean(df: DataFrame, by: list[str], weight: str, ordered: bool = False) -> DataFrame:
    """Weighted by a column; the plain weighted sum where the weights add up to nothing."""
    add = _ordered_sum if ordered else F.sum
    sums = _exploded(df, by, "vid", weight).groupBy(*by, "pos").agg(add(F.col("x") * F.col(weight)).alias("s"), F.sum(weight).alias("w"))
    return _packed(sums.withColumn("v", F.when(F.abs("w") > 1.1920929e-07, F.col("s") / F.col("w")).otherwise(F.col("s"))), by, "vec_mean")


def dim_min_max(df: DataFrame) -> DataFrame:
    """pos, mn, mx of every element place."""
    return _exploded(df, []).groupBy("pos").agg(F.min("x").alias("mn"), F.max("x").alias("mx"))


def collection_stats(df: DataFrame) -> DataFrame:
    """Rows, smallest and largest vid, and dimensions."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.min("vid").alias("min_vid"), F.max("vid").alias("max_vid"), F.min(F.size("vec")).alias("min_dim"), F.max(F.size("vec")).alias("max_dim"))
