"""Connected components of an edge table by alternating star contraction.

Each round hangs the larger neighbours of every node on its smallest neighbour
(large star), then the smaller ones likewise (small star). Both are joins with
combinable minimum aggregates. Rounds grow with the logarithm of a chain's length;
they end when every node is either smaller than all its neighbours or has one only.
A node's edges are dealt to SALTS parts by the other end. Its minimum is combined
before the shuffle, goes back to the parts that the node has, and only these meet
the edges: no task gets all edges of a hub, and what is copied for the parts is never
more than the edges. A round's tables are deleted after the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import drop_stored, stored

#: Parts that the edges of one node are dealt to (bits of a long tell which it has).
SALTS = 64


def _near(edges: DataFrame, large: bool) -> DataFrame:
    """a, b, part: each node with its neighbours, or only with its smaller ones."""
    if large:
        near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return near.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))


def _lowest(near: DataFrame) -> DataFrame:
    """a, low (its smallest neighbour), high (its largest one), parts (those that it has, as bits)."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("part"))
    return near.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.bit_or(bit).alias("parts"))


def _hung(near: DataFrame, lowest: DataFrame) -> DataFrame:
    """near with low: the smallest of a and its neighbours."""
    has = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.call_function("shiftright", F.col("parts"), k).bitwiseAND(F.lit(1)) == 1)
    low = lowest.select("a", F.least("a", "low").alias("low"), F.explode(has).alias("part"))
    return near.join(low.hint("merge"), ["a", "part"])


def _contracted(edges: DataFrame, lowest: DataFrame) -> DataFrame:
    """The edges after a large star, by its minima, and a small star."""
    edges = _hung(_near(edges, large=True), lowest).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    near = _near(edges, large=False)
    lowest = _lowest(near)
    hung = _hung(near, lowest).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return hung.union(lowest.select("a", F.col("low").alias("b"))).filter("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """edges (a, b), long: node, component (its smallest reachable node); only nodes with edges to others."""
    edges = stored(edges.filter("a <> b").select("a", "b").distinct())
    for _ in range(rounds):
        lowest = stored(_lowest(_near(edges, large=True)))
        # a star's centre is below its neighbours, its other nodes have no neighbour but the centre
        if lowest.filter("low < a and low < high").isEmpty():
            found = stored(lowest.filter("low < a").select(F.col("a").alias("node"), F.col("low").alias("component")), lowest)
            drop_stored(edges)
            return found
        edges = stored(_contracted(edges, lowest), edges)
        drop_stored(lowest)
    drop_stored(edges)
    raise RuntimeError("components did not settle")
