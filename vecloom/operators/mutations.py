"""Row mutations and point access as DataFrame transforms; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.operators.filters import Filter, to_column
from vecloom.plans.config import InvalidParameter


def numbered(df: DataFrame, order: list[str | Column], to: str, first: int) -> DataFrame:
    """Dense numbers from `first` on in the given order, without gathering all rows in one task.

    Rows are range-partitioned and sorted; each partition numbers its own rows
    and starts after the rows of the partitions before it.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id())
    counts = ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__row").alias("__low"))
    # a row for each partition
    start = counts.withColumn("__before", F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return ordered.join(F.broadcast(start), "__part").withColumn(to, F.col("__row") - F.col("__low") + F.col("__before") + first).drop("__part", "__row", "__low", "__before")


def insert(rows: DataFrame, new: DataFrame, next_vid: int, order: list[str | Column]) -> DataFrame:
    """rows with `new` (without vid) appended under vids from next_vid on, in the given order."""
    return rows.unionByName(numbered(new, order, "vid", next_vid), allowMissingColumns=True)


def upsert(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors of `new` (vid, vec and optionally metadata) replace those of equal vid; other rows are added.

    Metadata of an existing row stays where `new` has none.
    """
    names = [c for c in rows.columns if c != "vid"]
    n = new.select("vid", *[F.col(c).alias(f"__{c}") for c in names if c in new.columns])
    picked = [F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in new.columns else F.col(c) for c in names]
    return rows.join(n, "vid", "full_outer").select("vid", *picked)


def delete(rows: DataFrame, vids: DataFrame) -> DataFrame:
    return rows.join(vids.select("vid"), "vid", "left_anti")


def delete_by_filter(rows: DataFrame, where: Filter | Column | None) -> DataFrame:
    """Without a filter every row goes."""
    return rows.limit(0) if where is None else rows.filter(~to_column(where, rows.schema))


def get(rows: DataFrame, vid: int) -> DataFrame:
    return rows.filter(F.col("vid") == vid)


def get_batch(rows: DataFrame, vids: DataFrame) -> DataFrame:
    """Rows of the ids (pos, vid) that exist, with their position."""
    return vids.select("pos", "vid").join(rows, "vid")


def set_meta(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Metadata of the vids in `meta` is replaced as a whole: columns it lacks become null."""
    names = [c for c in rows.columns if c not in ("vid", "vec")]
    m = meta.select("vid", *[(F.col(c) if c in meta.columns else F.lit(None)).alias(f"__{c}") for c in names], F.lit(True).alias("__hit"))
    kept = [F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in names]
    return rows.join(m, "vid", "left").select("vid", "vec", *kept)


def delete_meta_field(rows: DataFrame, name: str) -> DataFrame:
    if name in ("vid", "vec"):
        raise InvalidParameter(name)
    return rows.drop(name)


def iterate(rows: DataFrame, where: Filter | Column | None = None, order: str = "vid"):
    """Rows one after another on the driver, a partition at a time."""
    return rows.filter(to_column(where, rows.schema)).orderBy(order).toLocalIterator()


def foreach(rows: DataFrame, visit, where: Filter | Column | None = None) -> int:
    """Calls visit(row) until it returns False; counts the rows before that one."""
    n = 0
    for row in iterate(rows, where):
        if visit(row) is False:
            break
        n += 1
    return n
