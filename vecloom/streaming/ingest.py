"""Streaming extensions: micro-batch upserts into a collection, and search of a stream against stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecloom.functions import vectors as V
from vecloom.sources.store import Collection


def upsert_stream(stream: DataFrame, collection: Collection, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Upserts every micro-batch (vid, vec, metadata). A batch that is run again writes the same rows."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            collection.upsert_batch(batch)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def within_radius(stream: DataFrame, rows: DataFrame, key: str, radius: float, metric: str = "l2") -> DataFrame:
    """Stream rows (query_id, qvec, key) with the stored rows (vid, vec, key) of equal key within radius.

    The key (a list_id, a tenant) keeps this an equi-join.
    """
    return stream.join(rows.select("vid", "vec", key), key).withColumn("distance", V.distance(metric, "qvec", "vec")).filter(F.col("distance") <= radius).select("query_id", "vid", "distance")


def windowed_counts(stream: DataFrame, ts: str, by: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Arrivals by event-time window and key, late rows within the watermark included."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count(F.lit(1)).alias("n"))
