"""Structured Streaming forms of the windowed counters and of late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame, most: int, late: str = "2 hours") -> DataFrame:
    """Tumbling one-hour counts per user, and whether they stay within the limit; state is dropped after the watermark."""
    w = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("w.start").alias("hour"), "n", (F.col("n") <= most).alias("allowed"))


def distinct_hits(events: DataFrame, key: str = "event_id", late: str = "3 days") -> DataFrame:
    """Each hit once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def each_batch(stream: DataFrame, key: str, order: str, handle, checkpoint: str):
    """Hand the newest row of each key of every micro-batch to handle(batch, batch_id)."""

    def run(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        handle(newest, batch_id)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
