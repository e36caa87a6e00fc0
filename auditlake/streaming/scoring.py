"""Streams of page files: each page once within the watermark, scored batch by batch; windowed event counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url as U


def first_visits(pages: DataFrame, ts: str, delay: str = "1 hour") -> DataFrame:
    """Pages whose visit key hasn't been seen within the watermark."""
    keyed = pages.withColumn("visit_key", U.visit_key(F.col("url")))
    return keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["visit_key"])


def score_batches(pages: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Scores every micro-batch and appends it to a Parquet table; a batch written twice overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def event_windows(events: DataFrame, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Events and their value by type and window; late rows past the delay are left out of a stream, none of a table."""
    own = events.withWatermark("ts", delay) if events.isStreaming else events
    by = own.groupBy(F.window("ts", width).alias("w"), "event_type")
    out = by.agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events", "total")
