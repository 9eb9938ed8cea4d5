"""Watermarked streaming aggregates and duplicate removal on Spark's own state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_event_time(stream: DataFrame, ts: str = "creation_date_time", lateness: str = "10 minutes") -> DataFrame:
    """Adds `event_time` (an instant, UTC) and its watermark."""
    return stream.withColumn("event_time", F.to_timestamp(ts)).withWatermark("event_time", lateness)


def deduplicated(stream: DataFrame, key: str = "transaction_id", **kw) -> DataFrame:
    """Drops redelivered events; ids are remembered for as long as the watermark allows."""
    return with_event_time(stream, **kw).dropDuplicatesWithinWatermark([key])


def windowed_rate(stream: DataFrame, keys: list[str] | None = None, window: str = "1 minute", slide: str | None = None,
                  **aggs: Column) -> DataFrame:
    """Events (and further aggregates) per window and label; needs `with_event_time` before."""
    span = F.window("event_time", window, slide) if slide else F.window("event_time", window)
    out = stream.groupBy(span.alias("window"), *(keys or [])).agg(
        F.count("*").alias("events"), *[a.alias(n) for n, a in aggs.items()])
    return out.select(F.col("window.start").alias("window_start"), *(keys or []), "events", *aggs)
