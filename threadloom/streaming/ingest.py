"""Continuous ingestion of messages: an addition of this engine, with no counterpart in batch semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(messages: DataFrame, key: str = "message_id", time: str = "created_at", late: str = "1 hour") -> DataFrame:
    """A stream of messages without repeats of an id within the watermark."""
    return messages.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def volume(messages: DataFrame, time: str = "created_at", late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Messages by window and brand; windows are final once the watermark has passed them."""
    return messages.withWatermark(time, late).groupBy(F.window(time, width), "brand").agg(F.count("*").alias("messages"))
