"""Streams: operators on single rows run on them as they are; repeats are dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import context_fingerprint


def drop_repeats(stream: DataFrame, event_time: str, delay: str, text: str = "text") -> DataFrame:
    """A stream without rows whose text, normalized, came before, as long as the watermark remembers it. State is bounded
    by the delay: a repeat that comes later passes."""
    keyed = stream.withColumn("__fp", context_fingerprint(F.col(text)))
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["__fp"]).drop("__fp")
