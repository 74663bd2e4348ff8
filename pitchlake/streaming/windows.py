"""Event windows over streams: the same aggregates as in batch, on windows aligned to the epoch, with a watermark for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_windows(events: DataFrame, seconds: int, step: int, late: str = "10 minutes", time: str = "ts", by: str = "event_type") -> DataFrame:
    """start, end, ``by``, n_events and n_users per hopping window; a window closes when the watermark passes its end.

    Works on a batch table too. Unlike the batch segmentation, windows start at multiples of ``step`` since the epoch and
    not at a match's first event, which a stream can't know.
    """
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark(time, late)
    w = e.groupBy(F.window(time, f"{seconds} seconds", f"{step} seconds").alias("w"), by)
    return w.agg(F.count(F.lit(1)).alias("n_events"), F.approx_count_distinct("user_id").alias("n_users")).select("w.start", "w.end", by, "n_events", "n_users")
