"""The crawl's seen set and completion as streams, and windowed event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, delay: str = "24 hours") -> DataFrame:
    """Addresses of an audit once within the delay; stream(audit_id, url, ts)."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["audit_id", "url"])


def progress(stream: DataFrame) -> DataFrame:
    """Running queued, finished and outstanding pages per audit; stream(audit_id, kind, url, ts). Output mode: update or complete."""
    n = stream.groupBy("audit_id").agg(F.count_if(F.col("kind") == "queued").alias("queued"), F.count_if(F.col("kind") == "finished").alias("finished"))
    return n.withColumn("outstanding", F.col("queued") - F.col("finished")).withColumn("complete", F.col("outstanding") <= 0)


def event_windows(stream: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events by type and window, with a watermark for late rows; an extension, as crawls have no event time."""
    each = stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return each.select(F.col("window.start").alias("window_start"), "event_type", "events", "total")
