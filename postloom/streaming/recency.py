"""Recency counts over arriving posts, by watermark and sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_counts(posts: DataFrame, late: str = "2 days", length: str = "7 days", slide: str = "1 day") -> DataFrame:
    """(window, section, n) of a stream or table of posts; posts later than ``late`` are dropped from a stream, and a
    repeated post (same hash) inside the watermark counts once."""
    rows = posts.withWatermark("created_at", late)
    rows = rows.dropDuplicatesWithinWatermark(["hash"]) if posts.isStreaming else rows.dropDuplicates(["hash"])
    return rows.groupBy(F.window("created_at", length, slide), F.coalesce("section", F.lit("")).alias("section")).agg(F.count("*").alias("n"))
