"""Recency counts and trend scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recency(assignments: DataFrame, topics: DataFrame, as_of: str) -> DataFrame:
    """(section, cluster_id, cnt_7d, cnt_30d). Both windows are closed below and open above; a group of old posts has 0."""
    now = F.to_timestamp(F.lit(as_of))
    rows = assignments.join(topics.select(F.col("id").alias("topic_id"), "created_at"), "topic_id")
    within = lambda days: F.count_if(F.col("created_at") >= now - F.expr(f"INTERVAL '{days}' DAY"))
    return rows.groupBy("section", "cluster_id").agg(within(7).alias("cnt_7d"), within(30).alias("cnt_30d"))


def trend_formula(total: Column, week: Column, month: Column) -> Column:
    capped = lambda x, over: F.least(F.log10(1 + x) / over, F.lit(1.0))
    return capped(total, 10) * 0.7 + capped(week, 1) * 0.2 + capped(month, 1) * 0.1


def trend(popularity: DataFrame, recent: DataFrame) -> DataFrame:
    """Popularity drives: clusters without it are absent, missing recency counts as 0."""
    rows = popularity.select("section", "cluster_id", "total_count_30d").join(recent, ["section", "cluster_id"], "left").fillna(0, ["cnt_7d", "cnt_30d"])
    score = trend_formula(F.coalesce("total_count_30d", F.lit(0)), F.col("cnt_7d"), F.col("cnt_30d"))
    return rows.withColumn("trend_score", score)
