"""Event-time windows over request and token logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rate_breaches(
    events: DataFrame, key: str, at: str, limit: int = 60, seconds: int = 60, late: str = "10 minutes"
) -> DataFrame:
    """Keys with more than ``limit`` requests in a fixed window; works on streams and tables alike.

    Windows start at multiples of their length.
    """
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return (
        rows.groupBy(F.window(at, f"{seconds} seconds"), key)
        .agg(F.count("*").alias("requests"))
        .filter(F.col("requests") > limit)
        .select(key, F.col("window.start").alias("window_start"), "requests")
    )


def daily_usage(log: DataFrame, late: str = "1 day") -> DataFrame:
    """Tokens and cost per day; rows later than ``late`` are left to a batch rerun."""
    rows = log.withWatermark("created_at", late) if log.isStreaming else log
    return (
        rows.groupBy(F.window("created_at", "1 day"))
        .agg(F.sum("total_tokens").alias("total_tokens"), F.sum("estimated_cost_usd").alias("cost_usd"), F.count("*").alias("calls"))
        .select(F.to_date("window.start").alias("date"), "total_tokens", "cost_usd", "calls")
    )
