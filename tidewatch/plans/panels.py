"""Dashboard panels: report functions composed with the panel's time range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.filters import time_filter


def malicious_stats_panel(stats: DataFrame, start: Column, end: Column) -> DataFrame:
    """The all-time row, shown only if its last scan lies in the range.

    The range gates the finished aggregate; it must not select scans.
    """
    return time_filter(stats, "last_scan", start, end).select(
        "total_scans", "total_malicious_scans", "malicious_percentage")


def daily_trend_panel(trends: DataFrame, start: Column, end: Column) -> DataFrame:
    """Bars per day, oldest first. A day counts as its midnight, so a first partial day falls out."""
    at_midnight = F.col("scan_date").cast("timestamp_ntz").between(start, end)
    return (trends.filter(at_midnight)
            .select("time_sec", "total_scans_per_day", "total_positives_per_day").orderBy("time_sec"))


def hourly_panel(hourly: DataFrame, start: Column, end: Column) -> DataFrame:
    """Bars per hour, oldest first, by the hour's last query."""
    return (time_filter(hourly, "raw_time", start, end)
            .select("time_sec", F.col("total_queries").alias("total_dns_new_queries_per_hour"))
            .orderBy("time_sec"))
