"""Fetch outcomes as a stream: windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcomes_by_window(runs: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Runs per window and outcome; rows later than ``late`` behind the newest are left out of a stream."""
    return runs.withWatermark("started_at", late).groupBy(F.window("started_at", window).alias("w"), "outcome").agg(F.count("*").alias("runs")).select(F.col("w.start").alias("window_start"), "outcome", "runs")
