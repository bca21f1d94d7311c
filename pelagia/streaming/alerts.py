"""Alerts on streams of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alerts(metrics: DataFrame, limits: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """start, key, n, mean, most and limit of each window of (ts, key, value) in which a value is over its key's limit.

    limits (key, limit) is a small table of the metrics that are watched; keys without a limit raise none, null values
    count as none. Works on a stream, with a watermark of `late`, and on a table."""
    watched = metrics.join(limits.select("key", F.col("limit").cast("double").alias("limit")), "key")
    made = watched.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "key", "limit")
    found = made.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most"))
    return found.where(F.col("most") > F.col("limit")).select(F.col("w.start").alias("start"), "key", "n", "mean", "most", "limit")
