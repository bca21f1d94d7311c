"""Streaming variants: windowed statistics with late data, quality flags on arrival, a filter state per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pelagia.operators.qc import BAD, GOOD, MISSING


def windowed_statistics(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """start, key, n, mean, population std, min and max of (ts, key, value) by event-time windows, with a watermark."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    made = stream.withWatermark("ts", late).groupBy(w.alias("w"), "key")
    stats = made.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return stats.select(F.col("w.start").alias("start"), "key", "n", "mean", "std", "min", "max")


def flagged(stream: DataFrame, limits: tuple[float, float]) -> DataFrame:
    """Each row with the flag that needs no other row: missing, outside the limits, or good."""
    v = F.col("value")
    return stream.withColumn("flag", F.when(v.isNull(), MISSING).when(~v.between(*limits), BAD).otherwise(GOOD))


def assimilated(stream: DataFrame, first_variance: float, model_variance: float, observation_variance: float) -> DataFrame:
    """key, n, mean and variance of a scalar Kalman filter whose state is kept between micro-batches, one row a batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, variance = state.get if state.exists else (0, 0.0, first_variance)
        for frame in frames:
            for y in frame.sort_values("ts")["value"].dropna():
                variance += model_variance
                gain = variance / (variance + observation_variance)
                mean, variance, n = mean + gain * (y - mean), (1 - gain) * variance, n + 1
        state.update((n, float(mean), float(variance)))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "mean": [float(mean)], "variance": [float(variance)]})

    kept = stream.select("key", "ts", "value").groupBy("key")
    return kept.applyInPandasWithState(step, "key string, n long, mean double, variance double", "n long, mean double, variance double", "update", GroupStateTimeout.NoTimeout)


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 minute"):
    """Start a query that hands every micro-batch to a function, on a trigger, with a checkpoint."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
