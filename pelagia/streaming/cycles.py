"""Cycles of forecast and observation on streams: observations join the forecast of their cycle, late ones are left out,
and each key's cycles are worked off in order, whether or not an observation came."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: One row for each key and cycle: the forecast carried from the cycle before, the analysis, and the observations used.
ANALYSED = "key string, cycle timestamp, forecast double, analysis double, variance double, n_obs long"
HELD = "pending string, mean double, variance double, last long"


def joined(forecasts: DataFrame, observations: DataFrame, cycle: str, late: str) -> DataFrame:
    """key, cycle, drift, noise, y, r: each forecast with every observation of its cycle, or with none.

    forecasts: key, ts (the cycle's start), drift and noise, what the model adds to the state and to its variance.
    observations: key, ts, y, r (error variance). Both streams have a watermark of `late`, so the join keeps rows only as
    long as a partner may come; a forecast without one is given when no observation of its cycle can come any more."""
    f = forecasts.withWatermark("ts", late).select(F.col("key").alias("f_key"), F.col("ts").alias("cycle"), "drift", "noise")
    o = observations.withWatermark("ts", late).select("key", "ts", "y", "r")
    meets = (F.col("f_key") == F.col("key")) & (F.col("ts") >= F.col("cycle")) & (F.col("ts") < F.col("cycle") + F.expr(f"INTERVAL {cycle}"))
    return f.join(o, meets, "leftOuter").select(F.col("f_key").alias("key"), "cycle", "drift", "noise", "y", "r")


def stepped(mean: float, variance: float, drift: float, noise: float, seen: list[tuple[float, float]]) -> tuple[float, float, float]:
    """(forecast, analysis, variance) of one cycle: the model's step, then all observations weighed by their precision."""
    forecast, variance = mean + drift, variance + noise
    precision = 1 / variance + sum(1 / r for _, r in seen)
    analysis = (forecast / variance + sum(y / r for y, r in seen)) / precision
    return forecast, analysis, 1 / precision


def cycled(rows: DataFrame, start: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """The analysis of every cycle of each key, from joined() rows of a stream, as ANALYSED.

    A key's state holds the cycles that may still get an observation, and the last analysis. A timer at the watermark
    closes cycles in their order; the state is the size of one key's open cycles, not of its history. Rows of a cycle
    that is closed already are left out."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, mean, variance, last = state.get if state.exists else ("{}", *start, -(1 << 62))
        open_: dict[str, list] = json.loads(pending)
        for b in batches:
            for r in b.itertuples():
                at = r.cycle.value // 1000
                if at > last:
                    held = open_.setdefault(str(at), [r.drift, r.noise, []])
                    if not pd.isna(r.y):
                        held[2].append([r.y, r.r])
        mark = state.getCurrentWatermarkMs() * 1000
        out = []
        for at in sorted(map(int, open_)):
            if at >= mark:
                break
            drift, noise, seen = open_.pop(str(at))
            forecast, mean, variance = stepped(mean, variance, drift, noise, sorted(map(tuple, seen)))
            last = at
            out.append((key[0], pd.Timestamp(at, unit="us"), forecast, mean, variance, len(seen)))
        if open_ or out or not state.hasTimedOut:
            state.update((json.dumps(open_), mean, variance, last))
        if open_:
            state.setTimeoutTimestamp(max(min(map(int, open_)) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "cycle", "forecast", "analysis", "variance", "n_obs"])

    return rows.groupBy("key").applyInPandasWithState(advance, ANALYSED, HELD, "append", GroupStateTimeout.EventTimeTimeout)


def in_batch(rows: DataFrame, start: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """The same from a table of joined() rows: each key's cycles in order, in one fold over them."""
    cycles = rows.groupBy("key", "cycle").agg(F.first("drift").alias("drift"), F.first("noise").alias("noise"), F.sum(1 / F.col("r")).alias("p"), F.sum(F.col("y") / F.col("r")).alias("q"), F.count("y").alias("n_obs"))
    ordered = cycles.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("cycle", "drift", "noise", "p", "q", "n_obs"))).alias("c"))
    state = "struct<cycle:timestamp,forecast:double,analysis:double,variance:double,n_obs:bigint>"
    none = F.array().cast(f"array<{state}>")

    def step(done, c):
        before = F.element_at(done, -1)
        mean, variance = (F.when(F.size(done) > 0, before[k]).otherwise(F.lit(v)) for k, v in (("analysis", start[0]), ("variance", start[1])))
        forecast, spread = mean + c["drift"], variance + c["noise"]
        precision = 1 / spread + F.coalesce(c["p"], F.lit(0.0))
        analysis = (forecast / spread + F.coalesce(c["q"], F.lit(0.0))) / precision
        now = F.struct(c["cycle"].alias("cycle"), forecast.alias("forecast"), analysis.alias("analysis"), (1 / precision).alias("variance"), c["n_obs"].alias("n_obs"))
        return F.concat(done, F.array(now.cast(state)))

    made = ordered.select("key", F.explode(F.aggregate("c", none, step)).alias("s"))
    return made.select("key", "s.*")
