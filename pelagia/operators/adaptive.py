"""Particles that each choose their own time step, until all have arrived at the end time.

A trial step of all particles that are still on their way is two lookups, each one equi-join with the cells' corner
values. A round makes a few trials; then who has arrived is written apart and not read again, and the table of the
round before goes. So a run's disk is two states and the result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.lineage import cut, discard
from pelagia.operators.interp import Axes, blended, located

#: A failed step is halved, one with under a tenth of the tolerance lets the next grow by half.
SHRINK, GROW, EASY = 0.5, 1.5, 0.1
#: The least and the largest step, as shares of the first one.
LEAST, MOST = 0.01, 2.0


def _velocity(d: DataFrame, cells: DataFrame, axes: Axes, lon: str, lat: str, name: str) -> DataFrame:
    """d with <name>u and <name>v at lon, lat and d's time_idx; still water on land and outside the extent."""
    own = [c for c in d.columns if c not in ("j", "i")]
    seen = located(d, axes, lon, lat).join(cells, ["time_idx", "j", "i"], "left")
    return seen.select(*own, F.coalesce(blended("water_u"), F.lit(0.0)).alias(f"{name}u"), F.coalesce(blended("water_v"), F.lit(0.0)).alias(f"{name}v"))


def trial(live: DataFrame, cells: DataFrame, axes: Axes, end: float, tolerance: float, least: float, most: float, interval: float | None = None) -> DataFrame:
    """One trial step of each particle: id, time_idx, lon, lat, t, dt, n_steps, n_tried and its last accepted error.

    A Euler step is compared with two half steps, whose end is kept. An error over the tolerance halves dt and leaves the
    particle where it is, unless dt is already the least; a very small one lets dt grow, up to the largest step. The last
    step ends at `end` exactly; who has arrived stays as it is. With `interval`, time_idx follows the time."""
    step, on = F.least(F.col("dt"), end - F.col("t")), F.col("t") < end
    d = live.withColumn("_h", step)
    if interval is not None:
        d = d.withColumn("time_idx", F.floor(F.col("t") / interval).cast("int"))
    d = _velocity(d, cells, axes, "lon", "lat", "_a")
    half = F.col("_h") / 2
    d = d.withColumns({"_lon": F.col("lon") + F.col("_au") * half, "_lat": F.col("lat") + F.col("_av") * half})
    d = _velocity(d, cells, axes, "_lon", "_lat", "_b")
    x, y = F.col("_lon") + F.col("_bu") * half, F.col("_lat") + F.col("_bv") * half
    dx, dy = x - F.col("lon") - F.col("_au") * F.col("_h"), y - F.col("lat") - F.col("_av") * F.col("_h")
    d = d.withColumns({"_x": x, "_y": y, "_e": F.sqrt(dx * dx + dy * dy)})
    taken = (F.col("_e") <= tolerance) | (F.col("_h") <= least)
    pick = lambda new, old: F.when(taken, new).otherwise(old)
    grown = F.when(F.col("_e") < tolerance * EASY, F.least(F.col("dt") * GROW, F.lit(most))).otherwise(F.col("dt"))
    arrives = F.when(F.col("_h") == end - F.col("t"), F.lit(end)).otherwise(F.col("t") + F.col("_h"))
    return d.select(
        "id", "time_idx", pick(F.col("_x"), F.col("lon")).alias("lon"), pick(F.col("_y"), F.col("lat")).alias("lat"), pick(arrives, F.col("t")).alias("t"),
        pick(grown, F.greatest(F.col("_h") * SHRINK, F.lit(least))).alias("dt"), (F.col("n_steps") + (taken & on).cast("int")).alias("n_steps"), (F.col("n_tried") + on.cast("int")).alias("n_tried"),
        pick(F.greatest("error", "_e"), F.col("error")).alias("error"),
    )


def rounds_bound(end: float, dt: float) -> int:
    """Trials after which every particle has arrived: each accepted step has the least size at least, but for the last.

    A failed trial halves dt, and only accepted steps let it grow again, by GROW each: so failures are at most the
    accepted steps times log(GROW) / log(1 / SHRINK), and those that lead down from the largest step to the least."""
    accepted = math.ceil(end / (dt * LEAST)) + 1
    return accepted + math.ceil(accepted * math.log(GROW) / -math.log(SHRINK)) + math.ceil(math.log2(MOST / LEAST)) + 1


def to_end(particles: DataFrame, cells: DataFrame, axes: Axes, end: float, dt: float, tolerance: float, interval: float | None = None, trials: int = 3) -> DataFrame:
    """Every particle at time `end`: id, time_idx, lon, lat, n_steps, n_tried and error, the largest of its accepted steps.

    particles: id, lon, lat, and time_idx, the field that carries it, unless `interval` says how long each field holds.
    cells: corners() of one depth, of velocities in degrees a unit of time. dt is the first step, a hundredth of it the
    least and twice it the largest. A step at the least size is taken whatever its error, so `error` may exceed the
    tolerance only for such steps; no particle is dropped. All have arrived after rounds_bound() trials, of
    which `trials` are made between two tables."""
    if end <= 0:
        raise ValueError("end must be positive")
    held = cut(cells.drop("depth_idx"), "corners")
    start = particles.withColumn("time_idx", F.lit(0)) if interval is not None else particles
    live = start.select("id", "time_idx", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), F.lit(0.0).alias("t"), F.lit(float(dt)).alias("dt"), F.lit(0).alias("n_steps"), F.lit(0).alias("n_tried"), F.lit(0.0).alias("error"))
    done: list[DataFrame] = []
    written: DataFrame | None = None
    for _ in range(math.ceil(rounds_bound(end, dt) / trials)):
        for _ in range(trials):
            live = trial(live, held, axes, end, tolerance, dt * LEAST, dt * MOST, interval)
        now = cut(live, "adaptive")
        if written is not None:
            discard(written)
        arrived, live, written = now.where(F.col("t") >= end), now.where(F.col("t") < end), now
        part = cut(arrived.drop("t", "dt"), "arrived")
        done.append(part)
        if not live.take(1):
            break
    discard(written, held)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
