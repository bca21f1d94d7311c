"""Lagrangian particles: drift through a field, random walk, boundaries, release schedules."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.functions.mathx import normal, speed
from pelagia.lineage import cut
from pelagia.operators.interp import Axes, blended, corners, located

M_PER_DEGREE = 111000.0


def _parts(parts: list[DataFrame]) -> DataFrame:
    """The rows of several tables with the same columns."""
    return reduce(DataFrame.unionByName, parts)


def drift(field: DataFrame, particles: DataFrame, axes: Axes, n_steps: int, hours: float = 3.0, depth_idx: int = 0, frozen: int | None = None, cut_every: int = 10) -> DataFrame:
    """Tracks of all particles at once: id, step, lon, lat, and u, v, speed at the start of the step that follows.

    Forward Euler; step n uses the field of time n (or `frozen`); land counts as still water. A particle stops before a
    step that would leave the extent, keeping its last position with the velocity that would have carried it out. Each
    step is one equi-join of the live particles with the cells' corner values. A particle's steps between two cuts are
    one row with an array, so these steps are computed and written once; earlier ones are never read again."""
    cells = corners(field.where(F.col("depth_idx") == depth_idx), ["water_u", "water_v"])
    cells = cut(cells, "corners") if n_steps > 4 else cells
    seconds = hours * 3600.0
    live = particles.select("id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    inside = lambda: F.col("lon").between(axes.lon0, axes.lon1) & F.col("lat").between(axes.lat0, axes.lat1)
    live, parts, last = live.withColumns({"on": F.lit(True), "seen": F.array().cast(SEEN)}), [], None
    for step in range(n_steps):
        t = step if frozen is None else frozen
        at = located(live, axes).join(cells.where(F.col("time_idx") == t).drop("time_idx", "depth_idx"), ["j", "i"], "left")
        at = at.select("id", "lon", "lat", "on", "seen", F.coalesce(blended("water_u"), F.lit(0.0)).alias("u"), F.coalesce(blended("water_v"), F.lit(0.0)).alias("v"))
        here = F.struct(F.lit(step).alias("step"), "lon", "lat", "u", "v", speed(F.col("u"), F.col("v")).alias("speed"))
        new_lon = F.col("lon") + F.col("u") * seconds / (M_PER_DEGREE * F.cos(F.radians("lat")))
        new_lat = F.col("lat") + F.col("v") * seconds / M_PER_DEGREE
        seen = F.when(F.col("on"), F.concat("seen", F.array(here))).otherwise(F.col("seen"))
        moved = at.select("id", F.when(F.col("on"), new_lon).otherwise(F.col("lon")).alias("lon"), F.when(F.col("on"), new_lat).otherwise(F.col("lat")).alias("lat"), "on", seen.alias("seen"))
        live = moved.withColumn("on", F.col("on") & inside())
        if (step + 1) % cut_every == 0 or step + 1 == n_steps:
            last = cut(live, "track")
            parts.append(last.select("id", F.explode("seen").alias("s")).select("id", "s.*"))
            live = last.where("on").select("id", "lon", "lat", "on", F.array().cast(SEEN).alias("seen"))
    end = live.select("id", F.lit(n_steps).alias("step"), "lon", "lat", *(F.lit(None).cast("double").alias(c) for c in ("u", "v", "speed")))
    return _parts([*parts, end])


#: What drift() notes of a particle at each step.
SEEN = "array<struct<step:int,lon:double,lat:double,u:double,v:double,speed:double>>"


def drift_rk4(field: DataFrame, particles: DataFrame, axes: Axes, n_steps: int, hours: float = 3.0, depth_idx: int = 0) -> DataFrame:
    """Tracks id, step, lon, lat by the classical Runge-Kutta step; step n uses the field of time n throughout.

    Land and what lies outside the extent count as still water at the stages between. A particle stops before a step
    that would leave the extent. Each stage is one equi-join of the live particles with the cells' corner values. A
    step's positions are written once: they are the track's rows of that step and what the next one starts from."""
    cells = cut(corners(field.where(F.col("depth_idx") == depth_idx), ["water_u", "water_v"]), "corners")
    seconds = hours * 3600.0
    live = particles.select("id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    track = [live.select("id", F.lit(0).alias("step"), "lon", "lat")]
    for step in range(n_steps):
        now = cells.where(F.col("time_idx") == step).drop("time_idx", "depth_idx")
        at = live.withColumns({"_lon": F.col("lon"), "_lat": F.col("lat")})
        kept = ["id", "lon", "lat"]
        for stage, reach in enumerate((0.5, 0.5, 1.0, 0.0)):
            seen = located(at, axes, "_lon", "_lat").join(now, ["j", "i"], "left")
            seen = seen.withColumn(f"a{stage}", F.coalesce(blended("water_u"), F.lit(0.0)) / (M_PER_DEGREE * F.cos(F.radians("_lat"))))
            seen = seen.withColumn(f"b{stage}", F.coalesce(blended("water_v"), F.lit(0.0)) / M_PER_DEGREE)
            kept += [f"a{stage}", f"b{stage}"]
            at = seen.select(*kept, (F.col("lon") + reach * seconds * F.col(f"a{stage}")).alias("_lon"), (F.col("lat") + reach * seconds * F.col(f"b{stage}")).alias("_lat"))
        mean = lambda k: (F.col(f"{k}0") + 2 * F.col(f"{k}1") + 2 * F.col(f"{k}2") + F.col(f"{k}3")) * (seconds / 6)
        live = at.select("id", (F.col("lon") + mean("a")).alias("lon"), (F.col("lat") + mean("b")).alias("lat"))
        live = cut(live.where(F.col("lon").between(axes.lon0, axes.lon1) & F.col("lat").between(axes.lat0, axes.lat1)), "track")
        track.append(live.select("id", F.lit(step + 1).alias("step"), "lon", "lat"))
    return _parts(track)


def release(schedule: DataFrame, hours: float) -> DataFrame:
    """Particles of release events (event_id, time_hours, lon, lat): id and the step at which each starts."""
    return schedule.select(F.concat_ws("-", "event_id", F.row_number().over(_by_event())).alias("id"), F.round(F.col("time_hours") / hours).cast("int").alias("first_step"), "lon", "lat")


def _by_event():
    from pyspark.sql import Window

    return Window.partitionBy("event_id").orderBy("lon", "lat")


def random_walk(df: DataFrame, columns: list[str], diffusivity: float, dt: float, seed: int = 1, step: int = 0, id_col: str = "id") -> DataFrame:
    """Each coordinate moved by a normal step of variance 2·D·dt, hashed from the particle, the step and the seed."""
    sigma = math.sqrt(2 * diffusivity * dt)
    return df.withColumns({c: F.col(c) + normal(id_col, F.lit(step), F.lit(seed), F.lit(k)) * sigma for k, c in enumerate(columns)})


def bounded(df: DataFrame, box: dict[str, tuple[float, float]], periodic: bool) -> DataFrame:
    """Coordinates wrapped into the box, or `active` false outside it."""
    if periodic:
        return df.withColumns({c: F.pmod(F.col(c) - lo, F.lit(hi - lo)) + lo for c, (lo, hi) in box.items()})
    inside = F.lit(True)
    for c, (lo, hi) in box.items():
        inside = inside & F.col(c).between(lo, hi)
    return df.withColumn("active", inside & (F.col("active") if "active" in df.columns else F.lit(True)))


def rotate_rk4(particles: DataFrame, omega: float, dt: float, n_steps: int, centre: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Solid-body rotation by the classical Runge-Kutta step, all steps as one Column expression for each step."""
    df = particles
    for _ in range(n_steps):
        x, y = F.col("x") - centre[0], F.col("y") - centre[1]
        k = [(-omega * y, omega * x)]
        for h in (0.5, 0.5, 1.0):
            a, b = k[-1]
            k.append((-omega * (y + h * dt * b), omega * (x + h * dt * a)))
        step = lambda m: (k[0][m] + 2 * k[1][m] + 2 * k[2][m] + k[3][m]) * (dt / 6)  # noqa: B023, E731
        df = df.select("id", (F.col("x") + step(0)).alias("x"), (F.col("y") + step(1)).alias("y"))
    return df


def validate(points: DataFrame, cells: DataFrame, axes: Axes) -> DataFrame:
    """points with `inside` (the extent) and `wet` (the cell they fall in has a current, at the point's time_idx if it has one)."""
    placed = located(points, axes)
    by = [*(["time_idx"] if "time_idx" in points.columns else []), "j", "i"]
    wet = cells.where("water_u IS NOT NULL AND water_v IS NOT NULL").select(*by, F.lit(True).alias("_wet")).distinct()
    got = placed.join(wet, by, "left")
    return got.select(*points.columns, F.col("i").isNotNull().alias("inside"), F.coalesce("_wet", F.lit(False)).alias("wet"))


def sample_wet(cells: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n wet cells without replacement, the same ones on every run."""
    wet = cells.where("water_u IS NOT NULL AND water_v IS NOT NULL").select("j", "i", "lat", "lon").distinct()
    return wet.orderBy(F.xxhash64("j", "i", F.lit(seed)), "j", "i").limit(n)
