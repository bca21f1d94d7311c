"""Models put together from single steps: 3-D dispersion, sub-stepped dispersion, flow with particles and a tracer."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.functions.mathx import speed
from pelagia.lineage import cut, discard
from pelagia.operators.flow import barotropic_step
from pelagia.operators.interp import Axes, blended, corners, located
from pelagia.operators.particles import M_PER_DEGREE
from pelagia.operators.stencil import along_x, along_y, gaussian_weights, smooth_axis
from pelagia.operators.transport import add_sources, dispersion_step, upwind

#: The share of a cell that a sub-step may cross, and metres in a degree for grids in degrees.
CFL = 0.3
DEGREE = 111320.0


def advected(df: DataFrame, dt: float, dx: float, dy: float) -> DataFrame:
    """c after one upwind step along x and y of every layer; a cell on an axis's border is not moved along that axis."""
    inner = lambda w, rate: F.when(F.lag(F.lit(1)).over(w).isNotNull() & F.lead(F.lit(1)).over(w).isNotNull(), rate).otherwise(0.0)
    still = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    d = df.withColumn("_x", inner(along_x(), upwind(along_x(), "c", still("water_u"), dx)))
    d = d.withColumn("_y", inner(along_y(), upwind(along_y(), "c", still("water_v"), dy)))
    return d.withColumn("c", F.col("c") - dt * (F.col("_x") + F.col("_y"))).select(*df.columns)


def dispersion_3d_step(df: DataFrame, dt: float, dx: float, dy: float, shape: tuple[int, int, int], horizontal: float, vertical: float, sources: DataFrame | None = None, t: float = 0.0, decay: float = 0.0) -> DataFrame:
    """A step of a tracer in layers: upwind advection, Gaussian spread, sources, decay.

    The spread's standard deviation is sqrt(2·D·dt) cells, in each layer with `horizontal` and across layers with
    `vertical`. sources: depth_idx, j, i, intensity, t_start, t_end. shape: cells along x and y, and layers."""
    d = advected(df, dt, dx, dy)
    flat, deep = (gaussian_weights(math.sqrt(2 * k * dt)) for k in (horizontal, vertical))
    for axis, n, w in (("i", shape[0], flat), ("j", shape[1], flat), ("depth_idx", shape[2], deep)):
        d = smooth_axis(d, "c", axis, n, w) if len(w) > 1 else d
    if sources is not None:
        live = sources.where(F.lit(t).between(F.col("t_start"), F.col("t_end")))
        added = live.groupBy("depth_idx", "j", "i").agg((F.sum("intensity") * dt).alias("_add"))
        d = d.join(added, ["depth_idx", "j", "i"], "left").withColumn("c", F.col("c") + F.coalesce("_add", F.lit(0.0)))
    return d.withColumn("c", F.col("c") * math.exp(-decay * dt)).select(*df.columns)


def sub_steps(df: DataFrame, dt: float, dx: float, limit: float = CFL) -> int:
    """How many equal steps dt needs so that the fastest component crosses at most `limit` of a cell in each."""
    fastest = df.agg(F.max(F.greatest(F.abs("water_u"), F.abs("water_v")))).first()[0]
    return max(1, math.ceil(dt * max(fastest or 0.0, 1e-10) / (limit * dx)))


def dispersed(df: DataFrame, dt: float, dx: float, n_x: int, n_y: int, diffusivity: float = 500.0, decay: float = 5e-5, cut_every: int = 4) -> DataFrame:
    """dispersion_step() in as many sub-steps as the flow asks for; lineage is cut every few of them."""
    n, held = sub_steps(df, dt, dx), None
    for k in range(n):
        df = dispersion_step(df, dt / n, dx, n_x, n_y, diffusivity, decay)
        if (k + 1) % cut_every == 0 and k + 1 < n:
            df = cut(df, "dispersed")
            if held is not None:
                discard(held)
            held = df
    return df


def coupled(state: DataFrame, particles: DataFrame, axes: Axes, n_steps: int, dt: float, dx: float, coriolis: float, diffusivity: float = 500.0, decay: float = 5e-5, sources: DataFrame | None = None, every: int = 1) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """(step, state, particles) of every `every`-th step and the last: flow, then particles in it, then the tracer in it.

    state: time_idx, depth_idx, j, i, u, v, eta, c of one depth; particles: id, lon, lat and time_idx, the run that carries
    them, which may be left out where the state has one time only. Runs of different times do not touch each other. A
    particle whose step would leave the extent stays where it is. Each step is written, so lineage does not grow, and
    goes when the next one is, unless it was given away."""
    own = [c for c in ("id", "time_idx") if c in particles.columns]
    keys = [*own[1:], "j", "i"]
    made: list[DataFrame] = []
    for k in range(n_steps):
        state = barotropic_step(state, dt, dx, dx, coriolis)
        flow = state.withColumns({"water_u": F.col("u"), "water_v": F.col("v")})
        at = located(particles, axes).join(corners(flow, ["water_u", "water_v"]), keys, "left")
        at = at.select(*own, "lon", "lat", F.coalesce(blended("water_u"), F.lit(0.0)).alias("u"), F.coalesce(blended("water_v"), F.lit(0.0)).alias("v"))
        lon = F.col("lon") + F.col("u") * dt / (M_PER_DEGREE * F.cos(F.radians("lat")))
        lat = F.col("lat") + F.col("v") * dt / M_PER_DEGREE
        inside = lon.between(axes.lon0, axes.lon1) & lat.between(axes.lat0, axes.lat1)
        particles = cut(at.select(*own, F.when(inside, lon).otherwise(F.col("lon")).alias("lon"), F.when(inside, lat).otherwise(F.col("lat")).alias("lat"), speed(F.col("u"), F.col("v")).alias("speed")), "coupled-particles")
        moved = dispersion_step(flow, dt, dx, axes.n_x, axes.n_y, diffusivity, decay)
        moved = add_sources(moved, sources, k * dt, dt) if sources is not None else moved
        state = cut(moved.select(*state.columns), "coupled-state")
        discard(*made)  # the step before, unless it was given away
        made = [state, particles]
        if (k + 1) % every == 0 or k + 1 == n_steps:
            made = []
            yield k + 1, state, particles
        particles = particles.select(*own, "lon", "lat")


def step_doubling(particles: DataFrame, cells: DataFrame, axes: Axes, dt: float, tolerance: float) -> DataFrame:
    """id, lon, lat, error, next_dt and taken: a Euler step in degrees compared with two half steps, for all particles at once.

    cells: corners() of one depth, of velocities in degrees a second, and of one time unless the particles have a
    time_idx, which stays. A step whose error is over the tolerance is not taken and asks for half of dt; one under a
    tenth of it asks for 1.5 times dt; the half steps' end is kept."""
    keys = [c for c in ("id", "time_idx") if c in particles.columns]
    held = cells.drop("depth_idx") if len(keys) > 1 else cells.drop("time_idx", "depth_idx")

    def velocity(d: DataFrame, lon: str, lat: str, name: str) -> DataFrame:
        seen = located(d, axes, lon, lat).join(held, [*keys[1:], "j", "i"], "left")
        own = [c for c in d.columns if c not in ("j", "i")]
        return seen.select(*own, F.coalesce(blended("water_u"), F.lit(0.0)).alias(f"{name}u"), F.coalesce(blended("water_v"), F.lit(0.0)).alias(f"{name}v"))

    d = velocity(particles.select(*keys, "lon", "lat"), "lon", "lat", "a")
    d = d.withColumns({"_lon": F.col("lon") + F.col("au") * (dt / 2), "_lat": F.col("lat") + F.col("av") * (dt / 2)})
    d = velocity(d, "_lon", "_lat", "b")
    x, y = F.col("_lon") + F.col("bu") * (dt / 2), F.col("_lat") + F.col("bv") * (dt / 2)
    dx, dy = x - F.col("lon") - F.col("au") * dt, y - F.col("lat") - F.col("av") * dt
    d = d.withColumns({"_x": x, "_y": y, "error": F.sqrt(dx * dx + dy * dy)})
    taken = F.col("error") <= tolerance
    step = F.when(~taken, dt * 0.5).when(F.col("error") < tolerance * 0.1, dt * 1.5).otherwise(dt)
    return d.select(*keys, F.when(taken, F.col("_x")).otherwise(F.col("lon")).alias("lon"), F.when(taken, F.col("_y")).otherwise(F.col("lat")).alias("lat"), "error", step.alias("next_dt"), taken.alias("taken"))
