"""Tracer transport: advection schemes, diffusion, reactions, sources, boundaries, time stepping.

The state is a grid with a concentration column `c` and velocities; a step is window functions along x and y, and a run
is a driver loop that cuts the lineage every few steps.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.functions.mathx import LIMITERS, weno5
from pelagia.lineage import cut, discard
from pelagia.operators.stencil import along_x, along_y, smooth_axis

KEYS = ["time_idx", "depth_idx", "j", "i"]


def _shift(c: str, window, k: int) -> Column:
    return F.lead(c, k).over(window) if k > 0 else F.lag(c, -k).over(window) if k < 0 else F.col(c)


def upwind(window, c: str, velocity: Column, spacing: float) -> Column:
    """Velocity times the one-sided slope on the side that the flow comes from."""
    back, ahead = (F.col(c) - _shift(c, window, -1)) / spacing, (_shift(c, window, 1) - F.col(c)) / spacing
    return velocity * F.when(velocity > 0, back).otherwise(ahead)


def lax_wendroff(window, c: str, velocity: Column, spacing: float, dt: float) -> Column:
    """The centred slope with the second-order correction in time."""
    centred = (_shift(c, window, 1) - _shift(c, window, -1)) / (2 * spacing)
    curved = (_shift(c, window, 1) - 2 * F.col(c) + _shift(c, window, -1)) / (spacing * spacing)
    return velocity * centred - velocity * velocity * (dt / 2) * curved


def limited(window, c: str, velocity: Column, spacing: float, limiter: str = "superbee") -> Column:
    """MUSCL: upwind differences of face values reconstructed with limited slopes."""
    phi = LIMITERS[limiter]

    def slope(k: int) -> Column:
        back, ahead = _shift(c, window, k) - _shift(c, window, k - 1), _shift(c, window, k + 1) - _shift(c, window, k)
        return F.when(F.abs(ahead) < 1e-15, 0.0).otherwise(phi(F.try_divide(back, ahead)) * ahead)

    right = lambda k: _shift(c, window, k) + 0.5 * slope(k)  # noqa: E731  the value at a cell's right face, from the left
    left = lambda k: _shift(c, window, k) - 0.5 * slope(k)
    return velocity * F.when(velocity > 0, right(0) - right(-1)).otherwise(left(1) - left(0)) / spacing


def quick(window, c: str, velocity: Column, spacing: float) -> Column:
    """Quadratic upstream faces: 3/8 downstream, 6/8 here, -1/8 upstream."""
    plus = lambda k: (3 * _shift(c, window, k + 1) + 6 * _shift(c, window, k) - _shift(c, window, k - 1)) / 8
    minus = lambda k: (3 * _shift(c, window, k) + 6 * _shift(c, window, k + 1) - _shift(c, window, k + 2)) / 8
    return velocity * F.when(velocity > 0, plus(0) - plus(-1)).otherwise(minus(0) - minus(-1)) / spacing


def weno(window, c: str, velocity: Column, spacing: float) -> Column:
    """Differences of fifth-order weighted face values on the upwind side."""
    at = lambda k: _shift(c, window, k)
    plus = lambda k: weno5(at(k - 2), at(k - 1), at(k), at(k + 1), at(k + 2))
    minus = lambda k: weno5(at(k + 3), at(k + 2), at(k + 1), at(k), at(k - 1))
    return velocity * F.when(velocity > 0, plus(0) - plus(-1)).otherwise(minus(0) - minus(-1)) / spacing


def advection(df: DataFrame, scheme: str, dx: float, dy: float, dt: float = 0.0, c: str = "c", u: str = "water_u", v: str = "water_v") -> DataFrame:
    """df with `advection`, u·c_x + v·c_y, 0 where the stencil leaves the grid."""
    made = {
        "upwind": lambda w, vel, h: upwind(w, c, vel, h),
        "lax_wendroff": lambda w, vel, h: lax_wendroff(w, c, vel, h, dt),
        "muscl": lambda w, vel, h: limited(w, c, vel, h, "minmod"),
        "superbee": lambda w, vel, h: limited(w, c, vel, h, "superbee"),
        "quick": lambda w, vel, h: quick(w, c, vel, h),
        "weno5": lambda w, vel, h: weno(w, c, vel, h),
    }[scheme]
    still = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    d = df.withColumn("_ax", made(along_x(), still(u), dx)).withColumn("_ay", made(along_y(), still(v), dy))
    return d.withColumn("advection", F.coalesce(F.col("_ax") + F.col("_ay"), F.lit(0.0))).drop("_ax", "_ay")


def diffusion(df: DataFrame, diffusivity: float, dx: float, dy: float, c: str = "c") -> DataFrame:
    """df with `diffusion`, D·(c_xx + c_yy), 0 at the border."""
    second = lambda w, h: (_shift(c, w, 1) - 2 * F.col(c) + _shift(c, w, -1)) / (h * h)
    d = df.withColumn("_xx", second(along_x(), dx)).withColumn("_yy", second(along_y(), dy))
    return d.withColumn("diffusion", F.coalesce(diffusivity * (F.col("_xx") + F.col("_yy")), F.lit(0.0))).drop("_xx", "_yy")


def anisotropic_diffusion(df: DataFrame, dxx: float, dxy: float, dyy: float, dx: float, dy: float, c: str = "c") -> DataFrame:
    """df with `diffusion`, the divergence of a constant symmetric tensor's flux by centred differences, 0 at the border."""
    second = lambda w, h: (_shift(c, w, 1) - 2 * F.col(c) + _shift(c, w, -1)) / (h * h)
    d = df.withColumn("_xx", second(along_x(), dx)).withColumn("_cx", (_shift(c, along_x(), 1) - _shift(c, along_x(), -1)) / (2 * dx))
    d = d.withColumn("_yy", second(along_y(), dy)).withColumn("_xy", (_shift("_cx", along_y(), 1) - _shift("_cx", along_y(), -1)) / (2 * dy))
    return d.withColumn("diffusion", F.coalesce(dxx * F.col("_xx") + 2 * dxy * F.col("_xy") + dyy * F.col("_yy"), F.lit(0.0))).drop("_xx", "_cx", "_yy", "_xy")


def boundary(df: DataFrame, kind: str, n_x: int, n_y: int, dx: float = 1.0, dy: float = 1.0, value: float = 0.0, sides: str = "lrbt", c: str = "c") -> DataFrame:
    """Border values by `kind` (dirichlet, neumann, robin, periodic, outflow) on the sides left, right, bottom, top.

    Left and right come first, then bottom and top of what results."""

    def one_axis(d: DataFrame, axis: str, n: int, h: float, window, lo: bool, hi: bool) -> DataFrame:
        here, ahead, behind = F.col(c), F.lead(c).over(window), F.lag(c).over(window)
        inner_lo = F.nth_value(c, n - 1).over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        inner_hi = F.nth_value(c, 2).over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        first, last = {
            "dirichlet": (F.lit(value), F.lit(value)),
            "neumann": (ahead - value * h, behind + value * h),
            "outflow": (ahead, behind),
            "robin": (value - (ahead - here) / h, value - (here - behind) / h),
            "periodic": (inner_lo, inner_hi),
        }[kind]
        new = here
        new = F.when(F.col(axis) == 0, first).otherwise(new) if lo else new
        new = F.when(F.col(axis) == n - 1, last).otherwise(new) if hi else new
        return d.withColumn("_new", new).drop(c).withColumnRenamed("_new", c)

    if "l" in sides or "r" in sides:
        df = one_axis(df, "i", n_x, dx, along_x(), "l" in sides, "r" in sides)
    if kind != "robin" and ("b" in sides or "t" in sides):
        df = one_axis(df, "j", n_y, dy, along_y(), "b" in sides, "t" in sides)
    return df


def euler_step(df: DataFrame, dt: float, dx: float, dy: float, diffusivity: float, scheme: str = "upwind", reaction: Callable[[Column], Column] | None = None, source: str | None = None) -> DataFrame:
    """c + dt·(diffusion - advection + source + reaction(c)), with the columns of df."""
    d = diffusion(advection(df, scheme, dx, dy, dt), diffusivity, dx, dy)
    rate = F.col("diffusion") - F.col("advection")
    rate = rate + F.coalesce(F.col(source), F.lit(0.0)) if source else rate
    rate = rate + reaction(F.col("c")) if reaction else rate
    return d.withColumn("c", F.col("c") + dt * rate).select(*df.columns)


def run(df: DataFrame, n_steps: int, step: Callable[[DataFrame, int], DataFrame], cut_every: int = 4) -> DataFrame:
    """n_steps of a step function; windows nest, so the lineage is cut often. One state is kept on disk, not all."""
    held = None
    for k in range(n_steps):
        df = step(df, k)
        if (k + 1) % cut_every == 0 and k + 1 < n_steps:
            df = cut(df)
            if held is not None:
                discard(held)
            held = df
    return df


def steady_state(df: DataFrame, step: Callable[[DataFrame], DataFrame], tolerance: float = 1e-6, most: int = 200) -> tuple[DataFrame, int]:
    """Steps until the relative change of c falls below the tolerance; the state and the number of steps.

    A state that still moves after `most` steps is an error, not a result."""
    held = None
    for k in range(1, most + 1):
        new = cut(step(df))
        r = new.select(*KEYS, F.col("c").alias("_n")).join(df.select(*KEYS, "c"), KEYS).agg(F.sqrt(F.sum((F.col("_n") - F.col("c")) * (F.col("_n") - F.col("c")))).alias("d"), F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("n")).first()
        if held is not None:
            discard(held)
        df = held = new
        if (r["d"] or 0.0) <= tolerance * max(r["n"] or 0.0, 1e-30):
            return df, k
    raise RuntimeError(f"not steady after {most} steps")


def react(df: DataFrame, reactions: list[tuple[str, str, str, float]], dt: float, decay: dict[str, float] | None = None) -> DataFrame:
    """Component columns after mass-action reactions A + B -> C with a rate, then decay; no value falls below 0."""
    change: dict[str, Column] = {}
    for a, b, product, rate in reactions:
        r = rate * F.col(a) * F.col(b)
        for name, sign in {a: -1, b: -1}.items():
            change[name] = change.get(name, F.lit(0.0)) + sign * r
        change[product] = change.get(product, F.lit(0.0)) + r
    fade = lambda n, x: x * math.exp(-(decay or {}).get(n, 0.0) * dt)
    names = set(change) | set(decay or {})
    return df.withColumns({n: F.greatest(F.lit(0.0), fade(n, F.col(n) + dt * change.get(n, F.lit(0.0)))) for n in names})


def add_sources(df: DataFrame, sources: DataFrame, t: float, dt: float, c: str = "c") -> DataFrame:
    """intensity·dt of the sources that are active at t (t_start to t_end) on top of their cells."""
    live = sources.where(F.lit(t).between(F.col("t_start"), F.col("t_end"))).groupBy("j", "i").agg((F.sum("intensity") * dt).alias("_add"))
    return df.join(live, ["j", "i"], "left").withColumn(c, F.col(c) + F.coalesce("_add", F.lit(0.0))).select(*df.columns)


def superpose(cells: DataFrame, sources: DataFrame, radius: int, reach: int) -> DataFrame:
    """j, i, c: every source's plume of two Gaussians around its cell, scaled by its intensity, summed where they overlap.

    A plume is cut at `reach` cells, so a source meets only cells near it, by an equi-join on the cell."""
    near = F.sequence(F.lit(-reach), F.lit(reach))
    spread = sources.select("source_id", "intensity", "j", "i").withColumn("dj", F.explode(near)).withColumn("di", F.explode(near))
    m = (F.col("dj") * F.col("dj") + F.col("di") * F.col("di")) / float(radius * radius)
    plume = F.greatest(F.exp(-m / 4), 0.3 * F.exp(-m / 2)) * F.col("intensity")
    added = spread.select((F.col("j") + F.col("dj")).alias("j"), (F.col("i") + F.col("di")).alias("i"), plume.alias("p")).groupBy("j", "i").agg(F.sum("p").alias("c"))
    return cells.select("j", "i").join(added, ["j", "i"], "left").select("j", "i", F.coalesce("c", F.lit(0.0)).alias("c"))


def dispersion_step(df: DataFrame, dt: float, dx: float, n_x: int, n_y: int, diffusivity: float = 500.0, decay: float = 5e-5) -> DataFrame:
    """Central advection, diffusion by repeated gradients, decay, no negative values, two damped border rings, light smoothing."""
    from pelagia.operators.stencil import derivative

    still = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    d = df.withColumn("_cx", derivative(F.col("c"), along_x(), dx)).withColumn("_cxx", derivative(F.col("_cx"), along_x(), dx))
    d = d.withColumn("_cy", derivative(F.col("c"), along_y(), dx)).withColumn("_cyy", derivative(F.col("_cy"), along_y(), dx))
    rate = -still("water_u") * F.col("_cx") - still("water_v") * F.col("_cy") + diffusivity * (F.col("_cxx") + F.col("_cyy")) - decay * F.col("c")
    edge = lambda axis, n: F.least(F.col(axis), n - 1 - F.col(axis))
    damp = lambda e: F.when(e == 0, 0.45).when(e == 1, 0.9).otherwise(1.0)
    c = F.greatest(F.lit(0.0), F.col("c") + dt * rate) * damp(edge("i", n_x)) * damp(edge("j", n_y))
    from pelagia.operators.stencil import gaussian_weights

    d = d.withColumn("c", c).select(*df.columns)
    w = gaussian_weights(0.2)
    return smooth_axis(smooth_axis(d, "c", "i", n_x, w), "c", "j", n_y, w).select(*df.columns)


def implicit_diffusion(df: DataFrame, dt: float, dx: float, dy: float, diffusivity: float, theta: float = 1.0) -> DataFrame:
    """One implicit (theta 1) or Crank-Nicolson (theta 0.5) diffusion step of each slab, with fixed border values.

    Conjugate gradients on one slab's array in its own task; slabs are independent, so this scales with their number."""

    def lap(x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        out[1:-1, 1:-1] = (x[1:-1, 2:] - 2 * x[1:-1, 1:-1] + x[1:-1, :-2]) / dx**2 + (x[2:, 1:-1] - 2 * x[1:-1, 1:-1] + x[:-2, 1:-1]) / dy**2
        return out

    def solved(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["j", "i"])
        shape = (rows["j"].nunique(), rows["i"].nunique())
        c = rows["c"].fillna(0.0).to_numpy().reshape(shape)
        k = dt * diffusivity
        fixed = c.copy()
        fixed[1:-1, 1:-1] = 0.0
        inner = lambda x: np.pad(x[1:-1, 1:-1], 1)
        b = inner(c + (1 - theta) * k * lap(c) + theta * k * lap(fixed))
        apply = lambda x: inner(x - theta * k * lap(x))
        x = inner(c)
        r = b - apply(x)
        p, rr = r.copy(), float((r * r).sum())
        for _ in range(1000):
            if rr <= 1e-24 * max(1.0, float((b * b).sum())):
                break
            ap = apply(p)
            a = rr / float((p * ap).sum())
            x, r = x + a * p, r - a * ap
            new = float((r * r).sum())
            p, rr = r + new / rr * p, new
        return rows.assign(c=(x + fixed).reshape(-1))

    return df.groupBy("time_idx", "depth_idx").applyInPandas(solved, df.schema)


def series_step(df: DataFrame, velocity: float, diffusivity: float, dx: float, dt: float, ends: str = "periodic") -> DataFrame:
    """One step of 1-D advection and diffusion on a series (key, idx, c): upwind and central, with periodic or fixed ends."""
    w = Window.partitionBy("key").orderBy("idx")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left, right = F.lag("c").over(w), F.lead("c").over(w)
    if ends == "periodic":
        left, right = F.coalesce(left, F.last("c").over(whole)), F.coalesce(right, F.first("c").over(whole))
    slope = (F.col("c") - left) / dx if velocity > 0 else (right - F.col("c")) / dx
    new = F.col("c") + dt * (diffusivity * (right - 2 * F.col("c") + left) / (dx * dx) - velocity * slope)
    return df.withColumn("_new", F.coalesce(new, F.col("c"))).drop("c").withColumnRenamed("_new", "c")


def frames(df: DataFrame, n_steps: int, step: Callable[[DataFrame, int], DataFrame], every: int) -> Iterator[tuple[int, DataFrame]]:
    """(step number, state) of every `every`-th step and the last one."""
    for k in range(n_steps):
        df = cut(step(df, k))
        if (k + 1) % every == 0 or k + 1 == n_steps:
            yield k + 1, df
