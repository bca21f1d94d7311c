"""Flow in layers with its two time rates: fast surface waves in the depth mean, slow motion in the layers.

A step of the layers is long; the depth mean is stepped `m` times within it, and its mean over these sub-steps replaces
the layers' own. A sub-step reads cells at most two away, so a tile of the grid with a border of 2·m cells around it is
stepped all m times in one task, and the whole step has one exchange of the depth mean, not four for each sub-step.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.functions import ocean
from pelagia.operators.stencil import along_x, along_y, along_z

MEANS = "time_idx int, j int, i int, eta double, mean_u double, mean_v double"


def depth_mean(layers: DataFrame, *columns: str) -> DataFrame:
    """time_idx, j, i, the water depth h, and each column's mean over the layers, weighted by their thickness dz."""
    mean = lambda c: (F.sum(F.coalesce(c, F.lit(0.0)) * F.col("dz")) / F.sum("dz")).alias(c)
    return layers.groupBy("time_idx", "j", "i").agg(F.sum("dz").alias("h"), *(mean(c) for c in columns))


def split(layers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the depth means u, v with h, the layers with u, v as deviations from them)."""
    mean = depth_mean(layers, "u", "v")
    joined = layers.join(mean.withColumnsRenamed({"u": "_u", "v": "_v"}).drop("h"), ["time_idx", "j", "i"])
    return mean, joined.withColumns({"u": F.col("u") - F.col("_u"), "v": F.col("v") - F.col("_v")}).select(*layers.columns)


def _wall_gradient(c: str, window, spacing: float) -> Column:
    """Central difference; beyond a wall the value is the wall cell's own."""
    after, before = F.coalesce(F.lead(c).over(window), F.col(c)), F.coalesce(F.lag(c).over(window), F.col(c))
    return (after - before) / (2 * spacing)


def slow_forces(layers: DataFrame, dx: float, dy: float, viscosity: float) -> DataFrame:
    """layers with gx and gy: the pressure of the density above (none without a column density) and vertical friction.

    Friction is between neighbouring layers, none at the surface and the bottom, over layers of equal thickness."""
    second = lambda c: (F.coalesce(F.lead(c).over(along_z()) - F.col(c), F.lit(0.0)) - F.coalesce(F.col(c) - F.lag(c).over(along_z()), F.lit(0.0))) / (F.col("dz") * F.col("dz"))
    d = layers.withColumns({"gx": viscosity * second("u"), "gy": viscosity * second("v")})
    if "density" not in layers.columns:
        return d
    excess = (F.coalesce(F.col("density"), F.lit(ocean.RHO0)) - ocean.RHO0) * F.col("dz") * (ocean.GRAVITY / ocean.RHO0)
    d = d.withColumn("_p", F.sum(excess).over(along_z().rowsBetween(-(1 << 30), 0)) - excess / 2)
    d = d.withColumn("gx", F.col("gx") - _wall_gradient("_p", along_x(), dx))
    return d.withColumn("gy", F.col("gy") - _wall_gradient("_p", along_y(), dy)).drop("_p")


def sub_stepped(mean: dict[str, np.ndarray], dt: float, m: int, dx: float, dy: float, coriolis: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """eta after m sub-steps of dt / m on one rectangle, and the means of u and v over them.

    Flux between cells is the mean of both, none at the rectangle's edge; eta first, then the velocities with its slope."""
    eta, u, v, h, gx, gy = (mean[c] for c in ("eta", "u", "v", "h", "gx", "gy"))
    eta, sum_u, sum_v, ds = eta.copy(), np.zeros_like(u), np.zeros_like(v), dt / m
    for _ in range(m):
        hu, hv = h * u, h * v
        fx = np.pad((hu[:, :-1] + hu[:, 1:]) / 2, ((0, 0), (1, 1)))
        fy = np.pad((hv[:-1] + hv[1:]) / 2, ((1, 1), (0, 0)))
        eta -= ds * ((fx[:, 1:] - fx[:, :-1]) / dx + (fy[1:] - fy[:-1]) / dy)
        wide = np.pad(eta, 1, mode="edge")
        ex, ey = (wide[1:-1, 2:] - wide[1:-1, :-2]) / (2 * dx), (wide[2:, 1:-1] - wide[:-2, 1:-1]) / (2 * dy)
        u, v = u + ds * (coriolis * v - ocean.GRAVITY * ex + gx), v + ds * (-coriolis * u - ocean.GRAVITY * ey + gy)
        sum_u, sum_v = sum_u + u, sum_v + v
    return eta, sum_u / m, sum_v / m


def tiled(mean: DataFrame, tile: int, border: int, names: list[str], step: Callable[[dict[str, np.ndarray]], tuple[np.ndarray, ...]], schema: str) -> DataFrame:
    """`step` on tiles of the grid (time_idx, j, i) with `border` more cells on each side; only the tiles' own cells are kept.

    Each cell goes to its own tile and to those whose border it lies in. Nulls and missing cells are zero."""
    reached = lambda axis: F.sequence(F.floor((F.col(axis) - border) / tile), F.floor((F.col(axis) + border) / tile))
    spread = mean.withColumn("ty", F.explode(reached("j"))).withColumn("tx", F.explode(reached("i")))
    outputs = [c.split()[0] for c in schema.split(", ")][3:]

    def one_tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        j0, i0 = int(rows["j"].min()), int(rows["i"].min())
        shape = (int(rows["j"].max()) - j0 + 1, int(rows["i"].max()) - i0 + 1)
        j, i = rows["j"].to_numpy() - j0, rows["i"].to_numpy() - i0
        held = {}
        for c in names:
            held[c] = np.zeros(shape)
            held[c][j, i] = rows[c].fillna(0.0).to_numpy()
        own = ((rows["j"] // tile == key[1]) & (rows["i"] // tile == key[2])).to_numpy()
        if not own.any():
            return pd.DataFrame({"time_idx": [], "j": [], "i": [], **{c: [] for c in outputs}}).astype({"time_idx": "int32", "j": "int32", "i": "int32"})
        made = step(held)
        return pd.DataFrame({"time_idx": key[0], "j": rows["j"][own], "i": rows["i"][own], **{c: a[j[own], i[own]] for c, a in zip(outputs, made, strict=True)}})

    return spread.groupBy("time_idx", "ty", "tx").applyInPandas(one_tile, schema)


def split_step(layers: DataFrame, surface: DataFrame, dt: float, m: int, dx: float, dy: float, coriolis: float, viscosity: float = 0.0, tile: int = 512) -> tuple[DataFrame, DataFrame]:
    """(layers, surface) after one step of dt with m sub-steps of the depth mean; walls all around, so no water is lost.

    layers: time_idx, depth_idx, j, i, u, v, dz and, if the density drives the flow, density; further columns stay.
    surface: time_idx, j, i, eta. A layer's change is its Coriolis turn and slow forces; its mean over depth is then the
    sub-steps' mean. Nulls are still water. Layers of unequal thickness are weighted by it."""
    forced = slow_forces(layers.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("u", "v")}), dx, dy, viscosity)
    mean = depth_mean(forced, "u", "v", "gx", "gy").join(surface.select("time_idx", "j", "i", "eta"), ["time_idx", "j", "i"])
    names = ["eta", "u", "v", "h", "gx", "gy"]
    moved = tiled(mean, tile, 2 * m, names, lambda held: sub_stepped(held, dt, m, dx, dy, coriolis), MEANS)
    new_u = F.col("u") + dt * (coriolis * F.col("v") + F.col("gx"))
    new_v = F.col("v") + dt * (-coriolis * F.col("u") + F.col("gy"))
    stepped = forced.withColumns({"u": new_u, "v": new_v}).drop("gx", "gy")
    own = depth_mean(stepped, "u", "v").withColumnsRenamed({"u": "_u", "v": "_v"}).drop("h")
    shift = own.join(moved, ["time_idx", "j", "i"]).select("time_idx", "j", "i", (F.col("mean_u") - F.col("_u")).alias("_du"), (F.col("mean_v") - F.col("_v")).alias("_dv"))
    put_back = stepped.join(shift, ["time_idx", "j", "i"]).withColumns({"u": F.col("u") + F.col("_du"), "v": F.col("v") + F.col("_dv")})
    return put_back.select(*layers.columns), moved.select("time_idx", "j", "i", "eta")
