"""Lookups that need more than four corners: bicubic in place, cubic in time, linear in time, depth and place together.

What a point needs of its cell is put in one row first, sixteen numbers of a field, so that a lookup is one equi-join
with the cells, however many points there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.operators.interp import Axes, corners, located, mesh
from pelagia.operators.lines import KEYS, by_lines, spline_slopes
from pelagia.operators.series import hermite, knot_slopes
from pelagia.operators.stencil import along_t, along_z

#: The value, its slopes along x and y and its twist, at the four corners of a cell (x, then y).
PARTS = [f"{kind}{at}" for at in ("00", "10", "01", "11") for kind in ("f", "fx", "fy", "fxy")]


def _ahead(a: np.ndarray) -> np.ndarray:
    """Each line's next value; the last cell has none, and belongs to no lookup."""
    return np.concatenate([a[:, 1:], a[:, -1:]], axis=1)


def spline_cells(df: DataFrame, name: str, bundle: int = 64, missing: float = 0.0) -> DataFrame:
    """time_idx, depth_idx, j, i and PARTS of the cell above and right of each grid point.

    The slopes are those of the tensor product of cubic splines with not-a-knot ends: a spline along every line of x,
    then along every line of y for the values and for the slopes. Two exchanges, no task with a whole slab. Slabs must
    be whole; a null value counts as `missing`."""
    d = df.select(*KEYS, F.coalesce(F.col(name).cast("double"), F.lit(missing)).alias("f00"))

    def across(f: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, ...]:
        fx = spline_slopes(f)
        return fx, _ahead(f), _ahead(fx)

    def upward(f: np.ndarray, fx: np.ndarray, g: np.ndarray, gx: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, ...]:
        slopes = [spline_slopes(a) for a in (f, fx, g, gx)]
        right = [g, gx, slopes[2], slopes[3]]
        return (*slopes[:2], *right, *map(_ahead, (f, fx, *slopes[:2])), *map(_ahead, right))

    d = by_lines(d, "i", ["f00"], ["fx00", "_g", "_gx"], across, bundle)
    made = ["fy00", "fxy00", "f10", "fx10", "fy10", "fxy10", "f01", "fx01", "fy01", "fxy01", "f11", "fx11", "fy11", "fxy11"]
    return by_lines(d, "j", ["f00", "fx00", "_g", "_gx"], made, upward, bundle).select(*KEYS, *PARTS)


def surface(x: Column, y: Column) -> Column:
    """The bicubic value at the shares x, y of a cell, from a row of PARTS; slopes are for a cell of width one."""
    one = F.lit(1.0)
    edge = lambda kind, side: hermite(F.col(f"{kind}{side}0"), F.col(f"{_TWIST[kind]}{side}0"), F.col(f"{kind}{side}1"), F.col(f"{_TWIST[kind]}{side}1"), y, one)
    return hermite(edge("f", 0), edge("fx", 0), edge("f", 1), edge("fx", 1), x, one)


_TWIST = {"f": "fy", "fx": "fxy"}


def bicubic(df: DataFrame, points: DataFrame, columns: list[str], axes: Axes, fill: float | None = None, bundle: int = 64) -> DataFrame:
    """points (with time_idx, depth_idx, lon, lat) and the columns by bicubic splines; `fill` outside the grid."""
    placed = located(points, axes)
    for c in columns:
        cells = spline_cells(df, c, bundle)
        value = surface(F.col("_fx"), F.col("_fy"))
        value = F.coalesce(value, F.lit(fill)) if fill is not None else value
        placed = placed.join(cells, KEYS, "left").withColumn(f"_of_{c}", value).drop(*PARTS)
    return placed.select(*points.columns, *(F.col(f"_of_{c}").alias(c) for c in columns))


def regrid_cubic(df: DataFrame, columns: list[str], axes: Axes, resolution: float, time_idx: int = 0, depth_idx: int = 0) -> DataFrame:
    """The columns on another regular grid over the same extent, by bicubic splines."""
    lons = [round(axes.lon0 + k * resolution, 10) for k in range(int((axes.lon1 - axes.lon0) / resolution + 1e-9) + 1)]
    lats = [round(axes.lat0 + k * resolution, 10) for k in range(int((axes.lat1 - axes.lat0) / resolution + 1e-9) + 1)]
    return bicubic(df, mesh(df.sparkSession, lons, lats, time_idx, depth_idx), columns, axes, 0.0)


def at_times(df: DataFrame, columns: list[str], times: list[float], targets: list[float], method: str = "linear", bundle: int = 64) -> DataFrame:
    """The field at further times: target, depth_idx, j, i and the columns; null outside the known times.

    times[k] is when time_idx k was; the axis may be uneven. Cubic is the spline along time of each cell, whose ends are
    no knots, from four known times on and linear below; nearest takes the earlier of two equally near. A cell uses the
    times at which it is known. Cells are worked on in bundles of neighbouring grid lines."""
    if method not in ("linear", "cubic", "nearest"):
        raise ValueError(f"unknown method {method}")
    when, at = np.array(times, dtype=float), np.array(targets, dtype=float)

    def one_cell(values: np.ndarray, known: np.ndarray) -> np.ndarray:
        out, t, v = np.full(len(at), np.nan), when[known], values[known]
        if not len(t):
            return out
        order = np.argsort(t)
        t, v = t[order], v[order]
        inside = (at >= t[0]) & (at <= t[-1])
        if method == "nearest":
            k = np.clip(np.searchsorted(t, at), 1, len(t) - 1) if len(t) > 1 else np.zeros(len(at), dtype=int)
            k = np.where(at - t[k - 1] <= t[k] - at, k - 1, k) if len(t) > 1 else k
            return np.where(inside, v[k], np.nan)
        if len(t) == 1:
            return np.where(inside, v[0], np.nan)
        k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, len(t) - 2)
        h = t[k + 1] - t[k]
        s = (at - t[k]) / h
        made = v[k] + (v[k + 1] - v[k]) * s
        if method == "cubic" and len(t) >= 4:
            m, r = knot_slopes(t, v), 1 - s
            made = v[k] * (1 + 2 * s) * r * r + m[k] * h * s * r * r + v[k + 1] * s * s * (3 - 2 * s) - m[k + 1] * h * s * s * r
        return np.where(inside, made, np.nan)

    def one_bundle(rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for (z, j, i), cell in rows.groupby(["depth_idx", "j", "i"]):
            made = {"target": at, "depth_idx": z, "j": j, "i": i}
            for c in columns:
                held = np.full(len(when), np.nan)
                held[cell["time_idx"].to_numpy()] = cell[c].to_numpy(float)
                made[c] = one_cell(held, ~np.isnan(held))
            parts.append(pd.DataFrame(made))
        return pd.concat(parts)

    schema = "target double, depth_idx int, j int, i int, " + ", ".join(f"`{c}` double" for c in columns)
    dealt = df.select(*KEYS, *columns).withColumn("_bundle", F.floor(F.col("i") / bundle))
    made = dealt.groupBy("depth_idx", "j", "_bundle").applyInPandas(one_bundle, schema)
    return made.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def _bracket(axis: list[float], x: Column) -> tuple[Column, Column]:
    """(index of the axis value at or before x, share of the way to the next); null outside the axis."""
    values, last = F.array(*map(F.lit, map(float, axis))), max(0, len(axis) - 2)
    k = F.least(F.size(F.filter(values, lambda a: a <= x)) - 1, F.lit(last))
    k = F.when(x.between(float(axis[0]), float(axis[-1])), k)
    here, there = F.element_at(values, k + 1), F.element_at(values, F.least(k + 2, F.lit(len(axis))))
    return k.cast("int"), F.coalesce(F.try_divide(x - here, there - here), F.lit(0.0))


def sixteen_corners(df: DataFrame, columns: list[str]) -> DataFrame:
    """corners() of each cell with those of the next depth, the next time and both: <column><xy>_<z><t>.

    Beyond the last depth or time the cell's own corners stand in; their weight is zero there."""
    held = corners(df, columns)
    names = [f"{c}{k}" for c in columns for k in ("00", "10", "01", "11")]
    ahead = lambda c, w: F.coalesce(F.lead(c).over(w), F.col(c))
    held = held.withColumnsRenamed({c: f"{c}_00" for c in names})
    held = held.withColumns({f"{c}_10": ahead(f"{c}_00", along_z()) for c in names})
    return held.withColumns({f"{c}_{z}1": ahead(f"{c}_{z}0", along_t()) for c in names for z in (0, 1)})


def anywhere(df: DataFrame, points: DataFrame, columns: list[str], axes: Axes, depths: list[float], times: list[float]) -> DataFrame:
    """points (lon, lat, depth, time) and the columns, linear in all four directions at once; null outside any of them.

    depths and times are the values of depth_idx and time_idx, which may be uneven. One equi-join on the cell below, of
    which a row holds its sixteen corners; every depth and time of a cell must be there. A null corner counts as zero."""
    k, z = _bracket(depths, F.col("depth"))
    m, t = _bracket(times, F.col("time"))
    placed = located(points, axes).withColumns({"depth_idx": k, "_fz": z, "time_idx": m, "_ft": t})

    def at(c: str, zt: str) -> Column:
        x, y = F.col("_fx"), F.col("_fy")
        v = lambda xy: F.col(f"{c}{xy}_{zt}")
        return v("00") * (1 - x) * (1 - y) + v("10") * x * (1 - y) + v("01") * (1 - x) * y + v("11") * x * y

    def whole(c: str) -> Column:
        z, t = F.col("_fz"), F.col("_ft")
        return (at(c, "00") * (1 - z) + at(c, "10") * z) * (1 - t) + (at(c, "01") * (1 - z) + at(c, "11") * z) * t

    got = placed.join(sixteen_corners(df, columns), KEYS, "left")
    return got.select(*points.columns, *(whole(c).alias(c) for c in columns))
