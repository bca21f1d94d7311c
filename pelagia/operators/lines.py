"""Work along whole grid lines: tridiagonal systems, implicit steps by alternating directions, cubic splines.

A field too large for a task is still made of lines that are not. Lines are dealt out in bundles, each bundle is one
array of lines in one task, and a change of direction is one exchange. No task holds a slab.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.lineage import cut, discard

KEYS = ["time_idx", "depth_idx", "j", "i"]


def tridiagonal(lower: np.ndarray, main: np.ndarray, upper: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of tridiagonal systems, one for each row of `right`; one pass down and one up over all rows at once.

    The diagonals are one for all rows; lower[0] and upper[-1] are not read. No pivoting: the systems here are dominated
    by their main diagonals."""
    n = right.shape[1]
    ratio, x = np.zeros(n), right.astype(float).copy()
    ratio[0] = upper[0] / main[0]
    x[:, 0] /= main[0]
    for k in range(1, n):
        d = main[k] - lower[k] * ratio[k - 1]
        ratio[k] = upper[k] / d if k < n - 1 else 0.0
        x[:, k] = (x[:, k] - lower[k] * x[:, k - 1]) / d
    for k in range(n - 2, -1, -1):
        x[:, k] -= ratio[k] * x[:, k + 1]
    return x


def by_lines(df: DataFrame, axis: str, columns: list[str], outputs: list[str], work: Callable[..., tuple[np.ndarray, ...]], bundle: int = 64) -> DataFrame:
    """df with `outputs`, which `work` makes of arrays (lines, cells along `axis`) of the columns and the lines' numbers.

    Each line must be whole: the same cells along `axis` in all lines of a bundle. Lines are dealt in bundles of
    neighbours, so a task holds `bundle` lines at a time whatever the size of the field."""
    across = "j" if axis == "i" else "i"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in outputs)
    schema += "".join(f", `{c}` double" for c in outputs)

    def one_bundle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([across, axis], kind="stable").drop(columns="_bundle")
        lines = rows[across].unique()
        if len(rows) % len(lines):
            raise ValueError(f"lines along {axis} have different numbers of cells")
        arrays = [rows[c].to_numpy(float).reshape(len(lines), -1) for c in columns]
        made = work(*arrays, lines)
        return rows.assign(**{c: a.reshape(-1) for c, a in zip(outputs, made, strict=True)})

    dealt = df.withColumn("_bundle", F.floor(F.col(across) / bundle))
    return dealt.groupBy("time_idx", "depth_idx", "_bundle").applyInPandas(one_bundle, schema)


def _curvature(x: np.ndarray) -> np.ndarray:
    """Second differences along the lines; zero at both ends, where values are fixed."""
    out = np.zeros_like(x)
    out[:, 1:-1] = x[:, 2:] - 2 * x[:, 1:-1] + x[:, :-2]
    return out


def _implicit(c: np.ndarray, explicit: np.ndarray, own: float, other: float, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines of (1 - own·d2) x = c + other·explicit with fixed ends, and own-direction second differences of x.

    Lines that lie on the border keep their values."""
    n = c.shape[1]
    x = c.copy()
    if n > 2 and inner.any():
        right = c + other * explicit
        right[:, 0], right[:, -1] = c[:, 0], c[:, -1]
        lower, main, upper = np.full(n, -own), np.full(n, 1 + 2 * own), np.full(n, -own)
        main[[0, -1]], upper[0], lower[-1] = 1.0, 0.0, 0.0
        x[inner] = tridiagonal(lower, main, upper, right[inner])
    return x, _curvature(x)


def alternating_diffusion(df: DataFrame, dt: float, dx: float, dy: float, diffusivity: float, n_x: int, n_y: int, n_steps: int = 1, bundle: int = 64) -> DataFrame:
    """c after implicit diffusion by alternating directions: second order in time, stable for any dt, border values fixed.

    Half a step is implicit along x and explicit along y, the other half the reverse. Each half solves one tridiagonal
    system a line and hands on the second differences along its own lines, so a half step is one exchange. Nulls count
    as zero; every slab must be whole. State is written every few steps."""
    kx, ky = dt * diffusivity / (2 * dx * dx), dt * diffusivity / (2 * dy * dy)
    columns = df.columns
    d = df.withColumn("c", F.coalesce("c", F.lit(0.0)))
    d = by_lines(d, "j", ["c"], ["_d"], lambda c, _: (_curvature(c),), bundle)
    held = None
    for k in range(n_steps):
        d = by_lines(d, "i", ["c", "_d"], ["c", "_d"], lambda c, e, lines: _implicit(c, e, kx, ky, (lines > 0) & (lines < n_y - 1)), bundle)
        d = by_lines(d, "j", ["c", "_d"], ["c", "_d"], lambda c, e, lines: _implicit(c, e, ky, kx, (lines > 0) & (lines < n_x - 1)), bundle)
        if (k + 1) % 4 == 0 and k + 1 < n_steps:
            d, old = cut(d, "alternating"), held
            held = d
            if old is not None:
                discard(old)
    return d.select(*columns)


def spline_slopes(y: np.ndarray, h: float = 1.0) -> np.ndarray:
    """Slopes at equally spaced points of the cubic splines through the rows of y; not-a-knot ends, so cubics stay cubics.

    Three points give their parabola and two their line."""
    n = y.shape[1]
    if n == 1:
        return np.zeros_like(y)
    d = np.diff(y, axis=1) / h
    if n == 2:
        return np.repeat(d, 2, axis=1)
    if n == 3:
        return np.stack([(3 * d[:, 0] - d[:, 1]) / 2, (d[:, 0] + d[:, 1]) / 2, (3 * d[:, 1] - d[:, 0]) / 2], axis=1)
    lower, main, upper = np.ones(n), np.full(n, 4.0), np.ones(n)
    right = np.empty_like(y)
    right[:, 1:-1] = 3 * (d[:, :-1] + d[:, 1:])
    # the first two pieces are one cubic, and so are the last two
    main[0], upper[0], right[:, 0] = 1.0, 2.0, (5 * d[:, 0] + d[:, 1]) / 2
    main[-1], lower[-1], right[:, -1] = 1.0, 2.0, (5 * d[:, -1] + d[:, -2]) / 2
    return tridiagonal(lower, main, upper, right)
