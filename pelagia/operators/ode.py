"""Runge-Kutta steps for many independent systems at once: explicit ones as Columns, adaptive and implicit ones on batches.

A system is a row; its state is one column or an array. The tableaux are published constants.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.lineage import cut

Rows = tuple[tuple[float, ...], ...]


@dataclass(frozen=True)
class Tableau:
    """Nodes c, matrix a, weights b and, for embedded pairs, the weights of the lower-order solution."""

    c: tuple[float, ...]
    a: Rows
    b: tuple[float, ...]
    lower: tuple[float, ...] | None = None
    order: int = 4

    @property
    def explicit(self) -> bool:
        return all(len(row) <= i or not any(row[i:]) for i, row in enumerate(self.a))


#: The published tableaux.
EULER = Tableau((0.0,), ((),), (1.0,), order=1)
RK4 = Tableau((0.0, 0.5, 0.5, 1.0), ((), (0.5,), (0.0, 0.5), (0.0, 0.0, 1.0)), (1 / 6, 1 / 3, 1 / 3, 1 / 6))
RKF45 = Tableau(
    (0.0, 1 / 4, 3 / 8, 12 / 13, 1.0, 1 / 2),
    ((), (1 / 4,), (3 / 32, 9 / 32), (1932 / 2197, -7200 / 2197, 7296 / 2197), (439 / 216, -8.0, 3680 / 513, -845 / 4104), (-8 / 27, 2.0, -3544 / 2565, 1859 / 4104, -11 / 40)),
    (16 / 135, 0.0, 6656 / 12825, 28561 / 56430, -9 / 50, 2 / 55),
    (25 / 216, 0.0, 1408 / 2565, 2197 / 4104, -1 / 5, 0.0),
    5,
)
DOPRI5 = Tableau(
    (0.0, 1 / 5, 3 / 10, 4 / 5, 8 / 9, 1.0, 1.0),
    (
        (),
        (1 / 5,),
        (3 / 40, 9 / 40),
        (44 / 45, -56 / 15, 32 / 9),
        (19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729),
        (9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656),
        (35 / 384, 0.0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84),
    ),
    (35 / 384, 0.0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84, 0.0),
    (5179 / 57600, 0.0, 7571 / 16695, 393 / 640, -92097 / 339200, 187 / 2100, 1 / 40),
    5,
)
GAUSS1 = Tableau((0.5,), ((0.5,),), (1.0,), order=2)
GAUSS2 = Tableau((0.5 - 3**0.5 / 6, 0.5 + 3**0.5 / 6), ((0.25, 0.25 - 3**0.5 / 6), (0.25 + 3**0.5 / 6, 0.25)), (0.5, 0.5), order=4)
METHODS = {"euler": EULER, "rk4": RK4, "rkf45": RKF45, "dopri5": DOPRI5, "gauss1": GAUSS1, "gauss2": GAUSS2}


def explicit_step(state: dict[str, Column], t: Column, dt: float, f: Callable[[dict[str, Column], Column], dict[str, Column]], tableau: Tableau = RK4) -> dict[str, Column]:
    """One explicit step of a small system as Columns; f gives the derivative of each named variable."""
    if not tableau.explicit:
        raise ValueError("an implicit tableau needs solve_batches()")
    slopes: list[dict[str, Column]] = []

    def moved(weights: tuple[float, ...]) -> dict[str, Column]:
        out = dict(state)
        for w, k in zip(weights, slopes, strict=False):
            if w:
                out = {n: out[n] + dt * w * k[n] for n in out}
        return out

    for c, row in zip(tableau.c, tableau.a, strict=True):
        slopes.append(f(moved(row), t + c * dt))
    return moved(tableau.b)


def solve(df: DataFrame, names: list[str], dt: float, n_steps: int, f: Callable[[dict[str, Column], Column], dict[str, Column]], tableau: Tableau = RK4) -> DataFrame:
    """df after n_steps; each step is one projection, so the whole run stays inside generated code."""
    for k in range(n_steps):
        new = explicit_step({n: F.col(n) for n in names}, F.lit(k * dt), dt, f, tableau)
        df = df.withColumns(new)
    return df


def _stages(y: np.ndarray, t: float | np.ndarray, dt: float | np.ndarray, f: Callable[[np.ndarray, float | np.ndarray], np.ndarray], tableau: Tableau) -> np.ndarray:
    """The slopes of all stages for a batch of states; implicit tableaux by Newton steps with a finite-difference Jacobian.

    t and dt are numbers, or columns with a row's own in each row."""
    s = len(tableau.b)
    k = np.zeros((s, *y.shape))
    if tableau.explicit:
        for i, row in enumerate(tableau.a):
            k[i] = f(y + dt * sum((w * k[m] for m, w in enumerate(row)), np.zeros_like(y)), t + tableau.c[i] * dt)
        return k
    a, n = np.array(tableau.a), y.shape[1]
    k[:] = f(y, t)
    eye = np.eye(s * n)
    for _ in range(25):
        at = y[None] + dt * np.einsum("ij,jbn->ibn", a, k)
        slopes = np.stack([f(at[i], t + tableau.c[i] * dt) for i in range(s)])
        rest = k - slopes
        if np.abs(rest).max(initial=0.0) < 1e-12:
            break
        jac = np.zeros((s, len(y), n, n))
        for i in range(s):
            for m in range(n):
                h = 1e-7 * np.maximum(1.0, np.abs(at[i][:, m]))
                up = at[i].copy()
                up[:, m] += h
                jac[i, :, :, m] = (f(up, t + tableau.c[i] * dt) - slopes[i]) / h[:, None]
        # each row's matrix is made of blocks a[i, m] * jac[i]; all rows are solved in one call
        j = eye - np.reshape(dt, (-1, 1, 1)) * np.einsum("im,ibpq->bipmq", a, jac).reshape(len(y), s * n, s * n)
        k -= np.linalg.solve(j, rest.transpose(1, 0, 2).reshape(len(y), s * n, 1)).reshape(len(y), s, n).transpose(1, 0, 2)
    return k


def batch_step(y: np.ndarray, t: float, dt: float, f: Callable[[np.ndarray, float], np.ndarray], tableau: Tableau) -> np.ndarray:
    return y + dt * np.einsum("i,ibn->bn", np.array(tableau.b), _stages(y, t, dt, f, tableau))


def adaptive(y: np.ndarray, t0: float, t1: float, f: Callable[[np.ndarray, float | np.ndarray], np.ndarray], tolerance: float, dt: float, tableau: Tableau = DOPRI5, least: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """The states of a batch of systems (rows) at t1 and the steps that each took.

    Every row has a time and step sizes of its own, which follow its embedded error by factors from 0.5 to 2; f gets the
    rows that are still under way and a column of their times."""
    y, weights, gap, end = np.array(y, dtype=float), np.array(tableau.b), np.array(tableau.b) - np.array(tableau.lower), 1e-14 * max(1.0, abs(t1))
    t, size, steps = np.full(len(y), float(t0)), np.full(len(y), float(dt)), np.zeros(len(y), dtype=int)
    live = np.flatnonzero(t1 - t > end)
    while len(live):
        h = np.minimum(size[live], t1 - t[live])
        k = _stages(y[live], t[live, None], h[:, None], f, tableau)
        error = np.abs(h[:, None] * np.einsum("i,ibn->bn", gap, k)).max(axis=1, initial=0.0)
        met = error <= tolerance
        if (stuck := live[~met & (h <= least)]).size:
            raise ArithmeticError(f"no step of {least} or more meets the tolerance at {t[stuck[0]]}")
        moved = live[met]
        y[moved] += h[met, None] * np.einsum("i,ibn->bn", weights, k[:, met])
        t[moved] += h[met]
        steps[moved] += 1
        size[live] = np.maximum(h * np.minimum(2.0, np.fmax(0.5, 0.9 * (tolerance / np.maximum(error, 1e-300)) ** (1 / tableau.order))), least)
        live = live[t1 - t[live] > end]
    return y, steps


def solve_batches(df: DataFrame, state: str, dt: float, n_steps: int, f: Callable[[np.ndarray, float], np.ndarray], tableau: Tableau = RK4) -> DataFrame:
    """df with its array column `state` after n_steps of any tableau; f works on a batch of states at once."""

    def moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            y = np.stack(b[state].to_numpy())
            for k in range(n_steps):
                y = batch_step(y, k * dt, dt, f, tableau)
            yield b.assign(**{state: list(y)})

    return df.mapInPandas(moved, df.schema)


def solve_adaptive(df: DataFrame, state: str, t1: float, f: Callable[[np.ndarray, float], np.ndarray], tolerance: float = 1e-8, dt: float = 0.1, tableau: Tableau = DOPRI5) -> DataFrame:
    """df with `state` at t1 and `steps`: each row with step sizes of its own; f as for adaptive()."""

    def moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made, steps = np.empty(len(b), dtype=object), np.zeros(len(b), dtype=int)
            lengths = b[state].map(len).to_numpy()
            for n in np.unique(lengths):  # systems of one size go together
                at = np.flatnonzero(lengths == n)
                y, steps[at] = adaptive(np.stack(b[state].iloc[at].to_numpy()), 0.0, t1, f, tolerance, dt, tableau)
                for i, row in zip(at.tolist(), y, strict=True):
                    made[i] = row
            yield b.assign(**{state: made}, steps=steps)

    kinds = dict(df.dtypes)
    return df.mapInPandas(moved, ", ".join([*(f"`{c}` {kinds[c]}" for c in df.columns), "steps int"]))


def streamlines(df: DataFrame, h: float, most: int, velocity: Callable[[Column, Column], tuple[Column, Column]]) -> DataFrame:
    """id, step, x, y along an analytic velocity by the classical step; a line ends where the speed falls below 1e-10.

    Steps are cut, since nested steps would multiply in one expression."""
    out, live = None, df.select("id", "x", "y")
    for k in range(most + 1):
        rows = live.select("id", F.lit(k).alias("step"), "x", "y")
        out = rows if out is None else out.unionByName(rows)
        u, v = velocity(F.col("x"), F.col("y"))
        live = cut(live.where(F.sqrt(u * u + v * v) >= 1e-10), "lines")

        def slope(s: dict[str, Column], _: Column) -> dict[str, Column]:
            return dict(zip(("x", "y"), velocity(s["x"], s["y"]), strict=True))

        live = live.withColumns(explicit_step({"x": F.col("x"), "y": F.col("y")}, F.lit(0.0), h, slope))
    return out


def golden_section(f: Callable[[float], float], lo: float, hi: float, tolerance: float = 1e-8) -> float:
    """The place of a unimodal function's minimum."""
    ratio = (5**0.5 - 1) / 2
    a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    fa, fb = f(a), f(b)
    while hi - lo > tolerance:
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - ratio * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + ratio * (hi - lo)
            fb = f(b)
    return (lo + hi) / 2
