"""Particles with their own time steps against a plain loop for each particle."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.operators import adaptive, interp
from pelagia.sources import generators

N, H = 21, 0.1
AXES = interp.Axes(0.0, 0.0, H, N, N)


@pytest.fixture(scope="module")
def field(spark):
    """Two times of a swirl whose strength falls towards its middle, with land in one corner."""
    d = generators.cells(spark, N, N, 2, 1).select("time_idx", "depth_idx", "j", "i")
    x, y = F.col("i") * H - 1.0, F.col("j") * H - 1.0
    strong = (1.0 + F.col("time_idx")) * F.exp(-(x * x + y * y))
    land = (F.col("i") > 17) & (F.col("j") > 17)
    return d.withColumns({"water_u": F.when(~land, -y * strong), "water_v": F.when(~land, x * strong)})


def plain(grid, lon, lat, end, dt, tolerance, time_idx, interval=None):
    """The same rule for one particle, in a loop."""

    def velocity(t, x, y):
        u = grid[t]
        if not (0 <= x <= AXES.lon1 and 0 <= y <= AXES.lat1):
            return np.zeros(2)
        i, j = min(int(x / H), N - 2), min(int(y / H), N - 2)
        fx, fy = x / H - i, y / H - j
        return u[j, i] * (1 - fx) * (1 - fy) + u[j, i + 1] * fx * (1 - fy) + u[j + 1, i] * (1 - fx) * fy + u[j + 1, i + 1] * fx * fy

    p, t, step, n, tried, worst = np.array([lon, lat]), 0.0, dt, 0, 0, 0.0
    while t < end:
        h, tried = min(step, end - t), tried + 1
        now = int(t // interval) if interval else time_idx
        a = velocity(now, *p)
        half = p + a * h / 2
        b = velocity(now, *half)
        new = half + b * h / 2
        e = float(np.hypot(*(new - p - a * h)))
        if e <= tolerance or h <= dt * adaptive.LEAST:
            t = end if h == end - t else t + h
            p, n, worst = new, n + 1, max(worst, e)
            step = min(step * adaptive.GROW, dt * adaptive.MOST) if e < tolerance * adaptive.EASY else step
        else:
            step = max(h * adaptive.SHRINK, dt * adaptive.LEAST)
    return (*p, n, tried, worst)


@pytest.mark.parametrize(("interval", "tolerance"), [(None, 3e-3), (1.5, 2e-3), (None, 1e-12)])
def test_all_arrive_as_a_plain_loop_does(spark, field, interval, tolerance):
    end, dt = (3.0, 0.5) if tolerance > 1e-9 else (0.02, 0.5)
    rng = np.random.default_rng(4)
    rows = [(k, float(x), float(y), k % 2) for k, (x, y) in enumerate(rng.uniform(0.05, 1.95, (40, 2)))] + [(99, 5.0, 5.0, 0)]
    particles = spark.createDataFrame(rows, "id long, lon double, lat double, time_idx int")
    cells = interp.corners(field, ["water_u", "water_v"])
    made = adaptive.to_end(particles.drop("time_idx") if interval else particles, cells, AXES, end, dt, tolerance, interval)
    got = {r.id: (r.lon, r.lat, r.n_steps, r.n_tried, r.error) for r in made.collect()}
    grid = np.zeros((2, N, N, 2))
    for r in field.collect():
        grid[r.time_idx, r.j, r.i] = (r.water_u or 0.0, r.water_v or 0.0)
    assert set(got) == {r[0] for r in rows}
    for k, x, y, t in rows:
        want = plain(grid, x, y, end, dt, tolerance, t, interval)
        assert np.allclose(got[k], want, rtol=0, atol=1e-9), k
        assert got[k][4] <= tolerance or tolerance < 1e-9
        assert got[k][3] <= adaptive.rounds_bound(end, dt)


def test_steps_follow_the_curvature(spark, field):
    """A stricter tolerance takes more steps, and still water is crossed in the largest ones."""
    cells = interp.corners(field, ["water_u", "water_v"])
    p = spark.createDataFrame([(1, 1.3, 1.0, 0), (2, 1.95, 1.95, 0)], "id long, lon double, lat double, time_idx int")
    loose, strict = ({r.id: r.n_steps for r in adaptive.to_end(p, cells, AXES, 4.0, 0.25, t).collect()} for t in (1e-1, 3e-3))
    assert strict[1] > 1.5 * loose[1] and loose[2] == strict[2] == math.ceil((4.0 - 0.25 - 0.375) / 0.5) + 2


def test_an_end_in_the_past_is_refused(spark, field):
    with pytest.raises(ValueError):
        adaptive.to_end(spark.createDataFrame([(1, 1.0, 1.0, 0)], "id long, lon double, lat double, time_idx int"), field, AXES, 0.0, 1.0, 1.0)
