"""Mode splitting, work along lines and local analyses against numpy and analytic values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.operators import ensemble, lines, split
from pelagia.sources import generators


def grid(spark, n_x, n_y, n_z=1, **columns):
    return generators.cells(spark, n_x, n_y, 1, n_z).select("time_idx", "depth_idx", "j", "i", *(c.alias(k) for k, c in columns.items()))


def array(df, name, *shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[tuple(r[k] for k in ("depth_idx", "j", "i")[-len(shape):])] = r[name]
    return out


def waves(spark, n_x=23, n_y=17, n_z=3):
    layers = grid(
        spark, n_x, n_y, n_z,
        u=F.sin(F.col("i") * 0.3 + F.col("depth_idx")) * 0.1, v=F.cos(F.col("j") * 0.2 - F.col("depth_idx")) * 0.1,
        dz=F.lit(10.0), density=1025.0 + F.col("depth_idx") + F.col("i") * 0.01,
    )
    surface = grid(spark, n_x, n_y, eta=F.exp(-((F.col("i") - 9.0) ** 2 + (F.col("j") - 8.0) ** 2) / 9.0)).drop("depth_idx")
    return layers, surface


@pytest.mark.parametrize("tile", [512, 7])
def test_a_split_step_keeps_water_and_tiles_do_not_show(spark, tile):
    layers, surface = waves(spark)
    new, eta = split.split_step(layers, surface, 60.0, 4, 1000.0, 1000.0, 1e-4, 1e-3, tile=tile)
    before, after = array(surface, "eta", 17, 23), array(eta, "eta", 17, 23)
    assert abs(before.sum() - after.sum()) < 1e-9 and np.abs(after - before).max() > 1e-3
    mean = {c: array(split.depth_mean(split.slow_forces(layers, 1000.0, 1000.0, 1e-3), "u", "v", "gx", "gy"), c, 17, 23) for c in ("u", "v", "gx", "gy", "h")}
    want, mean_u, mean_v = split.sub_stepped(mean | {"eta": before}, 60.0, 4, 1000.0, 1000.0, 1e-4)
    assert np.allclose(after, want, rtol=0, atol=1e-13)
    got = split.depth_mean(new, "u", "v")
    assert np.allclose(array(got, "u", 17, 23), mean_u, rtol=0, atol=1e-13) and np.allclose(array(got, "v", 17, 23), mean_v, rtol=0, atol=1e-13)


def test_layers_keep_their_shear_and_splitting_adds_up(spark):
    layers, surface = waves(spark, 9, 8)
    mean, rest = split.split(layers)
    both = rest.join(mean.withColumnsRenamed({"u": "mu"}).drop("v", "h"), ["time_idx", "j", "i"]).withColumn("u", F.col("u") + F.col("mu"))
    assert np.allclose(array(both, "u", 3, 8, 9), array(layers, "u", 3, 8, 9))
    assert np.abs(array(split.depth_mean(rest, "u", "v"), "u", 8, 9)).max() < 1e-15
    # without forces and rotation the layers' deviations do not change, whatever the surface does
    new, _ = split.split_step(layers.drop("density"), surface, 30.0, 3, 1000.0, 1000.0, 0.0)
    assert np.allclose(array(split.split(new)[1], "u", 3, 8, 9), array(rest, "u", 3, 8, 9), rtol=0, atol=1e-14)


def test_a_long_wave_runs_at_its_speed(spark):
    """A standing wave in a closed basin swings back after its period 2 L / sqrt(g h)."""
    n, dx, h = 60, 1000.0, 10.0
    eta = np.tile(0.01 * np.cos(np.pi * (np.arange(n) + 0.5) / n), (3, 1))
    held = {"eta": eta, "u": np.zeros_like(eta), "v": np.zeros_like(eta), "h": np.full_like(eta, h), "gx": np.zeros_like(eta), "gy": np.zeros_like(eta)}
    period = 2 * n * dx / np.sqrt(9.81 * h)
    half, _, _ = split.sub_stepped(held, period / 2, 400, dx, dx, 0.0)
    assert np.abs(half + eta).max() < 3e-4


def test_tridiagonal_systems_equal_dense_ones():
    rng = np.random.default_rng(1)
    lower, main, upper, right = rng.random(9), 4 + rng.random(9), rng.random(9), rng.random((5, 9))
    dense = np.diag(main) + np.diag(lower[1:], -1) + np.diag(upper[:-1], 1)
    assert np.allclose(lines.tridiagonal(lower, main, upper, right), np.linalg.solve(dense, right.T).T)


def alternating(c, dt, k, n_steps):
    """The same scheme with dense matrices."""
    n_y, n_x = c.shape

    def second(n):
        a = np.diag(np.full(n, -2.0)) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
        a[[0, -1]] = 0
        return a

    ax, ay, r = second(n_x), second(n_y), dt * k / 2
    for _ in range(n_steps):
        half = c.copy()
        half[1:-1] = np.linalg.solve(np.eye(n_x) - r * ax, (c + r * ay @ c * np.pad(np.ones(n_x - 2), 1))[1:-1].T).T
        new = half.copy()
        new[:, 1:-1] = np.linalg.solve(np.eye(n_y) - r * ay, (half + r * (half @ ax.T) * np.pad(np.ones(n_y - 2), 1)[:, None])[:, 1:-1])
        c = new
    return c


@pytest.mark.parametrize(("bundle", "n_steps"), [(64, 1), (3, 6)])
def test_alternating_directions_equal_dense_matrices(spark, bundle, n_steps):
    d = grid(spark, 12, 9, c=((F.col("i") * 7 + F.col("j") * 5) % 11).cast("double"))
    got = array(lines.alternating_diffusion(d, 2.0, 1.0, 1.0, 0.7, 12, 9, n_steps, bundle), "c", 9, 12)
    assert np.allclose(got, alternating(array(d, "c", 9, 12), 2.0, 0.7, n_steps))


def test_alternating_directions_are_of_second_order():
    """Errors against the exact decay of a mode fall by four when dt is halved."""
    n, end = 33, 8.0
    wave = np.sin(np.pi * np.arange(n) / (n - 1))
    rate = 2 * (2 - 2 * np.cos(np.pi / (n - 1)))
    exact = np.outer(wave, wave) * np.exp(-rate * 20.0 * end)
    errors = [np.abs(alternating(np.outer(wave, wave), end / k, 20.0, k) - exact).max() for k in (4, 8, 16)]
    assert 3.7 < errors[0] / errors[1] < 4.3 and 3.7 < errors[1] / errors[2] < 4.3


def brute_local(x, at, y, r, radius):
    """Each cell's dense gain in the space of cells, observation errors grown by their distance; the mean and covariance."""
    n, k = x.shape
    dev = x - x.mean(axis=1, keepdims=True)
    p = dev @ dev.T / (k - 1)
    mean, var = x.mean(axis=1).copy(), np.diag(p).copy()
    for c in range(n):
        w = ensemble._gaspari_cohn(np.abs(at - c) / radius)
        o = at[w > 0]
        if len(o):
            gain = p[c, o] @ np.linalg.inv(p[np.ix_(o, o)] + np.diag(r[w > 0] / w[w > 0]))
            mean[c] += gain @ (y[w > 0] - x.mean(axis=1)[o])
            var[c] -= gain @ p[o, c]
    return mean, var


@pytest.mark.parametrize(("radius", "per_task"), [(3.0, 4096), (3.0, 5), (1e7, 4096)])
def test_local_analyses_equal_dense_gains(spark, radius, per_task):
    rng = np.random.default_rng(2)
    n, k = 40, 8
    x = rng.standard_normal((n, k)).cumsum(axis=0)
    at, y, r = np.array([3, 4, 11, 30, 39]), rng.standard_normal(5), np.array([0.5, 0.2, 0.3, 1.0, 0.4])
    ens = spark.createDataFrame([(m, 5, c, float(x[c, m])) for c in range(n) for m in range(k)], "member int, block long, cell int, x double")
    # a cell's observation given as two of twice the error variance, around it
    rows = [(5, int(c), float(v + s), float(2 * e)) for c, v, e in zip(at, y, r, strict=True) for s in (-0.5, 0.5)] + [(5, 7, None, 1.0), (9, 0, 1.0, 1.0)]
    made = ensemble.local_analysis(ens, spark.createDataFrame(rows, "block long, cell int, y double, r double"), radius, cells_per_task=per_task)
    got = np.zeros((n, k))
    for row in made.collect():
        got[row["cell"], row["member"]] = row["x"]
    mean, var = brute_local(x, at, y, r, radius)
    assert np.allclose(got.mean(axis=1), mean) and np.allclose(got.var(axis=1, ddof=1), var)


def test_local_analysis_of_one_large_block(spark):
    n, k = 100_000, 4
    ens = spark.range(n * k).selectExpr("CAST(id % 4 AS INT) AS member", "0L AS block", "CAST(id DIV 4 AS INT) AS cell", "CAST(xxhash64(id) % 1000 AS DOUBLE) / 1000 AS x")
    obs = spark.range(0, n, 10).selectExpr("0L AS block", "CAST(id AS INT) AS cell", "0.5D AS y", "0.1D AS r")
    made = ensemble.local_analysis(ens, obs, 5.0)
    assert made.agg(F.count("*"), F.count_if(F.col("x").isNull() | F.isnan("x"))).first() == (n * k, 0)
    assert made.groupBy("cell").agg(F.abs(F.avg("x") - 0.5).alias("e")).agg(F.avg("e")).first()[0] < ens.groupBy("cell").agg(F.abs(F.avg("x") - 0.5).alias("e")).agg(F.avg("e")).first()[0]
