"""Coupled models and the set-up of filters against numpy and analytic values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.operators import assimilation, coupled
from pelagia.sources import generators, synthetic


def test_a_3d_step_equals_numpy(spark):
    n, nz, dt = 8, 3, 0.5
    d = generators.cells(spark, n, n, 1, nz).withColumns({"c": ((F.col("i") * 7 + F.col("j") * 5 + F.col("depth_idx") * 3) % 11).cast("double"), "water_u": F.when(F.col("i") < 4, 0.3).otherwise(-0.2), "water_v": F.lit(0.1)})
    s = spark.createDataFrame([(1, 2, 3, 4.0, 0.0, 9.0), (1, 2, 3, 1.0, 5.0, 9.0)], "depth_idx int, j int, i int, intensity double, t_start double, t_end double")
    got = np.zeros((nz, n, n))
    for row in coupled.dispersion_3d_step(d, dt, 1.0, 1.0, (n, n, nz), 0.5, 0.3, s, 1.0, 0.01).collect():
        got[row["depth_idx"], row["j"], row["i"]] = row["c"]
    z, j, i = np.meshgrid(range(nz), range(n), range(n), indexing="ij")
    c = ((i * 7 + j * 5 + z * 3) % 11).astype(float)
    u, new = np.where(i < 4, 0.3, -0.2), c.copy()
    x = np.where(u[:, :, 1:-1] > 0, c[:, :, 1:-1] - c[:, :, :-2], c[:, :, 2:] - c[:, :, 1:-1])
    new[:, :, 1:-1] -= dt * u[:, :, 1:-1] * x
    new[:, 1:-1, :] -= dt * 0.1 * (c[:, 1:-1, :] - c[:, :-2, :])

    def spread(a, axis, sigma):
        reach = int(4 * sigma + 0.5)
        w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
        padded = np.pad(a, [(reach, reach) if k == axis else (0, 0) for k in range(3)], mode="symmetric")
        return sum(w[k] / w.sum() * np.take(padded, range(k, k + a.shape[axis]), axis) for k in range(2 * reach + 1))

    for axis, diffusivity in ((2, 0.5), (1, 0.5), (0, 0.3)):
        new = spread(new, axis, np.sqrt(2 * diffusivity * dt))
    new[1, 2, 3] += 4.0 * dt
    assert np.allclose(got, new * np.exp(-0.01 * dt))


def test_sub_steps_follow_the_fastest_component(spark):
    d = spark.createDataFrame([(0.5, -2.0), (None, None)], "water_u double, water_v double")
    assert coupled.sub_steps(d, 100.0, 100.0) == 7 and coupled.sub_steps(d.limit(0), 100.0, 100.0) == 1


def test_the_layered_ocean_fades_with_depth_and_keeps_continuity(spark):
    rows = {(r["depth_idx"], r["j"], r["i"]): r for r in synthetic.layered_ocean(spark, 10, 10, 3).collect()}
    assert len(rows) == 300 and all(rows[0, j, i]["w"] == 0 for j in range(10) for i in range(10))
    assert rows[2, 4, 4]["u"] == pytest.approx(rows[0, 4, 4]["u"] * np.exp(-2))
    ux = (rows[1, 4, 5]["u"] - rows[1, 4, 3]["u"]) / 2
    vy = (rows[1, 5, 4]["v"] - rows[1, 3, 4]["v"]) / 2
    assert rows[1, 4, 4]["w"] == pytest.approx(-(ux + vy) * 50)


def test_the_first_ensemble_has_the_given_moments(spark, tmp_path):
    mean = spark.createDataFrame([(0, 0, 1.0), (0, 1, -1.0)], "block long, cell int, mean double")
    p = spark.createDataFrame([(0, 0, 0, 2.0), (0, 0, 1, 0.8), (0, 1, 1, 1.0)], "block long, r int, c int, covariance double")
    e = assimilation.initial_ensemble(mean, p, 4000)
    x = e.toPandas().pivot(index="cell", columns="member", values="x").to_numpy()
    assert np.allclose(x.mean(axis=1), [1, -1], atol=0.1) and np.allclose(np.cov(x), [[2, 0.8], [0.8, 1]], atol=0.15)
    assert assimilation.positive_definite(p).first()["positive"]
    worse = p.withColumn("covariance", F.when(F.col("r") < F.col("c"), 3.0).otherwise(F.col("covariance")))
    assert not assimilation.positive_definite(worse).first()["positive"]
    settings = assimilation.Settings.read({"ensemble_size": 4000, "inflation": None, "other": 1})
    assert settings.faults() == ["ensemble_size"] and assimilation.Settings(inflation=4.0).faults() == ["inflation"]
    for cycle in (1, 2):
        assimilation.save_state(e.withColumn("x", F.lit(float(cycle))), settings, cycle, f"{tmp_path}/state")
    back, same, cycle = assimilation.load_state(spark, f"{tmp_path}/state")
    assert cycle == 2 and same == settings and back.columns == e.columns and back.agg(F.max("x"), F.min("x")).first()[:] == (2.0, 2.0)


def tables(spark, name):
    """How many step tables of a name lie in the shared folder."""
    import os

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + f"/steps/{spark.sparkContext.applicationId}"
    return sum(d.startswith(name) for d in os.listdir(folder)) if os.path.isdir(folder) else 0


def test_steps_that_nothing_reads_any_more_go(spark):
    from pelagia.operators import interp, transport

    n = 6
    d = generators.cells(spark, n, n, 2, 1).select("time_idx", "depth_idx", "j", "i").withColumns({"u": F.lit(0.01) * (F.col("time_idx") + 1), "v": F.lit(0.02), "eta": F.lit(0.0), "c": (F.col("i") + F.col("j")).cast("double")})
    p = spark.createDataFrame([(1, 2.0, 2.0, 0), (2, 3.0, 2.5, 0), (1, 2.0, 2.0, 1)], "id long, lon double, lat double, time_idx int")
    axes = interp.Axes(0.0, 0.0, 1.0, n, n)
    made = {}
    for every in (1, 3):
        before = tables(spark, "coupled-state")
        steps = list(coupled.coupled(d, p, axes, 4, 1.0, 1000.0, 1e-4, every=every))
        assert [k for k, _, _ in steps] == ([1, 2, 3, 4] if every == 1 else [3, 4])
        assert tables(spark, "coupled-state") - before == len(steps)
        made[every] = sorted(tuple(r) for r in steps[-1][2].collect()), sorted((r.time_idx, r.j, r.i, r.c) for r in steps[-1][1].collect())
    assert made[1] == made[3]
    # the runs of both times are apart: the second one's water is twice as fast along x
    moved = {(r[0], r[1]): r[2] for r in made[1][0]}
    assert moved[1, 1] - 2.0 == pytest.approx(2 * (moved[1, 0] - 2.0), rel=1e-2)
    before = tables(spark, "step-")
    left = transport.run(d.withColumns({"water_u": F.col("u"), "water_v": F.col("v")}), 9, lambda x, _: transport.euler_step(x, 1.0, 10.0, 10.0, 1.0), cut_every=2)
    assert left.count() == 2 * n * n and tables(spark, "step-") - before == 1
