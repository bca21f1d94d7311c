"""Analytic expectations and numpy versions of what SQL cannot express."""

from __future__ import annotations

import base64
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.functions import geo, ocean
from pelagia.operators import ensemble, grid, interp, particles, qc, series, stats, stencil, transport
from pelagia.plans import registry
from pelagia.sources import generators, readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_solid_rotation_has_constant_vorticity_and_no_divergence(spark):
    d = stencil.with_velocity_gradients(generators.solid_rotation(spark, 12), 1 / 11, 1 / 11)
    row = d.agg(F.min(stencil.vorticity()).alias("a"), F.max(stencil.vorticity()).alias("b"), F.max(F.abs(stencil.divergence())).alias("d"), F.max(stencil.okubo_weiss()).alias("o")).first()
    assert row["a"] == pytest.approx(4) and row["b"] == pytest.approx(4)
    assert row["d"] == pytest.approx(0, abs=1e-9) and row["o"] == pytest.approx(-16)


def test_a_linear_field_is_exact(spark):
    d = generators.cells(spark, 8, 8).withColumn("c", 1 + 2.0 * F.col("i") + 3.0 * F.col("j"))
    g = stencil.with_gradients(d, ["c"], 1.0, 1.0).agg(F.min("c_x"), F.max("c_x"), F.min("c_y"), F.max("c_y")).first()
    assert [round(v, 9) for v in g] == [2, 2, 3, 3]
    assert stencil.laplacian(d, "c", 1.0, 1.0).where("laplacian IS NOT NULL").agg(F.max(F.abs("laplacian"))).first()[0] == pytest.approx(0)
    axes = interp.Axes(0.0, 0.0, 1.0, 8, 8)
    points = spark.createDataFrame([(1, 2.25, 3.5), (2, 7.0, 7.0), (3, 9.0, 1.0)], "id long, lon double, lat double").select("*", F.lit(0).alias("time_idx"), F.lit(0).alias("depth_idx"))
    got = {r["id"]: r["c"] for r in interp.bilinear(d, points, ["c"], axes).collect()}
    assert got[1] == pytest.approx(1 + 4.5 + 10.5) and got[2] == pytest.approx(1 + 14 + 21) and got[3] is None


def test_upwind_at_courant_one_shifts_by_a_cell(spark):
    d = generators.cells(spark, 8, 3).withColumns({"water_u": F.lit(1.0), "water_v": F.lit(0.0), "c": F.when(F.col("i") == 3, 1.0).otherwise(0.0)})
    rows = transport.euler_step(d, 1.0, 1.0, 1.0, 0.0).where("j = 1 AND c > 0").collect()
    assert [(r["i"], r["c"]) for r in rows] == [(4, 1.0)]


@pytest.mark.parametrize("scheme", ["upwind", "lax_wendroff", "muscl", "superbee", "quick", "weno5"])
def test_every_scheme_is_exact_on_a_line(spark, scheme):
    d = generators.cells(spark, 12, 12).withColumns({"water_u": F.lit(2.0), "water_v": F.lit(-1.0), "c": 3.0 * F.col("i") + 5.0 * F.col("j")})
    inner = transport.advection(d, scheme, 1.0, 1.0, 0.1).where("i BETWEEN 3 AND 8 AND j BETWEEN 3 AND 8")
    row = inner.agg(F.min("advection"), F.max("advection")).first()
    assert row[0] == pytest.approx(1.0, abs=1e-6) and row[1] == pytest.approx(1.0, abs=1e-6)


def test_gaspari_cohn_and_distances(spark):
    gc = lambda r: one(spark, ocean.gaspari_cohn(F.lit(float(r))))
    assert gc(0) == 1 and gc(2) == pytest.approx(0, abs=1e-12) and gc(3) == 0 and gc(1) == pytest.approx(gc(1.0000001), abs=1e-5)
    lit = F.lit
    assert one(spark, geo.haversine(lit(0.0), lit(0.0), lit(0.0), lit(1.0))) == pytest.approx(111194.93, abs=0.01)
    assert one(spark, geo.haversine(lit(None).cast("double"), lit(0.0), lit(0.0), lit(1.0))) is None
    zone = one(spark, geo.utm(lit(5.0), lit(60.0)))
    assert (zone["zone"], zone["hemisphere"]) == (31, "N") and one(spark, geo.utm(lit(180.0), lit(0.0)))["zone"] == 60
    with pytest.raises(NotImplementedError):
        geo.transform_point("UTM", "WGS84", lit(0.0), lit(0.0))


def test_running_statistics_keep_the_nominal_and_even_widths(spark):
    d = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, None, 3.0, 4.0, 10.0])], "key string, idx long, value double")
    rows = {r["idx"]: r for r in series.running(d, 2).collect()}
    assert rows[0]["running_mean"] == 1 and rows[3]["running_mean"] == pytest.approx(17 / 3) and rows[3]["running_median"] == 4
    with pytest.raises(ValueError):
        series.running(d, 0)


def test_gaps_longer_than_the_limit_stay(spark):
    d = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 1.0, None, 3.0, None, None, 6.0, None])], "key string, idx long, value double")
    got = [r["filled"] for r in series.fill_gaps(d, 1).orderBy("idx").collect()]
    assert got == [None, 1.0, 2.0, 3.0, None, None, 6.0, None]


def test_spline_and_spectrum_against_numpy(spark):
    x = np.arange(0, 10.0)
    assert series.natural_spline(x, 2 * x + 1, np.array([0.5, 4.25])) == pytest.approx([2.0, 9.5])
    y = np.sin(2 * np.pi * 0.125 * np.arange(64))
    d = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "key string, idx long, value double")
    top = series.spectrum(d).orderBy(F.desc("power")).first()
    assert top["frequency"] == pytest.approx(0.125)


def test_polynomial_surface_and_modes(spark):
    d = generators.cells(spark, 6, 6).select(F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y")).withColumn("z", 1 + 2 * F.col("x") - F.col("y") + 0.5 * F.col("x") * F.col("y"))
    powers, c = series.polynomial_surface(d)
    assert dict(zip(powers, np.round(c, 6).tolist(), strict=True)) == {(0, 0): 1.0, (0, 1): -1.0, (0, 2): 0.0, (1, 0): 2.0, (1, 1): 0.5, (2, 0): 0.0}
    e = spark.createDataFrame([(t, k, math.sin(t) * (k + 1.0)) for t in range(12) for k in range(4)], "step int, cell int, x double")
    assert series.orthogonal_modes(e.withColumn("block", F.lit(0)), 2).orderBy("mode").first()["variance_share"] == pytest.approx(1.0)


def test_implicit_diffusion_solves_its_equation(spark):
    d = generators.cells(spark, 7, 7).withColumn("c", F.when((F.col("i") == 3) & (F.col("j") == 3), 1.0).otherwise(0.0))
    got = np.zeros((7, 7))
    for r in transport.implicit_diffusion(d, 0.5, 1.0, 1.0, 1.0).collect():
        got[r["j"], r["i"]] = r["c"]
    lap = got[1:-1, 2:] + got[1:-1, :-2] + got[2:, 1:-1] + got[:-2, 1:-1] - 4 * got[1:-1, 1:-1]
    want = np.zeros((5, 5))
    want[2, 2] = 1
    assert np.allclose(got[1:-1, 1:-1] - 0.5 * lap, want, atol=1e-9)


def test_steady_state_stops(spark):
    d = generators.cells(spark, 4, 4).withColumns({"water_u": F.lit(0.0), "water_v": F.lit(0.0), "c": F.lit(2.0)})
    _, steps = transport.steady_state(d, lambda x: transport.euler_step(x, 0.1, 1.0, 1.0, 1.0))
    assert steps == 1


def test_rotation_keeps_its_radius(spark):
    p = spark.createDataFrame([(1, 0.6, 0.5), (2, 0.5, 0.4)], "id long, x double, y double")
    for r in particles.rotate_rk4(p, 2.0, 0.01, 5).collect():
        assert math.hypot(r["x"] - 0.5, r["y"] - 0.5) == pytest.approx(0.1, abs=1e-9)


def test_boundaries_of_particles(spark):
    p = spark.createDataFrame([(1, 1.25), (2, -0.25)], "id long, x double")
    assert [r["x"] for r in particles.bounded(p, {"x": (0.0, 1.0)}, True).orderBy("id").collect()] == [0.25, 0.75]
    assert not any(r["active"] for r in particles.bounded(p, {"x": (0.0, 1.0)}, False).collect())


def test_flags_overwrite_in_order_and_repair_fills(spark):
    d = generators.cells(spark, 4, 4, 3).withColumn("x", F.when((F.col("i") == 1) & (F.col("j") == 1) & (F.col("time_idx") == 1), None).otherwise(1.0))
    f = qc.flag(d, "x", (0.0, 2.0))
    assert {r["flag"]: r["count"] for r in f.groupBy("flag").count().collect()} == {qc.GOOD: 47, qc.MISSING: 1}
    fixed = qc.repair_in_time(f, "x").where(F.col("flag") == qc.INTERPOLATED).collect()
    assert [r["x"] for r in fixed] == [1.0]


def test_analysis_moves_towards_the_observations(spark):
    rng = np.random.default_rng(1)
    e = spark.createDataFrame([(m, 0, c, float(rng.normal())) for m in range(30) for c in range(6)], "member int, block long, cell int, x double")
    o = spark.createDataFrame([(0, 2, 3.0, 0.01)], "block long, cell int, y double, r double")
    mean = {r["cell"]: r["mean"] for r in ensemble.mean_and_spread(ensemble.analysis(e, o, 1.0)).collect()}
    assert mean[2] == pytest.approx(3.0, abs=0.1) and abs(mean[5]) < 1
    assert ensemble.analysis(e, o.where("false"), 1.0).count() == 180


def test_grid_helpers(spark):
    back = one(spark, grid.from_flat(grid.flat_index(F.lit(3), F.lit(2), F.lit(1), 5, 4), 5, 4))
    assert (back["i"], back["j"], back["k"]) == (3, 2, 1)
    assert one(spark, grid.z_to_sigma(grid.sigma_to_z(F.lit(0.3), F.lit(100.0), F.lit(1.0)), F.lit(100.0), F.lit(1.0))) == pytest.approx(0.3)


def test_payloads_requests_and_ranges(spark):
    raw = base64.b64encode(np.array([1.0, 2.0, np.nan, 4.0, 5.0, 6.0], dtype="<f8").tobytes()).decode()
    rows = readers.decode_grid(spark.createDataFrame([(7, raw)], "id long, payload string"), "payload", 3).collect()
    assert {(r["j"], r["i"]): r["value"] for r in rows} == {(0, 0): 1.0, (0, 1): 2.0, (0, 2): None, (1, 0): 4.0, (1, 1): 5.0, (1, 2): 6.0}
    q = readers.requests(spark.createDataFrame([('{"action": "get", "parameters": {"a": "1"}}',), ("no json",)], "value string")).collect()
    assert q[0]["action"] == "get" and q[0]["parameters"] == {"a": "1"} and q[1]["action"] is None
    assert readers.date_range(spark, "2008-04-01", "2008-04-07").count() == 7


def test_writers_and_texts(spark, tmp_path):
    d = generators.gaussian_vortex(spark)
    for fmt in ("parquet", "csv", "json"):
        sinks.write(d, f"{tmp_path}/{fmt}", fmt, ["j", "i", "water_u"])
    assert spark.read.parquet(f"{tmp_path}/parquet").columns == ["j", "i", "water_u"]
    with pytest.raises(ValueError):
        sinks.write(d, f"{tmp_path}/x", "netcdf")
    feature = json.loads(sinks.vector_lines(d, 5).first()["value"])
    assert feature["type"] == "Feature" and len(feature["geometry"]["coordinates"]) == 2
    text = sinks.json_rows(spark.createDataFrame([(1, float("nan"))], "a int, b double")).first()["value"]
    assert json.loads(text) == {"a": 1, "b": None}
    assert sinks.vtk_grid_header(2, 3, 1, "c")[4] == "DIMENSIONS 2 3 1"


def test_registry_runs_and_refuses(spark, tmp_path):
    generators.gaussian_vortex(spark).write.parquet(f"{tmp_path}/f")
    assert registry.run(spark, "get_statistics", f"{tmp_path}/f").first()["valid"] == 500
    assert registry.run(spark, "calculate_vorticity_divergence", f"{tmp_path}/f", {"dx": 1.0, "dy": 1.0}).count() == 500
    for action, given in (("unknown", {}), ("calculate_vorticity_divergence", {})):
        with pytest.raises(ValueError):
            registry.run(spark, action, f"{tmp_path}/f", given)


def test_empty_fields_do_not_fail(spark):
    d = generators.gaussian_vortex(spark).where("false")
    assert stencil.with_velocity_gradients(d, 1.0, 1.0).count() == 0
    assert stencil.median_filter(d, "water_u", 25, 20).count() == 0
    assert registry.stats.field_statistics(d).first()["valid"] == 0


def test_runge_kutta_methods_reach_their_order(spark):
    from pelagia.operators import ode

    y, f = np.array([[1.0, 2.0]]), lambda y, t: -y
    for name, t in ode.METHODS.items():
        errors = []
        for n in (8, 16):
            x = y
            for k in range(n):
                x = ode.batch_step(x, k / n, 1 / n, f, t)
            errors.append(float(np.abs(x - y * math.exp(-1)).max()))
        assert math.log2(errors[0] / errors[1]) > t.order - 0.4, name
        assert sum(t.b) == pytest.approx(1) and (t.lower is None or sum(t.lower) == pytest.approx(1))
    got, steps = ode.adaptive(y, 0.0, 1.0, f, 1e-10, 0.1)
    assert np.allclose(got, y * math.exp(-1), atol=1e-8) and steps > 5
    with pytest.raises(ValueError):
        ode.explicit_step({}, F.lit(0.0), 0.1, lambda s, t: s, ode.GAUSS1)
    assert ode.golden_section(lambda x: (x - 2) ** 2, 0, 5) == pytest.approx(2, abs=1e-6)


def test_modes_of_each_block_equal_a_decomposition(spark):
    rng = np.random.default_rng(8)
    data = {b: rng.standard_normal((6, 9)) for b in (1, 2)}
    rows = [(b, s, c, float(x[s, c])) for b, x in data.items() for s in range(6) for c in range(9)]
    got = series.orthogonal_modes(spark.createDataFrame(rows, "block long, step int, cell int, x double"), 2).collect()
    for b, x in data.items():
        u, d, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
        for k in range(2):
            r = next(r for r in got if r["block"] == b and r["mode"] == k)
            assert r["variance"] == pytest.approx(d[k] ** 2 / 5) and np.abs(np.dot(r["pattern"], v[k])) == pytest.approx(1)


def test_spline_passes_its_points_and_ends_straight():
    rng = np.random.default_rng(9)
    x = np.sort(rng.random(200)) * 100
    y = np.sin(x)
    assert series.natural_spline(x, y, x) == pytest.approx(y)
    n, h = len(x), np.diff(x)
    a = np.zeros((n, n))
    a[0, 0] = a[-1, -1] = 1
    for k in range(1, n - 1):
        a[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
    m = np.linalg.solve(a, np.r_[0, 6 * np.diff(np.diff(y) / h), 0])
    mid = (x[1:] + x[:-1]) / 2
    want = (y[1:] + y[:-1]) / 2 - h * h / 16 * (m[1:] + m[:-1])
    assert series.natural_spline(x, y, mid) == pytest.approx(want)


def test_nearest_index_of_uneven_axes(spark):
    axis = [0.0, 1.0, 1.5, 10.0]
    x = [-5.0, 0.5, 0.500001, 1.25, 1.3, 5.75, 5.76, 99.0, None]
    points = spark.createDataFrame(list(enumerate(x)), "id long, x double")
    got = {r["id"]: r["nearest_idx"] for r in interp.nearest_index(spark.createDataFrame([(k, v) for k, v in enumerate(axis)], "idx long, value double"), points, "x").collect()}
    assert got == {i: None if v is None else int(np.argmin(np.abs(np.array(axis) - v))) for i, v in enumerate(x)}
    assert interp.nearest_index(spark.createDataFrame([], "idx long, value double"), points, "x").where("nearest_idx is null").count() == 9


@pytest.mark.parametrize("bins", [7, 4096])
def test_quantiles_equal_those_of_numpy(spark, bins):
    rng = np.random.default_rng(3)
    shares = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    for x in (rng.normal(size=501), np.r_[np.zeros(400), rng.normal(size=100)], np.array([-1.7e308, 0.0, 5e-324, 1.0, 1.7e308]), np.array([3.0]), np.full(20, 2.5)):
        d = spark.createDataFrame([(float(v),) for v in x] + [(None,), (math.nan,), (math.inf,)], "x double")
        assert stats.quantiles(d, "x", shares, bins) == pytest.approx([np.quantile(x / 2, s) * 2 for s in shares], rel=1e-12)
    assert stats.quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5, 0.9], bins) == [None, None]


def test_rk4_drift_keeps_the_radius_where_euler_leaves_it(spark):
    axes = interp.Axes(0.0, -0.1, 0.01, 21, 21)
    turn = [(t, 0, j, i, -0.01 * (j - 10.0), 0.01 * (i - 10.0)) for t in range(3) for j in range(21) for i in range(21)]
    field = spark.createDataFrame(turn, "time_idx int, depth_idx int, j int, i int, water_u double, water_v double")
    start = spark.createDataFrame([(1, 0.15, 0.0), (2, 0.199, 0.09)], "id long, lon double, lat double")
    radius = lambda d: [math.hypot(r["lon"] - 0.1, r["lat"]) for r in d.where("id = 1").orderBy("step").collect()]
    good, plain = radius(particles.drift_rk4(field, start, axes, 3)), radius(particles.drift(field, start, axes, 3))
    assert len(good) == 4 and good[3] == pytest.approx(0.05, rel=5e-3)
    assert abs(plain[3] - 0.05) > 10 * abs(good[3] - 0.05)
