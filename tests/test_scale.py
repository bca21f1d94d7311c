"""Work that must not grow with single rows or with copies of a point: solvers on batches, lookups and pairs by class."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.operators import interp, ode, series, stats


def test_adaptive_rows_take_steps_of_their_own():
    y = np.array([[1.0, 2.0], [100.0, -3.0], [0.0, 0.0]])
    f = lambda y, t: -y * (1 + t)
    calls = []
    got, steps = ode.adaptive(y, 0.0, 1.0, lambda y, t: calls.append(len(y)) or f(y, t), 1e-9, 0.1)
    alone = [ode.adaptive(row[None], 0.0, 1.0, f, 1e-9, 0.1) for row in y]
    assert np.array_equal(got, np.concatenate([a for a, _ in alone])) and steps.tolist() == [int(n[0]) for _, n in alone]
    assert len(set(steps.tolist())) > 1 and max(calls) == 3
    assert np.allclose(got, y * np.exp(-1.5), atol=1e-6)


def test_adaptive_solver_takes_systems_of_several_sizes(spark):
    d = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, [4.0])], "id long, y array<double>").coalesce(1)
    got = {r.id: r.y for r in ode.solve_adaptive(d, "y", 1.0, lambda y, t: -y, 1e-9).collect()}
    assert {k: len(v) for k, v in got.items()} == {1: 1, 2: 2, 3: 1} and got[3][0] == pytest.approx(4 * np.exp(-1))


def test_implicit_steps_solve_all_rows_in_one_call(monkeypatch):
    y, solve, calls = np.random.default_rng(1).normal(size=(500, 2)), np.linalg.solve, []
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: calls.append(a.shape) or solve(a, b))
    got = ode.batch_step(y, 0.0, 0.1, lambda y, t: y * [-1.0, -20.0], ode.GAUSS2)
    pade = lambda z: (1 + z / 2 + z * z / 12) / (1 - z / 2 + z * z / 12)
    assert np.allclose(got, y * [pade(-0.1), pade(-2.0)], atol=1e-10) and len(calls) <= 25


def test_each_point_looks_for_its_own_wet_cell(spark):
    axes = interp.Axes(0.0, 0.0, 1.0, 12, 12)
    wet = [(j, i) for j in range(12) for i in range(12) if (i * 5 + j * 3) % 11 == 0]
    cells = spark.createDataFrame([(j, i, float(j), float(i)) for j, i in wet], "j int, i int, lat double, lon double")
    rows = [(k // 2, x, y) for k, (x, y) in enumerate((x * 0.7 - 1, y * 0.9 - 1) for x in range(20) for y in range(16))]
    got = sorted(interp.wet_cell_fix(spark.createDataFrame(rows, "id long, lon double, lat double"), cells, axes, 2).collect(), key=lambda r: (r.lon, r.lat))

    def wanted(x, y):
        x, y = min(11.0, max(0.0, x)), min(11.0, max(0.0, y))
        ci, cj = math.ceil(x - 0.5), math.ceil(y - 0.5)
        near = [(max(abs(i - ci), abs(j - cj)), (i - x) ** 2 + (j - y) ** 2, j, i) for j, i in wet]
        ring, _, j, i = min(n for n in near if n[0] <= 2) if any(n[0] <= 2 for n in near) else (None,) * 4
        return j, i, ring

    assert [(r.j, r.i, r.ring) for r in got] == [wanted(r.lon, r.lat) for r in got] and len(got) == 320


def odd_points(spark):
    """Copies of places, repeated and null ids, null coordinates."""
    rows = [(k, k % 7 * 0.5, k % 3 * 0.5) for k in range(150)] + [(4, 0.0, 0.0), (4, 0.0, 0.0), (4, 1.0, 0.5), (None, 0.5, 0.0), (200, None, 0.0), (201, 0.5, float("nan"))]
    return rows, spark.createDataFrame(rows, "id long, x double, y double")


def far(p, q):
    return None if None in (*p[1:], *q[1:]) else math.sqrt((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2)


def in_order(rows):
    return sorted(tuple(map(str, r)) for r in rows)


def test_pair_summary_counts_pairs_of_places(spark):
    rows, points = odd_points(spark)
    got = stats.pair_summary(points, 0.75, cell=0.75).first()
    near = [far(p, q) for p in rows for q in rows if p[0] is not None and q[0] is not None and p[0] < q[0] and far(p, q) is not None and far(p, q) <= 0.75]
    assert got.pairs == len(near) and got["mean"] == pytest.approx(np.mean(near)) and got["std"] == pytest.approx(np.std(near))
    one_place = spark.range(60_000).selectExpr("id", "1.5D AS x", "2D AS y")
    assert stats.pair_summary(one_place, 0.1).first().pairs == 60_000 * 59_999 // 2
    assert tuple(stats.pair_summary(points.limit(0), 0.1).first()) == (0, None, None)


def test_distance_pairs_keep_every_pair(spark):
    rows, points = odd_points(spark)
    text = lambda p, q: None if far(p, q) is None else round(far(p, q), 3)
    every = [(p[0], q[0], text(p, q)) for p in rows for q in rows]
    got = stats.distance_pairs(points, points, digits=3, piece=8)
    assert in_order(map(tuple, got.collect())) == in_order(every)
    near = [(p[0], q[0], text(p, q)) for p in rows for q in rows if far(p, q) is not None and far(p, q) <= 0.5]
    assert in_order(map(tuple, stats.distance_pairs(points, points, most=0.5, cell=0.5, digits=3, piece=8).collect())) == in_order(near)


def test_places_are_compared_once_for_many_points(spark):
    """10 places of 64 copies: places meet, and their points are written out behind the join."""
    points = spark.range(640).selectExpr("id", "CAST(id % 10 AS DOUBLE) AS x", "0D AS y")
    plan = stats.distance_pairs(points, points, most=0.5, digits=6)
    assert plan.count() == 10 * 64 * 64
    assert plan._jdf.queryExecution().executedPlan().toString().count("Generate explode(ids_") == 2


@pytest.mark.parametrize("most", [0.5, None])
def test_pairs_of_two_pieces_are_held_at_a_time(spark, most):
    """Not those of a piece with all that it meets, as in code that joins and explodes at once."""
    points = spark.range(300).selectExpr("id", "CAST(id % 3 AS DOUBLE) AS x", "CAST(id % 2 AS DOUBLE) AS y")
    pairs = stats.distance_pairs(points, points, most=most, digits=6)
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    stage = lambda node: set(re.findall(rf"\*\((\d+)\) {node}", plan))
    assert stage("SortMergeJoin") and stage(r"Generate explode\(ids_b") and stage("SortMergeJoin").isdisjoint(stage("Generate"))


@pytest.mark.parametrize("most", [0.5, None])
def test_pairs_are_dealt_evenly(spark, most):
    """10 places of 640 points: no task has more than a small share of the pairs, so that none is waited for."""
    points = spark.range(6400).selectExpr("id", "CAST(id % 10 AS DOUBLE) AS x", "CAST(id % 5 AS DOUBLE) AS y")
    pairs = stats.distance_pairs(points, points, most=most, digits=6)
    sizes = [r["n"] for r in pairs.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == (10 * 640 * 640 if most else 6400 * 6400) and max(sizes) <= 0.08 * sum(sizes)


def test_tapers_of_long_series_are_those_of_the_whole_matrix(monkeypatch):
    n = 20_000
    whole = series.prolate_tapers(n)
    monkeypatch.setattr(series, "prolate_tapers", lambda n: pytest.fail("a matrix as long as the series"))
    for a, b in zip(series.tapers(n, 1 << 12), whole, strict=True):
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
