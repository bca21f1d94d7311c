"""Quadtrees, radial patches and leading modes against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.operators import interp, quadtree, series
from pelagia.sources import generators


def leaves_of(df):
    return {(r.level, r.y, r.x): r.value for r in df.collect()}


def around(leaf, leaves):
    """The leaves behind each side of a leaf, by geometry."""
    level, y, x = leaf
    s = 2.0**-level
    box = (y * s, y * s + s, x * s, x * s + s)
    out = {k: [] for k in quadtree.SIDES}
    for other in leaves:
        t = 2.0 ** -other[0]
        o = (other[1] * t, other[1] * t + t, other[2] * t, other[2] * t + t)
        along_y, along_x = min(box[1], o[1]) > max(box[0], o[0]), min(box[3], o[3]) > max(box[2], o[2])
        for side, touches in (("west", along_y and o[3] == box[2]), ("east", along_y and o[2] == box[3]), ("south", along_x and o[1] == box[0]), ("north", along_x and o[0] == box[1])):
            if touches:
                out[side].append(other)
    return out


@pytest.fixture(scope="module")
def tree(spark):
    """A coarse tree with one corner refined to single cells, before and after balancing."""
    d = generators.cells(spark, 32, 32, 1, 1).select("j", "i").withColumn("c", F.when((F.col("j") < 3) & (F.col("i") < 2), 100.0).otherwise((F.col("i") * 0.01 + F.col("j") * 0.02)))
    raw = quadtree.from_cells(d, "c", 1, 5, 2.0)
    return leaves_of(raw), quadtree.balanced(raw)


def test_leaves_cover_the_whole_once_and_differ_by_one_level(tree):
    raw, balanced = tree
    got = leaves_of(balanced)
    for leaves in (raw, got):
        assert sum(4.0 ** -k[0] for k in leaves) == 1.0
    assert any(abs(k[0] - o[0]) > 1 for k in raw for s in around(k, raw).values() for o in s)
    assert all(abs(k[0] - o[0]) <= 1 for k in got for s in around(k, got).values() for o in s)
    assert len(got) > len(raw) and set(k for k in raw if k[0] == 5) <= set(got)


def test_sides_and_fluxes_equal_geometry(tree):
    _, balanced = tree
    got = leaves_of(balanced)
    for r in quadtree.sides(balanced).collect():
        near = around((r.level, r.y, r.x), got)
        for side, found in near.items():
            want = np.mean([got[k] for k in found]) if found else None
            assert (r[side] is None) == (want is None) and (want is None or abs(r[side] - want) < 1e-12)
    rows = quadtree.laplacian(balanced).collect()
    assert len(rows) == len(got) and abs(sum(r.laplacian * 4.0**-r.level for r in rows)) < 1e-9


def test_a_field_without_steep_places_stays_coarse(spark):
    d = generators.cells(spark, 8, 8, 1, 1).select("j", "i", F.lit(3.0).alias("c"))
    flat = quadtree.balanced(quadtree.from_cells(d, "c", 1, 3, 0.5))
    assert leaves_of(flat) == {(1, y, x): 3.0 for y in (0, 1) for x in (0, 1)}
    assert all(r.laplacian == 0 for r in quadtree.laplacian(flat).collect())


def smooth(spark, n=40):
    d = generators.cells(spark, n, n, 1, 1).select("time_idx", "depth_idx", "j", "i", (F.col("j") * 0.1).alias("lat"), (F.col("i") * 0.1).alias("lon"))
    hole = (F.col("i") * 13 + F.col("j") * 7) % 17 == 0
    return d.withColumn("c", F.when(~hole, F.sin(F.col("lon") * 1.5) * F.cos(F.col("lat"))))


def dense(rows, at):
    x, v = np.array([(r.lon, r.lat) for r in rows]), np.array([r.c for r in rows])
    far = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    return far(at, x) @ np.linalg.solve(far(x, x), v)


def test_radial_patches_come_near_the_dense_solution(spark):
    d = smooth(spark)
    axes = interp.Axes(0.0, 0.0, 0.1, 40, 40)
    rng = np.random.default_rng(1)
    at = rng.uniform(0, 3.9, (40, 2))
    targets = spark.createDataFrame([(float(x), float(y)) for x, y in at] + [(0.1, 0.2), (9.0, 0.0)], "lon double, lat double")
    want = dense(d.where("c IS NOT NULL").collect(), at)
    for patch, overlap, most in ((64, 16, 1e-9), (24, 12, 0.04), (8, 4, 0.1)):
        got = {(r.lon, r.lat): r.value for r in interp.radial_basis(d, "c", targets, axes, patch, overlap).collect()}
        assert len(got) == 42 and got[9.0, 0.0] is None
        assert max(abs(got[float(x), float(y)] - w) for (x, y), w in zip(at, want, strict=True)) < most
        assert abs(got[0.1, 0.2] - np.sin(0.15) * np.cos(0.2)) < 1e-9


def test_leading_modes_equal_exact_ones(spark):
    rng = np.random.default_rng(3)
    n_steps, n_cells = 60, 40
    u, _ = np.linalg.qr(rng.standard_normal((n_steps, 20)))
    v, _ = np.linalg.qr(rng.standard_normal((n_cells, 20)))
    x = u * (10.0 * 0.6 ** np.arange(20)) @ v.T
    rows = [("a", s, c, float(x[s, c])) for s in range(n_steps) for c in range(n_cells)] + [("b", s, c, float((s % 3) * (c + 1))) for s in range(6) for c in range(4)]
    rows += [("flat", s, c, 2.0) for s in range(3) for c in range(3)]
    got = {(r.block, r.mode): r for r in series.leading_modes(spark.createDataFrame(rows, "block string, step int, cell int, x double"), 3, more=6, rounds=4).collect()}
    assert sorted(got) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    left, values, right = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    for m in range(3):
        want = right[m] * np.sign(right[m][np.argmax(np.abs(right[m]))])
        assert np.abs(np.array(got["a", m].pattern) - want).max() < 1e-6
        assert abs(got["a", m].variance - values[m] ** 2 / (n_steps - 1)) < 1e-6
        assert abs(got["a", m].variance_share - values[m] ** 2 / (values**2).sum()) < 1e-6
    assert abs(got["b", 0].variance_share - 1) < 1e-9


def test_blocks_that_fit_a_task_cross_the_shuffle_once(spark):
    """Their modes are those of sums over exchanges, also where the random vectors do not span all modes."""
    rng = np.random.default_rng(5)
    rows = [(b, f"s{s}", c, float(x)) for b, n in (("a", 12), ("b", 5), ("c", 1)) for s in range(n) for c, x in enumerate(rng.standard_normal(9) * 2.0 ** -np.arange(9)) if (s, c) != (3, 4)]
    rows += [("a", "s1", 2, 0.5), ("a", "s0", 9, None), ("b", "s9", 0, None), ("b", "s2", 1, float("nan"))]
    rows += [(None, "s1", 0, 5.0), ("a", None, 0, 5.0), ("b", "s1", None, 5.0)]
    df = spark.createDataFrame(rows, "block string, step string, cell int, x double")
    found = lambda whole: series.leading_modes(df, 2, more=2, rounds=2, whole=whole)
    fits = found(1 << 20)
    assert fits._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = {(r.block, r.mode): r for r in fits.collect()}
    assert sorted(want) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)] and len(want["a", 0].pattern) == 10
    for whole in (0, 60):  # all blocks are summed; a is summed, b and c fit
        got = {(r.block, r.mode): r for r in found(whole).collect()}
        assert sorted(got) == sorted(want)
        for k, r in got.items():
            assert (r.variance, r.variance_share) == pytest.approx((want[k].variance, want[k].variance_share)) and r.pattern == pytest.approx(want[k].pattern, abs=1e-9)
