"""Cubic lookups, lookups in four directions, and series in blocks of a key."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pelagia.operators import cubic, interp, series
from pelagia.sources import generators

AXES = interp.Axes(10.0, 20.0, 0.5, 9, 7)


def dense_slopes(x, y):
    """Slopes of the not-a-knot spline by a dense system of its pieces' conditions."""
    n, h = len(x), np.diff(x)
    d = np.diff(y) / h
    a, b = np.zeros((n, n)), np.zeros(n)
    for k in range(1, n - 1):
        a[k, k - 1 : k + 2] = h[k], 2 * (h[k - 1] + h[k]), h[k - 1]
        b[k] = 3 * (h[k] * d[k - 1] + h[k - 1] * d[k])
    for row, k in ((0, 0), (n - 1, n - 3)):  # the third derivatives of two neighbouring pieces are one
        for piece, sign in ((k, 1.0), (k + 1, -1.0)):
            a[row, piece] += sign / h[piece] ** 2
            a[row, piece + 1] += sign / h[piece] ** 2
            b[row] += sign * 2 * d[piece] / h[piece] ** 2
    return np.linalg.solve(a, b)


def test_slopes_equal_a_dense_system():
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.integers(1, 5, 30)).astype(float)
    y = rng.standard_normal(30)
    assert np.allclose(series.knot_slopes(x, y), dense_slopes(x, y))
    from pelagia.operators.lines import spline_slopes

    for n in (4, 5, 12):
        assert np.allclose(spline_slopes(y[None, :n], 0.5)[0], dense_slopes(np.arange(n) * 0.5, y[:n]))


def cubic_of(x, y):
    return 1 + 2 * x - 0.5 * y + 0.3 * x * y + 0.1 * x**3 - 0.2 * x * x * y**3 + 0.05 * y**2


@pytest.mark.parametrize("bundle", [64, 2])
def test_bicubic_lookups_reproduce_cubics(spark, bundle):
    d = generators.cells(spark, 9, 7, 2, 1).select("time_idx", "depth_idx", "j", "i").withColumn("c", cubic_of(F.col("i") * 0.5, F.col("j") * 0.5) * (F.col("time_idx") + 1))
    rng = np.random.default_rng(2)
    rows = [(int(k % 2), 0, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform((10, 20), (14, 23), (60, 2)))] + [(0, 0, 14.0, 23.0), (1, 0, 10.0, 20.0), (0, 0, 14.1, 21.0)]
    points = spark.createDataFrame(rows, "time_idx int, depth_idx int, lon double, lat double")
    got = cubic.bicubic(d, points, ["c"], AXES, bundle=bundle).collect()
    assert len(got) == len(rows) and [r.c for r in got if r.lon > 14] == [None]
    for r in got:
        if r.lon <= 14:
            assert abs(r.c - cubic_of(r.lon - 10, r.lat - 20) * (r.time_idx + 1)) < 1e-9


def test_bicubic_lookups_equal_splines_of_splines(spark):
    d = generators.cells(spark, 9, 7, 1, 1).select("time_idx", "depth_idx", "j", "i").withColumn("c", F.when((F.col("i") != 4) | (F.col("j") != 3), F.sin(F.col("i") * 2.0) + F.cos(F.col("j") * F.col("i") * 1.0)))
    grid = np.zeros((7, 9))
    for r in d.collect():
        grid[r.j, r.i] = r.c or 0.0

    def along(values, t):
        k, s = min(int(t), len(values) - 2), dense_slopes(np.arange(len(values), dtype=float), values)
        u = t - k
        return values[k] * (1 + 2 * u) * (1 - u) ** 2 + s[k] * u * (1 - u) ** 2 + values[k + 1] * u * u * (3 - 2 * u) - s[k + 1] * u * u * (1 - u)

    rng = np.random.default_rng(3)
    rows = [(0, 0, float(x), float(y)) for x, y in rng.uniform((10, 20), (14, 23), (25, 2))]
    for r in cubic.bicubic(d, spark.createDataFrame(rows, "time_idx int, depth_idx int, lon double, lat double"), ["c"], AXES).collect():
        want = along(np.array([along(line, (r.lon - 10) / 0.5) for line in grid]), (r.lat - 20) / 0.5)
        assert abs(r.c - want) < 1e-10


def test_fields_between_times(spark):
    times = [0.0, 1.0, 2.5, 3.0, 5.0, 6.0]
    d = generators.cells(spark, 3, 2, 6, 1).select("time_idx", "depth_idx", "j", "i")
    t = F.element_at(F.array(*map(F.lit, times)), F.col("time_idx") + 1)
    d = d.withColumn("c", F.when((F.col("i") != 1) | (F.col("time_idx") < 3), t * t * t - 2 * t + F.col("i")))
    exact = lambda x, i: x**3 - 2 * x + i
    made = {m: {(r.target, r.j, r.i): r.c for r in cubic.at_times(d, ["c"], times, [0.25, 2.0, 4.0, 6.0, 6.5], m).collect()} for m in ("cubic", "linear", "nearest")}
    for m, got in made.items():
        assert len(got) == 5 * 6 and all(v is None for k, v in got.items() if k[0] == 6.5 or (k[2] == 1 and k[0] > 2.5)), m
    for x in (0.25, 2.0, 4.0, 6.0):
        assert abs(made["cubic"][x, 1, 0] - exact(x, 0)) < 1e-9
    assert abs(made["linear"][4.0, 0, 2] - (exact(3.0, 2) + exact(5.0, 2)) / 2) < 1e-9
    # under four known times the spline is a line
    assert made["cubic"][2.0, 0, 1] == made["linear"][2.0, 0, 1]
    # half way the earlier one
    assert made["nearest"][4.0, 1, 2] == exact(3.0, 2) and made["nearest"][2.0, 1, 0] == exact(2.5, 0)


def test_lookups_in_four_directions_reproduce_a_product_of_lines(spark):
    depths, times = [0.0, 5.0, 20.0], [1.0, 2.0, 4.0, 4.5]
    d = generators.cells(spark, 9, 7, 4, 3).select("time_idx", "depth_idx", "j", "i")
    pick = lambda axis, c: F.element_at(F.array(*map(F.lit, axis)), F.col(c) + 1)
    line = lambda x, y, z, t: (1 + x) * (2 - 0.1 * y) * (1 + 0.2 * z) * (3 + t)
    d = d.withColumn("c", line(F.col("i") * 0.5, F.col("j") * 0.5, pick(depths, "depth_idx"), pick(times, "time_idx")))
    rng = np.random.default_rng(5)
    rows = [tuple(map(float, p)) for p in rng.uniform((10, 20, 0, 1), (14, 23, 20, 4.5), (50, 4))] + [(14.0, 23.0, 20.0, 4.5), (10.0, 20.0, 0.0, 1.0), (12.0, 21.0, 21.0, 2.0), (12.0, 21.0, 2.0, 0.5), (9.0, 21.0, 2.0, 2.0)]
    got = cubic.anywhere(d, spark.createDataFrame(rows, "lon double, lat double, depth double, time double"), ["c"], AXES, depths, times).collect()
    assert len(got) == len(rows)
    for r in got:
        inside = 10 <= r.lon <= 14 and r.depth <= 20 and r.time >= 1
        assert (r.c is None) != inside and (not inside or abs(r.c - line(r.lon - 10, r.lat - 20, r.depth, r.time)) < 1e-9)


@pytest.fixture(scope="module")
def long_series(spark):
    """A key with nearly all rows, long runs of nulls, and keys of a few rows."""
    one = spark.range(3000).selectExpr("'hot' AS key", "id AS idx", "CASE WHEN xxhash64(id) % 3 = 0 OR id BETWEEN 700 AND 1450 OR id < 5 THEN NULL ELSE CAST(xxhash64(id, 1) % 1000 AS DOUBLE) / 100 END AS value")
    few = spark.createDataFrame([("two", 0, 1.0), ("two", 1, None), ("two", 2, 3.0), ("none", 0, None), ("three", 0, 1.0), ("three", 2, 0.0), ("three", 5, 4.0), ("three", 3, None)], "key string, idx long, value double")
    return one.union(few)


def rows_of(df):
    return sorted((tuple(None if v is None else round(v, 8) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [7, 100])
def test_blocks_do_not_show(spark, long_series, block):
    d = long_series
    assert rows_of(series.running(d, 7, rows_per_block=block)) == rows_of(series.running(d, 7))
    assert rows_of(series.exponential_average(d, rows_per_block=block)) == rows_of(series.exponential_average(d))
    assert rows_of(series.fill_gaps(d, 900, rows_per_block=block)) == rows_of(series.fill_gaps(d, 900))
    before = Window.partitionBy("key").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    plain = d.withColumn("_v0", F.last("value", True).over(before)).select("key", "idx", "_v0")
    assert rows_of(series.with_neighbours(d, rows_per_block=block).select("key", "idx", "_v0")) == rows_of(plain)


def test_no_task_holds_a_long_key(spark, long_series):
    spread, own = series.haloed(long_series, 3, 100)
    assert spread.groupBy("key", "_b").count().agg(F.max("count")).first()[0] <= 106
    assert spread.where(own).count() == long_series.count()


def test_resampling_equals_numpy_across_ranges(spark, long_series):
    known = {k: [(r.idx, r.value) for r in long_series.where("value IS NOT NULL").orderBy("idx").collect() if r.key == k] for k in ("hot", "two")}
    targets = spark.createDataFrame([(k, float(x)) for k in ("hot", "two", "none", "absent") for x in (*np.linspace(-3, 3002, 400), *range(0, 40))], "key string, x double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = series.resample(long_series.withColumn("x", F.col("idx").cast("double")), targets).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == targets.count()
    for r in got:
        xs, ys = zip(*known.get(r.key, [(0, 0.0)]), strict=True)
        inside = r.key in known and xs[0] <= r.x <= xs[-1]
        assert (r.value is None) != inside and (not inside or abs(r.value - np.interp(r.x, xs, ys)) < 1e-9)


@pytest.mark.parametrize("block", [60, 200_000])
def test_cubic_filling_equals_one_spline_of_all_points(spark, long_series, block):
    got = {(r.key, r.idx): r.filled for r in series.fill_gaps_cubic(long_series, 800, rows_per_block=block).collect()}
    rows = {(r.key, r.idx): r.value for r in long_series.collect()}
    assert set(got) == set(rows)
    x = np.array(sorted(i for (k, i), v in rows.items() if k == "hot" and v is not None), dtype=float)
    y = np.array([rows["hot", int(i)] for i in x])
    s = dense_slopes(x, y)
    for i in range(3000):
        k = np.searchsorted(x, i, side="right") - 1
        if rows["hot", i] is not None:
            assert got["hot", i] == rows["hot", i]
        elif k < 0 or k == len(x) - 1:
            assert got["hot", i] is None
        else:
            h = x[k + 1] - x[k]
            u = (i - x[k]) / h
            want = y[k] * (1 + 2 * u) * (1 - u) ** 2 + s[k] * h * u * (1 - u) ** 2 + y[k + 1] * u * u * (3 - 2 * u) - s[k + 1] * h * u * u * (1 - u)
            assert abs(got["hot", i] - want) < 1e-8 * max(1.0, abs(want)), i
    # under four known values: a line
    assert got["two", 1] == 2.0 and abs(got["three", 3] - 4 / 3) < 1e-12 and got["none", 0] is None


@pytest.mark.parametrize("block", [60, 200_000])
def test_spline_resampling_equals_one_natural_spline(spark, long_series, block):
    rows = [(r.idx, r.value) for r in long_series.where("key = 'hot' AND value IS NOT NULL").orderBy("idx").collect()]
    at = [float(v) for v in (*np.linspace(-2, 3002, 300), 10, 11, rows[0][0], rows[-1][0])]
    targets = spark.createDataFrame([("hot", v) for v in at] + [("two", 1.0), ("none", 0.0), ("absent", 1.0)], "key string, x double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = {(r.key, r.x): r.value for r in series.cubic_resample(long_series.withColumn("x", F.col("idx").cast("double")), targets, rows_per_block=block).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    xs, ys = (np.array(c, dtype=float) for c in zip(*rows, strict=True))
    want = series.natural_spline(xs, ys, np.array(at))
    for v, w in zip(at, want, strict=True):
        inside = xs[0] <= v <= xs[-1]
        assert (got["hot", v] is None) != inside and (not inside or abs(got["hot", v] - w) < 1e-8 * max(1.0, abs(w))), v
    assert abs(got["two", 1.0] - 2.0) < 1e-12 and got["none", 0.0] is None and got["absent", 1.0] is None
