"""Ordered operators on series: moving statistics, gaps, resampling, anomalies, correlation, spectra, integrals.

A series has key, idx (0, 1, ...) and value. A key may hold most of the rows: moving statistics, gaps, resampling and the
exponential average work in blocks of a key. What a block needs from others is a few rows at its edges or one small row
for each block, which are carried over and joined back. The other operators' windows are per key, whose sort spills.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from pelagia.lineage import cut
from pelagia.operators.lines import tridiagonal


def by_idx() -> WindowSpec:
    return Window.partitionBy("key").orderBy("idx")


#: Rows of a key that are worked on together.
BLOCK = 1_000_000


def haloed(df: DataFrame, reach: int, rows_per_block: int, order: str = "idx") -> tuple[DataFrame, Column]:
    """df with `_b`, a block of `order`, where rows within `reach` of another block are in that one too; and which are its own."""
    size = max(rows_per_block, reach, 1)
    block = lambda c: F.floor(c / size)
    spread = df.withColumn("_b", F.explode(F.sequence(block(F.col(order) - reach), block(F.col(order) + reach))))
    return spread, F.col("_b") == block(F.col(order))


def running(df: DataFrame, width: int, value: str = "value", rows_per_block: int = BLOCK) -> DataFrame:
    """Centred moving mean, population std and variance, min, max and median over idx ± width // 2; nulls do not count."""
    if width <= 0:
        raise ValueError("width must be positive")
    spread, own = haloed(df, width // 2, rows_per_block)
    w, c = Window.partitionBy("key", "_b").orderBy("idx").rangeBetween(-(width // 2), width // 2), F.col(value)
    made = spread.withColumns(
        {
            "running_mean": F.avg(c).over(w),
            "running_std": F.stddev_pop(c).over(w),
            "running_var": F.var_pop(c).over(w),
            "running_min": F.min(c).over(w),
            "running_max": F.max(c).over(w),
            "running_median": F.percentile(c, F.lit(0.5)).over(w),
        }
    )
    return made.where(own).drop("_b")


def moving_average(df: DataFrame, before: int, value: str = "value") -> DataFrame:
    """The mean of a row and the `before` rows ahead of it."""
    return df.withColumn("moving_average", F.avg(value).over(by_idx().rowsBetween(-before, 0)))


def exponential_average(df: DataFrame, alpha: float = 0.1, value: str = "value", rows_per_block: int = 100_000) -> DataFrame:
    """One row per key: the exponential moving average after its last value.

    A block is folded alone, from nothing and from zero; what it does to an average from before is then a multiple of it
    plus a number, so a key's blocks are folded as one short row of such steps."""
    known = df.where(F.col(value).isNotNull()).select("key", F.floor(F.col("idx") / rows_per_block).alias("_b"), F.struct("idx", F.col(value).cast("double").alias("v")).alias("r"))
    blocks = known.groupBy("key", "_b").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["v"]).alias("v"))
    fold = lambda start: F.aggregate("v", start, lambda s, x: F.when(s.isNull(), x).otherwise(alpha * x + (1 - alpha) * s))
    steps = blocks.select("key", F.struct("_b", fold(F.lit(None).cast("double")).alias("alone"), fold(F.lit(0.0)).alias("add"), F.pow(F.lit(1 - alpha), F.size("v")).alias("keep")).alias("s"))
    folded = F.aggregate(F.array_sort("s"), F.lit(None).cast("double"), lambda a, s: F.when(a.isNull(), s["alone"]).otherwise(s["keep"] * a + s["add"]))
    averages = steps.groupBy("key").agg(F.collect_list("s").alias("s")).select("key", folded.alias("ema"))
    return df.select("key").distinct().join(averages, "key", "left")


def _neighbours_in_blocks(df: DataFrame, order: str, value: str, by: tuple[str, ...], known: Column, ties: str | None = None) -> DataFrame:
    """df, which has blocks `_b` in the order of `order`, with _v0, _p0, _v1, _p1: see with_neighbours().

    Within a block by windows; a block's first and last known value are one row, carried to the blocks behind and ahead."""
    at = F.when(known, F.col(order))
    also = [ties] if ties else []
    before = Window.partitionBy(*by, "_b").orderBy(order, *also).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by, "_b").orderBy(F.desc(order), *also).rowsBetween(Window.unboundedPreceding, 0)  # a frame that only grows costs one step a row
    local = df.withColumns({"_v0": F.last(value, True).over(before), "_p0": F.last(at, True).over(before), "_v1": F.last(value, True).over(after), "_p1": F.last(at, True).over(after)})
    end = F.when(known, F.struct(F.col(order).alias("p"), F.col(value).alias("v")))
    edges = df.groupBy(*by, "_b").agg(F.max_by(end, at).alias("_last"), F.min_by(end, at).alias("_first"))
    back = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(*by, "_b", F.last("_last", True).over(back).alias("_l"), F.last("_first", True).over(ahead).alias("_f")).where("_l IS NOT NULL OR _f IS NOT NULL")
    keys = [F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*by, "_b")]
    met = local.alias("d").join(carried.alias("c"), reduce(Column.__and__, keys), "left")
    filled = {f"_{k}{n}": F.coalesce(F.col(f"d._{k}{n}"), F.col(f"c._{'lf'[n]}")[k]).alias(f"_{k}{n}") for n in (0, 1) for k in ("v", "p")}
    return met.select(*(F.col(f"d.{c}") for c in df.columns if c != "_b"), *filled.values())


def with_neighbours(df: DataFrame, order: str = "idx", value: str = "value", by: tuple[str, ...] = ("key",), rows_per_block: int = BLOCK) -> DataFrame:
    """df with the nearest known value and its place on either side: _v0, _p0, _v1, _p1. `order` holds whole numbers."""
    blocks = df.withColumn("_b", F.floor(F.col(order) / rows_per_block))
    return _neighbours_in_blocks(blocks, order, value, by, F.col(value).isNotNull())


def fill_gaps(df: DataFrame, max_gap: int | None = None, order: str = "idx", value: str = "value", by: tuple[str, ...] = ("key",), out: str = "filled", rows_per_block: int = BLOCK) -> DataFrame:
    """Linear filling between known neighbours of runs of at most max_gap rows; nothing is extrapolated."""
    w = with_neighbours(df, order, value, by, rows_per_block)
    span = F.col("_p1") - F.col("_p0")
    between = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.try_divide((F.col(order) - F.col("_p0")).cast("double"), span.cast("double"))
    short = F.lit(True) if max_gap is None else span - 1 <= max_gap
    return w.withColumn(out, F.when(F.col(value).isNotNull(), F.col(value)).when(short, between)).drop("_v0", "_p0", "_v1", "_p1")


def resample(df: DataFrame, targets: DataFrame, x: str = "x", value: str = "value", method: str = "linear") -> DataFrame:
    """Values at the targets' (key, x): linear or nearest between a key's points, null outside them.

    An as-of lookup on both sides: points and targets are ordered together, so nothing is paired with everything. They
    are range-partitioned by (key, x) and written; each partition is a block, so a key with most rows is many blocks."""
    rows = df.where(F.col(value).isNotNull()).select("key", F.col(x).cast("double").alias("x"), F.col(value).cast("double").alias("_v"), F.lit(0).alias("_t"))
    both = rows.unionByName(targets.select("key", F.col(x).cast("double").alias("x"), F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_t")))
    blocks = cut(both.repartitionByRange("key", "x").withColumn("_b", F.spark_partition_id()), "resample")
    w = _neighbours_in_blocks(blocks, "x", "_v", ("key",), F.col("_t") == 0, "_t").where("_t = 1")
    share = F.try_divide(F.col("x") - F.col("_p0"), F.col("_p1") - F.col("_p0"))
    linear = F.when(F.col("_p1") == F.col("_p0"), F.col("_v0")).otherwise(F.col("_v0") + (F.col("_v1") - F.col("_v0")) * share)
    nearest = F.when(F.col("x") - F.col("_p0") <= F.col("_p1") - F.col("x"), F.col("_v0")).otherwise(F.col("_v1"))
    return w.select("key", "x", (linear if method == "linear" else nearest).alias("value"))


def anomalies(df: DataFrame, by: list[str], value: str = "value", method: str = "zscore") -> DataFrame:
    """Deviation from the group's mean: absolute, relative (ratio) or in population standard deviations."""
    w, c = Window.partitionBy(*by), F.col(value)
    mean, std = F.avg(c).over(w), F.stddev_pop(c).over(w)
    made = {"absolute": c - mean, "relative": F.try_divide(c, mean), "zscore": F.try_divide(c - mean, std)}[method]
    return df.withColumn("anomaly", made)


def climatology(df: DataFrame, cycle: int, value: str = "value") -> DataFrame:
    """The mean by place in the cycle over whole cycles; one overall mean where a series is shorter than a cycle."""
    n = F.max("idx").over(Window.partitionBy("key")) + 1
    counted = df.withColumn("_n", n)
    whole = counted.where((F.col("idx") < F.floor(F.col("_n") / cycle) * cycle) | (F.col("_n") < cycle))
    phase = F.when(F.col("_n") < cycle, F.lit(-1)).otherwise(F.col("idx") % cycle).cast("int").alias("phase")
    return whole.groupBy("key", phase).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def cross_correlation(a: DataFrame, b: DataFrame, most_lag: int, value: str = "value") -> DataFrame:
    """key, lag and the normalised sum of a(idx + lag)·b(idx) for lags up to most_lag either way; nulls count as 0."""
    left = a.select("key", "idx", F.coalesce(value, F.lit(0.0)).alias("x"))
    right = b.select("key", "idx", F.coalesce(value, F.lit(0.0)).alias("y"))
    shifted = left.select("key", "x", F.explode(F.sequence(F.lit(-most_lag), F.lit(most_lag))).alias("lag"), "idx").withColumn("idx", F.col("idx") - F.col("lag"))
    sums = shifted.join(right, ["key", "idx"]).groupBy("key", "lag").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    power = left.groupBy("key").agg(F.sum(F.col("x") * F.col("x")).alias("xx")).join(right.groupBy("key").agg(F.sum(F.col("y") * F.col("y")).alias("yy")), "key")
    scale = F.sqrt(F.col("xx") * F.col("yy"))
    return sums.join(power, "key").select("key", "lag", F.when(scale > 0, F.try_divide(F.col("xy"), scale)).otherwise(F.col("xy")).alias("correlation"))


def dft_power(df: DataFrame, frequencies: int, value: str = "value") -> DataFrame:
    """key, k and the power of the first frequencies of the discrete Fourier transform; nulls count as 0."""
    n = F.count("*").over(Window.partitionBy("key"))
    rows = df.select("key", "idx", F.coalesce(value, F.lit(0.0)).alias("x"), n.alias("n")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(frequencies - 1))))
    angle = 2 * np.pi * F.pmod(F.col("k") * F.col("idx"), F.col("n")) / F.col("n")
    sums = rows.groupBy("key", "k").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im"), F.max("n").alias("n"))
    return sums.select("key", "k", ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("n")).alias("power"))


@lru_cache(maxsize=8)
def prolate_tapers(n: int, bandwidth: float = 4.0, count: int = 7) -> np.ndarray:
    """The first `count` discrete prolate sequences of length n (rows of unit energy) for a band of bandwidth / n.

    They are eigenvectors of a tridiagonal matrix and, for few of them, smooth: so the matrix is projected on Legendre
    polynomials, of which far fewer than n are needed, and the small problem is solved. Memory is n times their number."""
    place = np.arange(n)
    main = ((n - 1 - 2 * place) / 2.0) ** 2 * np.cos(2 * np.pi * min(0.5, bandwidth / n))
    side = place[1:] * (n - place[1:]) / 2.0
    basis = np.eye(n) if n <= 64 else np.linalg.qr(np.polynomial.legendre.legvander(np.linspace(-1, 1, n), 47 + 2 * count + int(4 * bandwidth)))[0]
    moved = main[:, None] * basis
    moved[1:] += side[:, None] * basis[:-1]
    moved[:-1] += side[:, None] * basis[1:]
    _, vectors = np.linalg.eigh(basis.T @ moved)
    return (basis @ vectors[:, ::-1][:, : min(count, n)]).T


@lru_cache(maxsize=64)
def _taper_weights(n: int, bandwidth: float = 4.0, count: int = 7, block: int = 1 << 14) -> np.ndarray:
    """Weights of Legendre polynomials (rows) in the tapers (columns) of prolate_tapers(), for n well above the number of
    polynomials squared: their products are summed block by block, so memory does not grow with n."""
    size = 48 + 2 * count + int(4 * bandwidth)
    gram, moved = np.zeros((size, size)), np.zeros((size, size))
    for lo in range(0, n, block):
        at = np.arange(lo, min(n, lo + block), dtype=float)[:, None]
        v = np.polynomial.legendre.legvander(2 * np.arange(lo - 1, lo + len(at)) / (n - 1) - 1, size - 1)
        own, step = v[1:], np.diff(v, axis=0)
        gram += own.T @ own
        # the tridiagonal matrix less (n^2 - 1) / 4, which moves no eigenvector: written with differences, it stays small
        moved -= step.T @ (at * (n - at) / 2 * step) + own.T @ (2 * np.sin(np.pi * bandwidth / n) ** 2 * ((n - 1) / 2 - at) ** 2 * own)
    inverse = np.linalg.inv(np.linalg.cholesky(gram))
    _, vectors = np.linalg.eigh(inverse @ moved @ inverse.T)
    return inverse.T @ vectors[:, ::-1][:, :count]


def tapers(n: int, block: int = 1 << 14) -> Iterator[np.ndarray]:
    """The rows of prolate_tapers(n), of long series one at a time."""
    if n <= block:
        yield from prolate_tapers(n)
        return
    for weights in _taper_weights(n).T:
        yield np.concatenate([np.polynomial.legendre.legval(2 * np.arange(lo, min(n, lo + block)) / (n - 1) - 1, weights) for lo in range(0, n, block)])


def spectrum(df: DataFrame, dt: float = 1.0, method: str = "periodogram", value: str = "value") -> DataFrame:
    """key, frequency, power: the one-sided density of each series without its mean.

    Whole (periodogram), by Welch's averaged quarters (welch), or as the mean over seven prolate tapers of a band of four
    frequencies on either side (multitaper), which keeps all of the series and leaks little. Nulls count as 0."""
    if method not in ("periodogram", "welch", "multitaper"):
        raise ValueError(f"unknown method {method}")

    def density(x: np.ndarray, window: np.ndarray) -> np.ndarray:
        p = np.abs(np.fft.rfft((x - x.mean()) * window)) ** 2 * dt / np.sum(window**2)
        p[1 : -1 if len(x) % 2 == 0 else None] *= 2
        return p

    def measured(key: tuple, rows: pa.Table) -> pa.Table:
        x = rows[value].to_numpy()[np.argsort(rows["idx"].to_numpy(), kind="stable")].astype(float)
        x[np.isnan(x)] = 0.0
        del rows
        n = max(1, len(x) // 4) if method == "welch" else len(x)
        if method == "periodogram":
            power = density(x, np.ones(n))
        elif method == "multitaper":
            power = sum(density(x, taper) for taper in tapers(n)) / min(7, n)
        else:
            taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if n > 1 else np.ones(1)
            power = np.mean([density(x[i : i + n], taper) for i in range(0, len(x) - n + 1, max(1, n - n // 2))], axis=0)
        return pa.table({"key": pa.repeat(key[0].cast(pa.string()), len(power)), "frequency": np.fft.rfftfreq(n, dt), "power": power})

    return df.select("key", "idx", F.col(value).cast("double").alias(value)).groupBy("key").applyInArrow(measured, "key string, frequency double, power double")


def trapezoid(df: DataFrame, x: str, y: str) -> DataFrame:
    """key and the integral of y over x by the trapezoidal rule."""
    w = Window.partitionBy("key").orderBy(x)
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return df.select("key", part.alias("_p")).groupBy("key").agg(F.coalesce(F.sum("_p"), F.lit(0.0)).alias("integral"))


def simpson(df: DataFrame, y: str, dx: float) -> DataFrame:
    """key and the integral of equally spaced values by Simpson's rule; an odd last interval by the trapezoidal rule."""
    n = F.count("*").over(Window.partitionBy("key"))
    rows = df.select("key", "idx", F.col(y).alias("y"), n.alias("n"))
    even_end = F.col("n") - 1 - (F.col("n") - 1) % 2
    weight = F.when(F.col("idx") > even_end, 0.0).when((F.col("idx") == 0) | (F.col("idx") == even_end), 1.0).when(F.col("idx") % 2 == 1, 4.0).otherwise(2.0) * (dx / 3)
    tail = F.when((F.col("n") % 2 == 0) & (F.col("idx") >= F.col("n") - 2), dx / 2).otherwise(0.0)
    return rows.groupBy("key").agg(F.sum(F.col("y") * (weight + tail)).alias("integral"))


def time_derivative(df: DataFrame, value: Column, order: str = "idx") -> Column:
    """Change of a value for each unit of `order`, by the rows on either side; null at the ends."""
    w = Window.partitionBy("key").orderBy(order)
    return F.try_divide(F.lead(value).over(w) - F.lag(value).over(w), (F.lead(order).over(w) - F.lag(order).over(w)).cast("double"))


def bracket_time(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Linear value at each target's (key, ts), from the rows before and after it in time; null outside."""
    seconds = lambda d: d.withColumn("x", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return resample(seconds(df), seconds(targets))


def knot_slopes(x: np.ndarray, y: np.ndarray, natural: bool = False) -> np.ndarray:
    """Slopes at the points of the cubic spline through them, points in order.

    With not-a-knot ends from four points on, or natural, without curvature at its ends, from two."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    n = len(x)
    lower, main, upper, right = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    lower[1:-1], main[1:-1], upper[1:-1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    right[1:-1] = 3 * (h[1:] * d[:-1] + h[:-1] * d[1:])
    if natural:
        main[0], upper[0], right[0] = 2, 1, 3 * d[0]
        main[-1], lower[-1], right[-1] = 2, 1, 3 * d[-1]
        return tridiagonal(lower, main, upper, right[None, :])[0]
    a, b = h[0] + h[1], h[-1] + h[-2]
    main[0], upper[0], right[0] = h[1], a, ((h[0] + 2 * a) * h[1] * d[0] + h[0] ** 2 * d[1]) / a
    main[-1], lower[-1], right[-1] = h[-2], b, ((h[-1] + 2 * b) * h[-2] * d[-1] + h[-1] ** 2 * d[-2]) / b
    return tridiagonal(lower, main, upper, right[None, :])[0]


def with_slopes(df: DataFrame, order: str = "idx", value: str = "value", rows_per_block: int = 200_000) -> DataFrame:
    """key, `order`, v and slope of each known point on its key's cubic spline; null slopes where a key has under four."""
    known = df.where(F.col(value).isNotNull()).select("key", order, F.col(value).cast("double").alias("v"), F.floor(F.col(order) / rows_per_block).alias("_r"))
    return _slopes(known, order, rows_per_block, False)


def _slopes(known: DataFrame, order: str, rows_per_block: int, natural: bool, reach: int = 48) -> DataFrame:
    """key, `order`, v and slope of points (key, order, v, _r), which lie in ranges `_r` in their order.

    Points are numbered through their ranges' counts, and blocks of numbers are solved alone: a point's pull on a slope
    falls to 0.27 of it from point to point, so `reach` points on either side of a block decide its slopes to the last
    bit. At an inner block's edge the kind of end does not matter, at a key's end it is the spline's own."""
    counts = known.groupBy("key", "_r").agg(F.count("*").alias("_c"))
    per_key = Window.partitionBy("key")
    counts = counts.select("key", "_r", (F.sum("_c").over(per_key.orderBy("_r")) - F.col("_c")).alias("_ahead"), F.sum("_c").over(per_key).alias("_all"))
    numbered = known.withColumn("_k", F.row_number().over(Window.partitionBy("key", "_r").orderBy(order)) - 1).join(counts, ["key", "_r"])
    spread, own = haloed(numbered.withColumn("_n", F.col("_ahead") + F.col("_k")), reach, rows_per_block, "_n")
    kinds, least = dict(known.dtypes), 2 if natural else 4

    def solved(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_n")
        enough = len(rows) >= least and rows["_all"].iloc[0] >= least
        rows["slope"] = knot_slopes(rows[order].to_numpy(float), rows["v"].to_numpy(float), natural) if enough else np.nan
        return rows.loc[rows["_own"], ["key", order, "v", "slope"]]

    made = spread.withColumn("_own", own).select("key", order, "v", "_n", "_all", "_b", "_own")
    # a halo at a key's end is a block without points of its own
    made = made.groupBy("key", "_b").applyInPandas(solved, f"key {kinds['key']}, `{order}` {kinds[order]}, v double, slope double")
    return made.withColumn("slope", F.when(~F.isnan("slope"), F.col("slope")))


def hermite(v0: Column, s0: Column, v1: Column, s1: Column, share: Column, width: Column) -> Column:
    """The cubic with these values and slopes at both ends of a piece of this width, at a share of it."""
    t, rest = share, 1 - share
    return v0 * (1 + 2 * t) * rest * rest + s0 * width * t * rest * rest + v1 * t * t * (3 - 2 * t) - s1 * width * t * t * rest


def fill_gaps_cubic(df: DataFrame, max_gap: int | None = None, value: str = "value", out: str = "filled", rows_per_block: int = 200_000) -> DataFrame:
    """Filling of runs of at most max_gap rows by the cubic spline through a key's known values, whose ends are not knots.

    A key with under four known values is filled linearly; nothing is extrapolated. df: key, idx and the value."""
    slopes = with_slopes(df, "idx", value, rows_per_block)
    met = df.join(slopes.select("key", "idx", F.struct("v", "slope").alias("_known")), ["key", "idx"], "left")
    w = with_neighbours(met, "idx", "_known", ("key",), rows_per_block)
    span = (F.col("_p1") - F.col("_p0")).cast("double")
    share = F.try_divide((F.col("idx") - F.col("_p0")).cast("double"), span)
    v0, v1 = F.col("_v0.v"), F.col("_v1.v")
    curve = F.coalesce(hermite(v0, F.col("_v0.slope"), v1, F.col("_v1.slope"), share, span), v0 + (v1 - v0) * share)
    short = F.lit(True) if max_gap is None else span - 1 <= max_gap
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(short, curve)
    return w.withColumn(out, filled).select(*df.columns, out)


def cubic_resample(df: DataFrame, targets: DataFrame, x: str = "x", value: str = "value", rows_per_block: int = 200_000) -> DataFrame:
    """Natural cubic spline through each key's points at the key's targets; null outside them.

    Points and targets are range-partitioned by (key, x) and written, slopes are solved in blocks of points, and each
    target reads the spline's piece around it, so a key may hold most of the rows. Of points with one x the lowest counts."""
    points = df.where(F.col(value).isNotNull() & F.col(x).isNotNull()).groupBy("key", F.col(x).cast("double").alias("x")).agg(F.min(F.col(value).cast("double")).alias("v"))
    both = points.select("key", "x", "v", F.lit(0).alias("_t")).unionByName(targets.select("key", F.col(x).cast("double").alias("x"), F.lit(None).cast("double").alias("v"), F.lit(1).alias("_t")))
    blocks = cut(both.repartitionByRange("key", "x").withColumn("_b", F.spark_partition_id()), "spline")
    slopes = _slopes(blocks.where("_t = 0").select("key", "x", "v", F.col("_b").alias("_r")), "x", rows_per_block, True)
    met = blocks.drop("v").join(slopes.select("key", "x", F.lit(0).alias("_t"), F.struct("v", "slope").alias("_known")), ["key", "x", "_t"], "left")
    w = _neighbours_in_blocks(met, "x", "_known", ("key",), F.col("_t") == 0, "_t").where("_t = 1")
    width = F.col("_p1") - F.col("_p0")
    share = F.try_divide(F.col("x") - F.col("_p0"), width)
    curve = hermite(F.col("_v0.v"), F.col("_v0.slope"), F.col("_v1.v"), F.col("_v1.slope"), share, width)
    return w.select("key", "x", F.when(width == 0, F.col("_v0.v")).otherwise(curve).alias("value"))


def natural_spline(x: np.ndarray, y: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Values at t of the cubic spline with no curvature at its ends, by the tridiagonal system of its curvatures."""
    n, h = len(x), np.diff(x)
    m = np.zeros(n)
    if n > 2:  # one pass down and one up; memory grows with n only
        main, side, right = (2 * (h[:-1] + h[1:])).tolist(), h[1:-1].tolist(), (6 * np.diff(np.diff(y) / h)).tolist()
        for k in range(1, n - 2):
            f = side[k - 1] / main[k - 1]
            main[k] -= f * side[k - 1]
            right[k] -= f * right[k - 1]
        right[-1] /= main[-1]
        for k in range(n - 4, -1, -1):
            right[k] = (right[k] - side[k] * right[k + 1]) / main[k]
        m[1:-1] = right
    k = np.clip(np.searchsorted(x, t, side="right") - 1, 0, n - 2)
    l, r = t - x[k], x[k + 1] - t
    return (m[k] * r**3 + m[k + 1] * l**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * r + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * l


def polynomial_surface(df: DataFrame, degree: int = 2, x: str = "x", y: str = "y", z: str = "z") -> tuple[list[tuple[int, int]], np.ndarray]:
    """Exponents and coefficients of the least-squares surface; Spark sums the normal equations, the driver solves them."""
    powers = [(i, j) for i in range(degree + 1) for j in range(degree + 1 - i)]
    term = lambda p: F.pow(F.col(x), F.lit(float(p[0]))) * F.pow(F.col(y), F.lit(float(p[1])))
    sums = [F.sum(term(p) * term(q)).alias(f"a{i}_{j}") for i, p in enumerate(powers) for j, q in enumerate(powers) if j >= i]
    row = df.agg(*sums, *(F.sum(term(p) * F.col(z)).alias(f"b{i}") for i, p in enumerate(powers))).first()
    n = len(powers)
    a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
    return powers, np.linalg.lstsq(a, np.array([row[f"b{i}"] for i in range(n)]), rcond=None)[0]


def surface_value(powers: list[tuple[int, int]], coefficients: np.ndarray, x: Column, y: Column) -> Column:
    """A fitted surface as a Column."""
    out = F.lit(0.0)
    for (i, j), c in zip(powers, coefficients, strict=True):
        out = out + float(c) * F.pow(x, F.lit(float(i))) * F.pow(y, F.lit(float(j)))
    return out


def orthogonal_modes(df: DataFrame, n_modes: int = 5, by: str = "block", most_steps: int = 4096) -> DataFrame:
    """by, mode, variance, variance_share and pattern (one value per cell, the largest positive) of columns (by, step, cell, x).

    Spark sums the products of a block's steps over its cells, so only steps by steps numbers of a block meet in a task,
    whatever the number of cells; the patterns are sums over the steps. Nulls count as the cell's mean. A block of more
    than most_steps steps is refused."""
    anomaly = df.withColumn("a", F.coalesce(F.col("x") - F.avg("x").over(Window.partitionBy(by, "cell")), F.lit(0.0))).select(by, "step", "cell", "a")
    pairs = anomaly.select(by, "cell", F.col("step").alias("r"), F.col("a").alias("x")).join(anomaly.select(by, "cell", F.col("step").alias("c"), F.col("a").alias("y")), [by, "cell"])
    products = pairs.where("r <= c").groupBy(by, "r", "c").agg(F.sum(F.col("x") * F.col("y")).alias("v"))

    def decomposed(rows: pd.DataFrame) -> pd.DataFrame:
        steps = np.unique(rows[["r", "c"]].to_numpy())
        n = len(steps)
        if n > most_steps:
            raise ValueError(f"{n} steps in a block; orthogonal_modes takes at most {most_steps}")
        a = np.zeros((n, n))
        r, c = np.searchsorted(steps, rows["r"]), np.searchsorted(steps, rows["c"])
        a[r, c] = a[c, r] = rows["v"]
        values, vectors = np.linalg.eigh(a)
        order = [m for m in np.argsort(-values)[:n_modes].tolist() if values[m] > 0]
        total = float(values.sum()) or 1.0
        out = pd.DataFrame({"step": np.tile(steps, len(order)), "mode": np.repeat(np.arange(len(order)), n), "weight": np.concatenate([vectors[:, m] / np.sqrt(values[m]) for m in order]) if order else []})
        out["variance"] = np.repeat([float(values[m]) / max(1, n - 1) for m in order], n)
        out["variance_share"] = np.repeat([float(values[m]) / total for m in order], n)
        return out.assign(**{by: rows[by].iloc[0]})

    kind = dict(df.dtypes)
    weights = products.groupBy(by).applyInPandas(decomposed, f"step {kind['step']}, mode int, weight double, variance double, variance_share double, `{by}` {kind[by]}")
    cells = weights.join(anomaly, [by, "step"]).groupBy(by, "mode", "cell").agg(F.sum(F.col("weight") * F.col("a")).alias("p"), F.first("variance").alias("variance"), F.first("variance_share").alias("variance_share"))
    made = cells.groupBy(by, "mode", "variance", "variance_share").agg(F.array_sort(F.collect_list(F.struct("cell", "p"))).alias("c"))
    largest = F.array_max(F.transform("c", lambda c: F.struct(F.abs(c["p"]).alias("size"), c["p"].alias("p"))))["p"]
    return made.select(by, "mode", "variance", "variance_share", F.transform("c", lambda c: c["p"] * F.signum(largest)).alias("pattern"))


def _inverse_root(gram: np.ndarray) -> np.ndarray:
    """A matrix that makes columns with this Gram matrix orthonormal; directions without weight become zero."""
    values, vectors = np.linalg.eigh(gram)
    return vectors * np.where(values > max(values[-1], 0.0) * 1e-14, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)


def _grams(rows: DataFrame, by: str, at: str, of: str, size: int, made: Callable[[np.ndarray], tuple[np.ndarray, ...]], outputs: list[str], bundle: int = 4096) -> DataFrame:
    """by, n and `outputs`: what `made` makes of the sum of the rows' outer products, which are summed in bundles of `at` first."""
    kind = dict(rows.dtypes)[by]

    def part(key: tuple, r: pd.DataFrame) -> pd.DataFrame:
        q = np.array(r[of].tolist())
        return pd.DataFrame({by: [key[0]], "n": [len(r)], "g": [(q.T @ q).reshape(-1)]})

    def whole(key: tuple, r: pd.DataFrame) -> pd.DataFrame:
        results = made(np.sum(r["g"].tolist(), axis=0).reshape(size, size))
        return pd.DataFrame({by: [key[0]], "n": [int(r["n"].sum())], **{c: [x.reshape(-1)] for c, x in zip(outputs, results, strict=True)}})

    parts = rows.select(by, F.pmod(F.xxhash64(at), F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy(by)) / bundle))).alias("_b"), of)
    parts = parts.groupBy(by, "_b").applyInPandas(part, f"`{by}` {kind}, n long, g array<double>")
    return parts.groupBy(by).applyInPandas(whole, f"`{by}` {kind}, n long" + "".join(f", {c} array<double>" for c in outputs))


#: Most values of a block of leading_modes whose sums are formed in one task (8 MB as a matrix).
WHOLE = 1 << 20


def _projected(n_modes: int, rounds: int, by: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The random projection of leading_modes for one block of bounded size, where one row of each step has its random numbers."""

    def made(rows: pd.DataFrame) -> pd.DataFrame:
        steps, step = np.unique(rows["step"], return_inverse=True)
        cells, at = np.unique(rows["cell"], return_inverse=True)
        x = rows["x"].to_numpy(dtype=float)
        known = ~np.isnan(x)
        mean = np.bincount(at[known], x[known], len(cells)) / np.maximum(np.bincount(at[known], minlength=len(cells)), 1)
        anomaly = np.where(known, x - mean[at], 0.0)
        a = np.zeros((len(steps), len(cells)))
        np.add.at(a, (step, at), anomaly)
        given = rows["w"].notna().to_numpy()
        w = np.array(rows["w"][given].tolist())[np.argsort(step[given])]
        for k in range(rounds):
            q = a.T @ w
            q = q @ _inverse_root(q.T @ q)
            w = a @ q
            if k + 1 < rounds:
                w = w @ _inverse_root(w.T @ w)
        values, vectors = (v[..., ::-1] for v in np.linalg.eigh(w.T @ w))
        total = float(anomaly @ anomaly)
        out = []
        for m in range(n_modes):
            if values[m] > total * 1e-12:
                p = q @ vectors[:, m]
                size = np.abs(p).max()
                out.append((rows[by].iloc[0], m, values[m] / max(len(steps) - 1, 1), values[m] / total, p if (p == size).any() else -p))
        return pd.DataFrame(out, columns=[by, "mode", "variance", "variance_share", "pattern"])

    return made


def leading_modes(df: DataFrame, n_modes: int = 5, by: str = "block", more: int = 10, rounds: int = 3, seed: int = 1, whole: int = WHOLE) -> DataFrame:
    """by, mode, variance, variance_share and pattern (one value per cell, the largest positive) of the strongest modes of (by, step, cell, x).

    A random projection finds the range of the strongest modes: each step has n_modes + `more` random numbers, hashed
    from it, and only sums of values times such vectors are formed, first by cell, then by step, `rounds` times in turn,
    made orthonormal in between. So no two steps meet, and a task holds small square matrices only, whatever the number
    of steps and cells. The error of a mode falls with (its variance over that of mode n_modes + more) to the power of
    2·rounds; it is exact where there are no more modes than that. Nulls and NaN count as the cell's mean; rows without a
    block, step or cell take no part.

    A block whose values and vectors are at most about `whole` numbers each is gathered once and its sums are formed in
    one task, so that its vectors are never shuffled; they outweigh the values where a block is spread over many tasks
    with a few of its steps in each. Larger blocks are summed by Spark."""
    size = n_modes + more
    df = df.dropna(subset=[by, "step", "cell"]).select(by, "step", "cell", F.nanvl(F.col("x").cast("double"), F.lit(None).cast("double")).alias("x"))
    noise = lambda k: F.sqrt(-2 * F.log((F.pmod(F.xxhash64("step", F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 1) / float(1 << 40))) * F.cos(F.pmod(F.xxhash64("step", F.lit(seed), F.lit(k), F.lit(0)), F.lit(1 << 40)) * (2 * np.pi / (1 << 40)))
    random = F.array(*(noise(k) for k in range(size)))
    # the largest of what a task would hold: the rows, the matrix, the vectors by step and by cell
    n_steps, n_cells = F.approx_count_distinct("step"), F.approx_count_distinct("cell")
    extent = F.greatest(F.count("*"), n_steps * n_cells, n_steps * size, n_cells * size)
    large = cut(df.groupBy(by).agg(extent.alias("_n")).where(F.col("_n") > whole).select(by), "modes")
    # one exchange by block serves the steps and the blocks
    first = F.row_number().over(Window.partitionBy(by, "step").orderBy("cell")) == 1
    rows = df.join(large, by, "left_anti").repartition(by).withColumn("w", F.when(first, random))
    small = rows.groupBy(by).applyInPandas(_projected(n_modes, rounds, by), f"`{by}` {dict(df.dtypes)[by]}, mode int, variance double, variance_share double, pattern array<double>")
    return small if large.isEmpty() else small.unionByName(_summed_modes(df.join(large, by, "left_semi"), n_modes, by, size, rounds, random))


def _summed_modes(df: DataFrame, n_modes: int, by: str, size: int, rounds: int, random: Column) -> DataFrame:
    """leading_modes by sums over exchanges, for blocks of any size."""
    anomaly = df.withColumn("a", F.coalesce(F.col("x") - F.avg("x").over(Window.partitionBy(by, "cell")), F.lit(0.0))).select(by, "step", "cell", "a")
    anomaly = cut(anomaly, "modes")
    vector = lambda of: F.array(*(F.sum(F.col("a") * F.col(of)[k]) for k in range(size)))

    @F.pandas_udf("array<double>")
    def turned(q: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(list(np.einsum("nk,nkm->nm", np.array(q.tolist()), np.array(r.tolist()).reshape(-1, size, size)))) if len(q) else q

    def orthonormal(rows: DataFrame, at: str, of: str) -> DataFrame:
        roots = _grams(rows, by, at, of, size, lambda g: (_inverse_root(g),), ["_r"]).drop("n")
        return rows.join(roots, by).select(by, at, turned(of, "_r").alias(of))

    steps = anomaly.select(by, "step").distinct().withColumn("w", random)
    for k in range(rounds):
        cells = anomaly.join(steps, [by, "step"]).groupBy(by, "cell").agg(vector("w").alias("q"))
        cells = cut(orthonormal(cut(cells, "modes"), "cell", "q"), "modes")
        steps = cut(anomaly.join(cells, [by, "cell"]).groupBy(by, "step").agg(vector("q").alias("w")), "modes")
        if k + 1 < rounds:
            steps = orthonormal(steps, "step", "w")
    small = _grams(steps, by, "step", "w", size, lambda g: tuple(x[..., ::-1] for x in np.linalg.eigh(g)), ["values", "vectors"])
    total = anomaly.groupBy(by).agg(F.sum(F.col("a") * F.col("a")).alias("_total"))
    found = small.withColumnRenamed("n", "_n").join(total, by)
    modes = found.withColumn("mode", F.explode(F.sequence(F.lit(0), F.lit(n_modes - 1)))).withColumn("_v", F.col("values")[F.col("mode")]).where(F.col("_v") > F.col("_total") * 1e-12)
    # a mode's vector is a column of the square matrix, which lies row by row
    own = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.get("vectors", k * size + F.col("mode")))
    modes = modes.withColumn("_own", own)
    weight = F.aggregate(F.zip_with("q", "_own", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    made = modes.join(cells, by).select(by, "mode", (F.col("_v") / F.greatest(F.col("_n") - 1, F.lit(1))).alias("variance"), F.try_divide("_v", "_total").alias("variance_share"), F.struct("cell", weight.alias("p")).alias("c"))
    gathered = made.groupBy(by, "mode").agg(F.first("variance").alias("variance"), F.first("variance_share").alias("variance_share"), F.array_sort(F.collect_list("c")).alias("c"))
    largest = F.array_max(F.transform("c", lambda c: F.struct(F.abs(c["p"]).alias("size"), c["p"].alias("p"))))["p"]
    return gathered.select(by, "mode", "variance", "variance_share", F.transform("c", lambda c: c["p"] * F.signum(largest)).alias("pattern"))


def project_modes(df: DataFrame, patterns: dict[int, list[float]]) -> Iterator[tuple[int, Column]]:
    """(mode, Column) of each mode's weight at a row with `cell` and `x`: sum these over a step for its coefficient."""
    for mode, pattern in patterns.items():
        yield mode, F.col("x") * F.element_at(F.array(*map(F.lit, pattern)), F.col("cell") + 1)
