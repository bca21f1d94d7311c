"""Neighbourhood operators on gridded fields: derivatives, smoothing, edges, local extrema.

A field has one row per (time_idx, depth_idx, j, i); x runs with i and y with j. Derivatives are window functions along
one axis, so each row of the grid is one window and a plan has one exchange for each axis that it needs.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

def along_x() -> WindowSpec:
    return Window.partitionBy("time_idx", "depth_idx", "j").orderBy("i")


def along_y() -> WindowSpec:
    return Window.partitionBy("time_idx", "depth_idx", "i").orderBy("j")


def along_t() -> WindowSpec:
    return Window.partitionBy("depth_idx", "j", "i").orderBy("time_idx")


def along_z() -> WindowSpec:
    return Window.partitionBy("time_idx", "j", "i").orderBy("depth_idx")


def derivative(c: Column, window, spacing: float, edge: str = "one_sided") -> Column:
    """Central differences inside; at the ends one-sided ones, zero or null, as `edge` says."""
    before, after, place = F.lag(c).over(window), F.lead(c).over(window), F.lag(F.lit(1)).over(window)
    last = F.lead(F.lit(1)).over(window)
    inside = (after - before) / (2 * spacing)
    if edge == "zero":
        return F.when(place.isNull() | last.isNull(), 0.0).otherwise(inside)
    if edge == "null":
        return F.when(place.isNull() | last.isNull(), None).otherwise(inside)
    return F.when(place.isNull(), (after - c) / spacing).when(last.isNull(), (c - before) / spacing).otherwise(inside)


def second_derivative(c: Column, window, spacing: float) -> Column:
    """Central inside, null where a neighbour is missing."""
    return (F.lead(c).over(window) - 2 * c + F.lag(c).over(window)) / (spacing * spacing)


def with_gradients(df: DataFrame, columns: list[str], dx: float, dy: float, edge: str = "one_sided") -> DataFrame:
    """df with <column>_x and <column>_y."""
    for name in columns:
        df = df.withColumn(f"{name}_x", derivative(F.col(name), along_x(), dx, edge))
    for name in columns:
        df = df.withColumn(f"{name}_y", derivative(F.col(name), along_y(), dy, edge))
    return df


def with_velocity_gradients(df: DataFrame, dx: float, dy: float, edge: str = "one_sided", u: str = "water_u", v: str = "water_v") -> DataFrame:
    """df with u_x, v_x, u_y, v_y: one exchange along x and one along y."""
    df = df.withColumns({"u_x": derivative(F.col(u), along_x(), dx, edge), "v_x": derivative(F.col(v), along_x(), dx, edge)})
    return df.withColumns({"u_y": derivative(F.col(u), along_y(), dy, edge), "v_y": derivative(F.col(v), along_y(), dy, edge)})


def divergence() -> Column:
    return F.col("u_x") + F.col("v_y")


def vorticity() -> Column:
    return F.col("v_x") - F.col("u_y")


def shear_strain() -> Column:
    return (F.col("u_y") + F.col("v_x")) / 2


def okubo_weiss() -> Column:
    """Squared normal and shear strain less squared vorticity."""
    normal, shear, spin = F.col("u_x") - F.col("v_y"), F.col("u_y") + F.col("v_x"), vorticity()
    return normal * normal + shear * shear - spin * spin


def laplacian(df: DataFrame, name: str, dx: float, dy: float, out: str = "laplacian") -> DataFrame:
    df = df.withColumn("_xx", second_derivative(F.col(name), along_x(), dx)).withColumn("_yy", second_derivative(F.col(name), along_y(), dy))
    return df.withColumn(out, F.col("_xx") + F.col("_yy")).drop("_xx", "_yy")


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    """Weights of distances 0, 1, ... up to the truncation, of which all offsets sum to 1."""
    reach = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) if sigma else float(k == 0) for k in range(reach + 1)]
    total = raw[0] + 2 * sum(raw[1:])
    return [w / total for w in raw]


def reflected(index: Column, n: int) -> Column:
    """An index beyond the ends mirrored back inside, the end cells counting twice (d c b a | a b c d | d c b a)."""
    wrapped = F.pmod(index, F.lit(2 * n))
    return F.when(wrapped >= n, 2 * n - 1 - wrapped).otherwise(wrapped).cast("int")


def smooth_axis(df: DataFrame, name: str, axis: str, n: int, weights: list[float], out: str | None = None) -> DataFrame:
    """Weighted sum along one axis with mirrored borders: every cell sends its weighted value to the cells it reaches.

    One pre-aggregated shuffle; a null makes null what it reaches."""
    others = [c for c in ("time_idx", "depth_idx", "j", "i") if c != axis]
    reach = len(weights) - 1
    # cell `at` reaches output o when the mirrored index of o + k is `at`; sources are unfolded over the mirror images
    images = [F.col(axis), -F.col(axis) - 1, 2 * n - 1 - F.col(axis)]
    offsets = F.sequence(F.lit(-reach), F.lit(reach))

    def reached(image: int, c: Column) -> Column:
        return F.transform(offsets, lambda k: F.struct((c - k).cast("int").alias("to"), F.abs(k).cast("int").alias("far"), F.lit(image).alias("image")))

    sent = F.flatten(F.array(*(reached(m, c) for m, c in enumerate(images))))
    sent = F.filter(sent, lambda s: s["to"].between(0, n - 1))
    w = F.array(*map(F.lit, weights))
    rows = df.select(*others, F.col(name).alias("_v"), F.explode(sent).alias("_s"))
    got = rows.groupBy(*others, F.col("_s.to").alias(axis)).agg(F.sum(F.col("_v") * F.element_at(w, F.col("_s.far") + 1)).alias("_sum"), F.max(F.col("_v").isNull()).alias("_gap"))
    made = got.select(*others, axis, F.when(~F.col("_gap"), F.col("_sum")).alias(out or name))
    rest = df.drop(*([out] if out else [name]))
    return rest.join(made, ["time_idx", "depth_idx", "j", "i"])


def smooth(df: DataFrame, name: str, n_x: int, n_y: int, sigma: float | None = None, size: int | None = None) -> DataFrame:
    """Separable smoothing, Gaussian with `sigma` or uniform with an odd `size`, along x and then along y."""
    weights = gaussian_weights(sigma) if sigma is not None else [1.0 / size] * (size // 2 + 1)
    return smooth_axis(smooth_axis(df, name, "i", n_x, weights), name, "j", n_y, weights)


def neighbours(df: DataFrame, name: str, reach: int, n_x: int, n_y: int) -> DataFrame:
    """For each cell the values of the square around it, mirrored at the borders: key columns and `values`."""
    offsets = [(dj, di) for dj in range(-reach, reach + 1) for di in range(-reach, reach + 1)]
    wanted = df.select("time_idx", "depth_idx", "j", "i", F.explode(F.array(*(F.struct(F.lit(dj).alias("dj"), F.lit(di).alias("di")) for dj, di in offsets))).alias("o"))
    wanted = wanted.select("time_idx", "depth_idx", F.col("j").alias("_j"), F.col("i").alias("_i"), reflected(F.col("j") + F.col("o.dj"), n_y).alias("j"), reflected(F.col("i") + F.col("o.di"), n_x).alias("i"))
    held = df.select("time_idx", "depth_idx", "j", "i", name)
    got = wanted.join(held, ["time_idx", "depth_idx", "j", "i"])
    return got.groupBy("time_idx", "depth_idx", F.col("_j").alias("j"), F.col("_i").alias("i")).agg(F.collect_list(name).alias("values"))


def median_filter(df: DataFrame, name: str, n_x: int, n_y: int, reach: int = 1, out: str = "median") -> DataFrame:
    """The median of the square around each cell; nulls do not count, an all-null square gives null."""
    sorted_ = F.array_sort("values")
    n = F.size(sorted_)
    low, high = F.get(sorted_, F.floor((n - 1) / 2).cast("int")), F.get(sorted_, F.floor(n / 2).cast("int"))
    return neighbours(df, name, reach, n_x, n_y).withColumn(out, (low + high) / 2).drop("values")


def sobel(df: DataFrame, name: str) -> DataFrame:
    """df with sobel_x and sobel_y, null at the border: differences along one axis, 1-2-1 sums along the other."""
    c = F.col(name)
    df = df.withColumn("_dx", F.lead(c).over(along_x()) - F.lag(c).over(along_x())).withColumn("_sx", F.lead(c).over(along_x()) + 2 * c + F.lag(c).over(along_x()))
    over_y = lambda x: F.lag(x).over(along_y())
    return df.withColumn("sobel_x", F.lead("_dx").over(along_y()) + 2 * F.col("_dx") + over_y("_dx")).withColumn("sobel_y", F.lead("_sx").over(along_y()) - over_y("_sx")).drop("_dx", "_sx")


def local_extrema(df: DataFrame, name: str) -> DataFrame:
    """df with is_peak and is_valley: strictly above or below its four neighbours; border cells are neither."""
    c = F.col(name)
    around = ["_w", "_e", "_s", "_n"]
    df = df.withColumns({"_w": F.lag(c).over(along_x()), "_e": F.lead(c).over(along_x())}).withColumns({"_s": F.lag(c).over(along_y()), "_n": F.lead(c).over(along_y())})
    all_ = lambda test: F.coalesce(reduce(Column.__and__, [test(F.col(a)) for a in around]), F.lit(False))
    return df.withColumns({"is_peak": all_(lambda x: c > x), "is_valley": all_(lambda x: c < x)}).drop(*around)


def smooth_angles(df: DataFrame, name: str, axis: str, n: int, sigma: float, out: str = "smoothed") -> DataFrame:
    """Angles in degrees smoothed through their sine and cosine along one axis."""
    weights = gaussian_weights(sigma)
    df = df.withColumns({"_cos": F.cos(F.radians(name)), "_sin": F.sin(F.radians(name))})
    df = smooth_axis(smooth_axis(df, "_cos", axis, n, weights), "_sin", axis, n, weights)
    return df.withColumn(out, F.pmod(F.degrees(F.atan2("_sin", "_cos")) + 360.0, F.lit(360.0))).drop("_cos", "_sin")


def vertical_velocity(df: DataFrame, dz: float) -> DataFrame:
    """w from continuity: minus the divergence summed over the layers down to this one; needs u_x and v_y."""
    down = along_z().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("w", -F.sum(divergence() * dz).over(down))
