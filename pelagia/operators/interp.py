"""Lookups between points and grids: bilinear, trilinear, nearest, temporal, layered; regridding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.operators.stencil import along_x, along_y


@dataclass(frozen=True)
class Axes:
    """A regular grid: first longitude and latitude, spacing in degrees, number of cells."""

    lon0: float
    lat0: float
    step: float
    n_x: int
    n_y: int

    @property
    def lon1(self) -> float:
        return self.lon0 + self.step * (self.n_x - 1)

    @property
    def lat1(self) -> float:
        return self.lat0 + self.step * (self.n_y - 1)


def corners(df: DataFrame, columns: list[str], missing: float | None = 0.0) -> DataFrame:
    """One row per lower-left corner with the four corner values of each column: <c>00, <c>10, <c>01, <c>11 (x, then y).

    With this table a point needs one equi-join instead of four."""
    fill = lambda c: c if missing is None else F.coalesce(c, F.lit(missing))
    for c in columns:
        df = df.withColumns({f"{c}00": fill(F.col(c)), f"{c}10": fill(F.lead(c).over(along_x()))})
    df = df.withColumn("_right", F.lead("i").over(along_x()))
    for c in columns:
        df = df.withColumns({f"{c}01": F.lead(f"{c}00").over(along_y()), f"{c}11": F.lead(f"{c}10").over(along_y())})
    inner = df.withColumn("_up", F.lead("j").over(along_y())).where("_right IS NOT NULL AND _up IS NOT NULL")
    return inner.select("time_idx", "depth_idx", "j", "i", *(f"{c}{k}" for c in columns for k in ("00", "10", "01", "11")))


def located(points: DataFrame, axes: Axes, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """points with the lower-left cell (j, i) and the weights (_fx, _fy) inside it; null outside the grid."""
    gx, gy = (F.col(lon) - axes.lon0) / axes.step, (F.col(lat) - axes.lat0) / axes.step
    inside = F.col(lon).between(axes.lon0, axes.lon1) & F.col(lat).between(axes.lat0, axes.lat1)
    i, j = F.least(F.floor(gx), F.lit(axes.n_x - 2)).cast("int"), F.least(F.floor(gy), F.lit(axes.n_y - 2)).cast("int")
    return points.withColumns({"i": F.when(inside, i), "j": F.when(inside, j)}).withColumns({"_fx": gx - F.col("i"), "_fy": gy - F.col("j")})


def blended(name: str) -> Column:
    """The bilinear value from a row of corners and weights."""
    x, y = F.col("_fx"), F.col("_fy")
    return F.col(f"{name}00") * (1 - x) * (1 - y) + F.col(f"{name}10") * x * (1 - y) + F.col(f"{name}01") * (1 - x) * y + F.col(f"{name}11") * x * y


def bilinear(df: DataFrame, points: DataFrame, columns: list[str], axes: Axes, fill: float | None = None) -> DataFrame:
    """points (with time_idx, depth_idx, lon, lat) and the interpolated columns; `fill` outside the grid."""
    held = corners(df, columns)
    got = located(points, axes).join(held, ["time_idx", "depth_idx", "j", "i"], "left")
    return got.select(*points.columns, *(F.coalesce(blended(c), F.lit(fill)).alias(c) if fill is not None else blended(c).alias(c) for c in columns))


def nearest(df: DataFrame, points: DataFrame, columns: list[str], axes: Axes) -> DataFrame:
    """points and the columns of the nearest cell; a point half way goes to the lower index; null outside the grid."""
    at = lambda c, lo, n: F.least(F.ceil((F.col(c) - lo) / axes.step - 0.5), F.lit(n - 1)).cast("int")
    inside = F.col("lon").between(axes.lon0, axes.lon1) & F.col("lat").between(axes.lat0, axes.lat1)
    placed = points.withColumns({"i": F.when(inside, F.greatest(at("lon", axes.lon0, axes.n_x), F.lit(0))), "j": F.when(inside, F.greatest(at("lat", axes.lat0, axes.n_y), F.lit(0)))})
    return placed.join(df.select("time_idx", "depth_idx", "j", "i", *columns), ["time_idx", "depth_idx", "j", "i"], "left").select(*points.columns, "j", "i", *columns)


def mesh(spark, lons: list[float], lats: list[float], time_idx: int = 0, depth_idx: int = 0) -> DataFrame:
    """All pairs of two short axes, as points."""
    made = spark.range(len(lons) * len(lats)).select((F.col("id") % len(lons)).cast("int").alias("gi"), F.expr(f"CAST(id DIV {len(lons)} AS INT)").alias("gj"))
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), F.col(c) + 1)
    return made.select(F.lit(time_idx).alias("time_idx"), F.lit(depth_idx).alias("depth_idx"), "gj", "gi", pick(lons, "gi").alias("lon"), pick(lats, "gj").alias("lat"))


def regrid(df: DataFrame, columns: list[str], axes: Axes, resolution: float, time_idx: int | None = 0, depth_idx: int = 0) -> DataFrame:
    """The columns on a finer or coarser regular grid over the same extent, 0 where nothing is known.

    Of one slab, or of all that df has where time_idx is None."""
    lons = [round(axes.lon0 + k * resolution, 10) for k in range(int((axes.lon1 - axes.lon0) / resolution + 1e-9) + 1)]
    lats = [round(axes.lat0 + k * resolution, 10) for k in range(int((axes.lat1 - axes.lat0) / resolution + 1e-9) + 1)]
    points = mesh(df.sparkSession, lons, lats, time_idx or 0, depth_idx)
    if time_idx is None:
        points = points.drop("time_idx", "depth_idx").crossJoin(df.select(F.col("time_idx").alias("time_idx"), F.col("depth_idx").alias("depth_idx")).distinct())
    return bilinear(df, points, columns, axes, 0.0)


def between_layers(df: DataFrame, points: DataFrame, columns: list[str], axes: Axes, depths: list[float]) -> DataFrame:
    """Trilinear values at points with `depth`: bilinear in the layers above and below, then linear in depth; null outside."""
    ds = F.array(*map(F.lit, depths))
    k = F.greatest(F.size(F.filter(ds, lambda d: d <= F.col("depth"))) - 1, F.lit(0))
    k = F.least(k, F.lit(max(0, len(depths) - 2)))
    inside = F.col("depth").between(depths[0], depths[-1])
    keyed = points.withColumn("_id", F.monotonically_increasing_id()).withColumn("_k", F.when(inside, k))
    d0, d1 = F.element_at(ds, F.col("_k") + 1), F.element_at(ds, F.least(F.col("_k") + 2, F.lit(len(depths))))
    keyed = keyed.withColumn("_fz", F.coalesce(F.try_divide(F.col("depth") - d0, d1 - d0), F.lit(0.0)))
    both = keyed.withColumn("depth_idx", F.explode(F.array(F.col("_k"), F.least(F.col("_k") + 1, F.lit(len(depths) - 1)))))
    both = both.withColumn("_w", F.when(F.col("depth_idx") == F.col("_k"), 1 - F.col("_fz")).otherwise(F.col("_fz")))
    got = bilinear(df, both, columns, axes).groupBy("_id").agg(*(F.first(c).alias(c) for c in points.columns if c != "depth_idx"), *(F.sum(F.col(c) * F.col("_w")).alias(c) for c in columns))
    return got.drop("_id")


def in_time(df: DataFrame, target: float, columns: list[str]) -> DataFrame:
    """The field between two time steps, linear in time_idx; null where a neighbour is missing or outside."""
    lo = int(np.floor(target))
    share = target - lo
    held = df.where(F.col("time_idx").isin(lo, lo + 1) if share else F.col("time_idx") == lo)
    weight = F.when(F.col("time_idx") == lo, 1 - share).otherwise(share)
    need = 2 if share else 1
    return held.groupBy("depth_idx", "j", "i").agg(*(F.when(F.count(c) == need, F.sum(F.col(c) * weight)).alias(c) for c in columns))


def radial_basis(df: DataFrame, name: str, targets: DataFrame, axes: Axes, patch: int = 24, overlap: int = 12) -> DataFrame:
    """targets (lon, lat) of every (time_idx, depth_idx) slab with `value`: linear-kernel radial interpolation in patches.

    The grid is cut into patches of `patch` by `patch` cells, each with `overlap` more on all sides; a patch's known
    cells make one dense system in a task, at most (patch + 2·overlap)^2 of them whatever the slab's size. Where patches
    overlap, their values are blended by weights that fade to nothing at a patch's edge. A patch that holds the whole
    slab gives the dense solution; otherwise it differs from it by what cells beyond the overlap would have added: on a
    smooth field under 2 % of its range with the default patches. Known cells are met exactly. Null where no known cell
    is in reach, and for targets outside the grid."""
    reach = patch / 2 + overlap
    held = lambda at: F.sequence(F.ceil((at - patch - overlap + 0.5) / patch).cast("int"), F.floor((at + overlap + 0.5) / patch).cast("int"))

    def dealt(d: DataFrame, y: Column, x: Column) -> DataFrame:
        """d by the patches (py, px) within whose reach y and x, in cells, lie."""
        d = d.withColumns({"_y": y, "_x": x}).withColumn("py", F.explode(held(F.col("_y")))).withColumn("px", F.explode(held(F.col("_x"))))
        near = lambda p, c, n: (F.abs(F.col(c) - (F.col(p) * patch + (patch - 1) / 2)) < reach) & F.col(p).between(0, (n - 1) // patch)
        return d.where(near("py", "_y", axes.n_y) & near("px", "_x", axes.n_x))

    known = df.where(F.col(name).isNotNull()).select("time_idx", "depth_idx", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col(name).cast("double").alias("_v"), "j", "i")
    known = dealt(known, F.col("j").cast("double"), F.col("i").cast("double")).select("time_idx", "depth_idx", "py", "px", "_lat", "_lon", "_v")
    cells = lambda c, lo: (F.col(c) - lo) / axes.step
    inside = F.col("lon").between(axes.lon0, axes.lon1) & F.col("lat").between(axes.lat0, axes.lat1)
    slabs = df.select(F.col("time_idx").alias("time_idx"), F.col("depth_idx").alias("depth_idx")).distinct()
    wanted = targets.select("lon", "lat").distinct().where(inside).crossJoin(slabs)  # every target is asked for in every slab
    wanted = dealt(wanted, cells("lat", axes.lat0), cells("lon", axes.lon0))

    def solved(key: tuple, at: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(at):
            return pd.DataFrame({"lon": [], "lat": [], "time_idx": [], "depth_idx": [], "w": [], "wv": []}).astype({"time_idx": "int32", "depth_idx": "int32"})
        x = rows[["_lon", "_lat"]].to_numpy()
        far = lambda a, b: np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
        weights = np.linalg.lstsq(far(x, x), rows["_v"].to_numpy(), rcond=None)[0] if len(x) > 1 else None
        points = at[["lon", "lat"]].to_numpy()
        made = far(points, x) @ weights if weights is not None else np.full(len(at), rows["_v"].iloc[0])
        fade = lambda c, p: 1 - np.abs(at[c].to_numpy() - (p * patch + (patch - 1) / 2)) / reach
        w = np.maximum(fade("_y", key[2]) * fade("_x", key[3]), 1e-12)
        return pd.DataFrame({"lon": at["lon"], "lat": at["lat"], "time_idx": key[0], "depth_idx": key[1], "w": w, "wv": w * made})

    by = ["time_idx", "depth_idx", "py", "px"]
    parts = wanted.groupBy(*by).cogroup(known.groupBy(*by)).applyInPandas(solved, "lon double, lat double, time_idx int, depth_idx int, w double, wv double")
    made = parts.groupBy("lon", "lat", "time_idx", "depth_idx").agg((F.sum("wv") / F.sum("w")).alias("value"))
    return targets.crossJoin(slabs).join(made, ["lon", "lat", "time_idx", "depth_idx"], "left").select(*targets.columns, "time_idx", "depth_idx", "value")


def wet_cell_fix(points: DataFrame, cells: DataFrame, axes: Axes, rings: int = 4) -> DataFrame:
    """points (id, lon, lat) with the wet cell (j, i) that they are moved to and the ring where it was found.

    Points are clipped to the extent; a point on land looks at growing square rings and takes the nearest wet cell of
    the first ring that has any; beyond `rings` the result is null. cells: j, i, lat, lon of wet cells."""
    clip = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c)))
    p = points.select("id", "lon", "lat", clip("lon", axes.lon0, axes.lon1).alias("_lon"), clip("lat", axes.lat0, axes.lat1).alias("_lat"))
    at = lambda c, lo, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.ceil((F.col(c) - lo) / axes.step - 0.5).cast("int")))
    p = p.withColumns({"ci": at("_lon", axes.lon0, axes.n_x), "cj": at("_lat", axes.lat0, axes.n_y)})
    near = F.sequence(F.lit(-rings), F.lit(rings))
    # by cell of the grid, wet or not, the wet cells of its first ring that has any: a point then meets one row
    around = cells.select("j", "i", F.col("lat").alias("w_lat"), F.col("lon").alias("w_lon")).withColumn("_di", F.explode(near)).withColumn("_dj", F.explode(near))
    found = F.struct(F.greatest(F.abs("_di"), F.abs("_dj")).alias("ring"), "w_lat", "w_lon", "j", "i")
    first = around.groupBy((F.col("i") - F.col("_di")).alias("ci"), (F.col("j") - F.col("_dj")).alias("cj")).agg(F.collect_list(found).alias("c"))
    first = first.withColumn("_ring", F.array_min(F.transform("c", lambda w: w["ring"]))).select("ci", "cj", "_ring", F.filter("c", lambda w: w["ring"] == F.col("_ring")).alias("c"))
    dist = lambda w: (w["w_lon"] - F.col("_lon")) * (w["w_lon"] - F.col("_lon")) + (w["w_lat"] - F.col("_lat")) * (w["w_lat"] - F.col("_lat"))
    best = F.array_min(F.transform("c", lambda w: F.struct(dist(w).alias("dist"), w["j"].alias("j"), w["i"].alias("i"))))
    met = p.join(first, ["ci", "cj"], "left").withColumn("b", best)
    return met.select("id", "lon", "lat", F.col("b.j").alias("j"), F.col("b.i").alias("i"), F.col("_ring").alias("ring"))


def nearest_index(axis: DataFrame, points: DataFrame, x: str, bins: int = 4096) -> DataFrame:
    """points with nearest_idx, the index of the nearest value of an irregular axis (idx, value) to each point's x.

    The axis is cut into its gaps, and each gap lies in the bins that it reaches, so points meet gaps by an equi-join on
    the bin; only the axis is ever ordered as a whole. The smaller index wins ties; a null x has no nearest index."""
    ends = axis.agg(F.min("value").cast("double").alias("lo"), F.max("value").cast("double").alias("hi")).first()
    if ends["lo"] is None:
        return points.withColumn("nearest_idx", F.lit(None).cast(dict(axis.dtypes)["idx"]))
    width = (ends["hi"] - ends["lo"]) / bins or 1.0
    bin_of = lambda c: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((c - ends["lo"]) / width))).cast("int")
    order = Window.orderBy("value", "idx")
    gaps = axis.select(F.col("value").cast("double").alias("_a"), F.col("idx").alias("_ia"), F.lead(F.col("value").cast("double")).over(order).alias("_b"), F.lead("idx").over(order).alias("_ib"), F.row_number().over(order).alias("_n"))
    first = gaps.where("_n = 1").select(F.lit(float("-inf")).alias("_a"), F.col("_ia").alias("_ia"), F.col("_a").alias("_b"), F.col("_ia").alias("_ib"))
    every = gaps.select("_a", "_ia", F.coalesce("_b", F.lit(float("inf"))).alias("_b"), F.coalesce("_ib", "_ia").alias("_ib")).union(first)
    held = every.where("_a < _b").withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_a")), bin_of(F.col("_b")))))
    p = points.withColumn("_x", F.col(x).cast("double")).withColumn("_bin", bin_of(F.col("_x")))
    met = p.join(held, (p["_bin"] == held["_bin"]) & (F.col("_x") >= F.col("_a")) & (F.col("_x") < F.col("_b")), "left")
    pick = F.when(F.col("_x").isNull(), None).when(F.col("_x") - F.col("_a") <= F.col("_b") - F.col("_x"), F.col("_ia")).otherwise(F.col("_ib"))
    return met.select(*(p[c] for c in points.columns), pick.alias("nearest_idx"))
