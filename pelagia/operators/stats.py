"""Aggregates of fields, flows, tracers, trajectories and particle clouds."""

from __future__ import annotations

import math

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.functions import geo, ocean
from pelagia.functions.mathx import direction, speed
from pelagia.lineage import cut, discard
from pelagia.schema import rounded

WET = "water_u IS NOT NULL AND water_v IS NOT NULL"


def with_speed(df: DataFrame, u: str = "water_u", v: str = "water_v") -> DataFrame:
    """df with speed, direction in radians and direction_deg."""
    d = direction(F.col(u), F.col(v))
    return df.withColumns({"speed": speed(F.col(u), F.col(v)), "direction": d, "direction_deg": F.degrees(d)})


def quantiles(df: DataFrame, column: str | Column, shares: list[float], bins: int = 4096) -> list[float | None]:
    """Exact quantiles of a column, interpolated between the two nearest values; None for each if there is no value.

    Counts in `bins` bins narrow the range around each wanted rank until it holds a single value. So no task holds the
    values, and at most `bins` counts for each open range reach the driver, whatever the number of rows. Nulls, NaN and
    infinities are left out. This runs jobs when it is called; a table of cut() is read as it is, others are computed once."""
    x = F.col("x")
    column = F.col(column) if isinstance(column, str) else column
    rows = df.select(column.cast("double").alias("x")).where(F.abs(x) < math.inf)
    held_before = hasattr(df, "_saved_at")
    rows = rows if held_before else cut(rows, "values")
    n, lo, hi = rows.agg(F.count("*"), F.min(x), F.max(x)).first()
    if not n:
        return [None] * len(shares)
    places = [share * (n - 1) for share in shares]
    held = {f(at): (lo, hi, 0) for at in places for f in (math.floor, math.ceil)}
    while ranges := sorted({(a, b) for a, b, _ in held.values() if a < b}):
        found = None
        for k, (a, b) in enumerate(ranges):
            half = 0.5 if math.isinf(b - a) else 1.0
            place = F.least(F.floor((x * half - a * half) / (b * half - a * half) * bins), F.lit(bins - 1)) + k * bins
            found = (F if found is None else found).when(x.between(a, b), place)
        counts = rows.groupBy(found.alias("bin")).agg(F.count("*").alias("n"), F.min(x).alias("a"), F.max(x).alias("b")).where("bin IS NOT NULL").orderBy("bin").collect()
        for rank, (a, b, below) in held.items():
            if a < b:
                k = ranges.index((a, b))
                for c in (c for c in counts if c["bin"] // bins == k):
                    if rank < below + c["n"]:
                        held[rank] = (c["a"], c["b"], below)
                        break
                    below += c["n"]
    if not held_before:
        discard(rows)
    value = lambda at: held[math.floor(at)][0] * (1 - at % 1) + held[math.ceil(at)][0] * (at % 1)
    return [value(at) if at % 1 else held[int(at)][0] for at in places]


def _number(value: float | None) -> Column:
    return F.lit(value).cast("double")


def field_statistics(df: DataFrame) -> DataFrame:
    """One row: extent, moments of u, v and speed over wet cells, shares of wet cells, direction, strong-flow count."""
    d = cut(with_speed(df).select("lat", "lon", "water_u", "water_v", "speed", "direction_deg"), "speeds")
    four = lambda c: [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    wet = F.expr(WET)
    (p90,), (middle,) = quantiles(d, "speed", [0.9]), quantiles(d, "direction_deg", [0.5])
    return d.agg(
        *(f(c).alias(f"{c}_{n}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))),
        *four("water_u"),
        *four("water_v"),
        *four("speed"),
        F.count_if(wet).alias("valid"),
        F.count_if(~wet).alias("invalid"),
        F.avg(wet.cast("double")).alias("valid_share"),
        F.first(_number(middle)).alias("direction_median"),
        F.stddev_pop("direction_deg").alias("direction_std"),
        F.first(_number(p90)).alias("speed_p90"),
        F.count_if(F.col("speed") > _number(p90)).alias("strong"),
    )


def flow_statistics(df: DataFrame) -> DataFrame:
    """One row: speeds, direction, kinetic energy density and total, Coriolis parameter and Rossby number."""
    d = cut(with_speed(df).select("lat", "speed", "direction_deg"), "speeds")
    n = F.count("speed")
    row = d.agg(
        F.avg("speed").alias("mean_speed"),
        F.max("speed").alias("max_speed"),
        F.stddev_pop("speed").alias("std_speed"),
        F.first(_number(quantiles(d, "direction_deg", [0.5])[0])).alias("median_direction"),
        (F.avg(F.col("speed") * F.col("speed")) * (0.5 * ocean.RHO0)).alias("kinetic_energy"),
        (F.sum(F.col("speed") * F.col("speed")) * (0.5 * ocean.RHO0)).alias("total_energy"),
        n.alias("cells"),
        F.array_sort(F.collect_set("lat")).alias("_lats"),
    )
    middle = F.element_at("_lats", F.floor(F.size("_lats") / 2).cast("int") + 1)
    return row.select("*", ocean.coriolis(middle).alias("coriolis"), ocean.rossby_number(F.col("mean_speed"), middle).alias("rossby")).drop("_lats")


def moments(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """n, min, max, mean (0 if empty), sample std (0 for fewer than two), median, norm."""
    c = F.col(name)
    aggs = [
        F.count(c).alias("n"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        F.coalesce(F.avg(c), F.lit(0.0)).alias("mean"),
        F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std"),
        F.coalesce(F.var_samp(c), F.lit(0.0)).alias("variance"),
        (F.median(c) if by else F.first(_number(quantiles(df, c, [0.5])[0]))).alias("median"),
        F.sqrt(F.sum(c * c)).alias("norm"),
    ]
    return df.groupBy(*(by or [])).agg(*aggs)


def tail_counts(df: DataFrame, name: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Mean, extremes and population variance of a column, its percentiles and the counts beyond them."""
    c = F.col(name)
    p_low, p_high = (_number(p) for p in quantiles(df, c, [low, high]))
    extremes = [F.avg(c).alias("mean"), F.max(c).alias("max"), F.min(c).alias("min"), F.var_pop(c).alias("variance")]
    beyond = [F.count_if(c > p_high).alias("above"), F.count_if(c < p_low).alias("below")]
    return df.agg(*extremes, F.first(p_low).alias("p_low"), F.first(p_high).alias("p_high"), *beyond)


def levels(df: DataFrame, name: str, n: int = 21) -> DataFrame:
    """level_idx and level: n contour levels from the 5th to the 95th percentile; a range of one value is widened."""
    lo, hi = (_number(p) for p in quantiles(df, name, [0.05, 0.95]))
    lo, hi = F.when(lo == hi, lo - 0.5).otherwise(lo), F.when(lo == hi, hi + 0.5).otherwise(hi)
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("level_idx"), (lo + (hi - lo) * F.col("id") / (n - 1)).alias("level"))


def tracer_statistics(df: DataFrame, c: str, cell_area: float) -> DataFrame:
    """For each time_idx: mass, max, mean, the cell of the maximum (first in j, i) and the area above a thousandth of the maximum."""
    top = F.max(F.struct(F.col(c).alias("c"), (-F.col("j")).alias("j"), (-F.col("i")).alias("i"))).alias("_top")
    s = df.groupBy("time_idx").agg((F.sum(c) * cell_area).alias("mass"), F.max(c).alias("max"), F.avg(c).alias("mean"), top)
    s = s.select("time_idx", "mass", "max", "mean", (-F.col("_top.j")).alias("max_j"), (-F.col("_top.i")).alias("max_i"))
    wide = df.join(s.select("time_idx", "max"), "time_idx").groupBy("time_idx").agg((F.count_if(F.col(c) > 0.001 * F.col("max")) * cell_area).alias("area"))
    return s.join(wide, "time_idx")


def boundary_flux(df: DataFrame, c: str, n_x: int, n_y: int, dx: float, dy: float, u: str = "water_u", v: str = "water_v") -> DataFrame:
    """Net tracer flow out of the grid by (time_idx, depth_idx): east less west, and north less south."""
    uc, vc = F.coalesce(F.col(u), F.lit(0.0)) * F.col(c), F.coalesce(F.col(v), F.lit(0.0)) * F.col(c)
    x = F.sum(F.when(F.col("i") == n_x - 1, uc).when(F.col("i") == 0, -uc).otherwise(0.0)) * dy
    y = F.sum(F.when(F.col("j") == n_y - 1, vc).when(F.col("j") == 0, -vc).otherwise(0.0)) * dx
    return df.groupBy("time_idx", "depth_idx").agg((x + y).alias("flux"))


def time_step_limits(df: DataFrame, dx: float, dy: float, diffusivity: float, u: str = "water_u", v: str = "water_v") -> DataFrame:
    """Time step of the flow model, the tracer model's advective and diffusive limits, Peclet and Courant numbers."""
    s = df.agg(F.max(F.abs(u)).alias("u"), F.max(F.abs(v)).alias("v"), F.max(speed(F.col(u), F.col(v))).alias("speed"))
    gravity_wave = min(dx, dy) / (ocean.GRAVITY * 1000.0) ** 0.5
    flow = 0.5 * F.least(F.coalesce(F.try_divide(F.lit(dx), F.col("u")), F.lit(1e30)), F.coalesce(F.try_divide(F.lit(dy), F.col("v")), F.lit(1e30)), F.lit(gravity_wave))
    advective = F.coalesce(F.try_divide(F.lit(0.5 * min(dx, dy)), F.col("speed")), F.lit(1e30))
    diffusive = 0.25 * min(dx * dx, dy * dy) / diffusivity
    return s.select(flow.alias("flow_step"), F.least(advective, F.lit(diffusive)).alias("tracer_step"), (F.col("speed") * max(dx, dy) / diffusivity).alias("peclet"), (F.col("u") / dx + F.col("v") / dy).alias("courant_per_second"))


def trajectory_statistics(track: DataFrame) -> DataFrame:
    """By particle: points, path and direct distance in km, mean and max speed of the recorded velocities."""
    w = Window.partitionBy("id").orderBy("step")
    leg = geo.haversine(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"), 6371.0)
    s = track.withColumn("_leg", leg).groupBy("id").agg(
        F.count("*").alias("points"),
        F.coalesce(F.sum("_leg"), F.lit(0.0)).alias("path_km"),
        F.min_by(F.struct("lon", "lat"), "step").alias("_a"),
        F.max_by(F.struct("lon", "lat"), "step").alias("_b"),
        F.coalesce(F.avg("speed"), F.lit(0.0)).alias("mean_speed"),
        F.coalesce(F.max("speed"), F.lit(0.0)).alias("max_speed"),
    )
    direct = geo.haversine(F.col("_a.lon"), F.col("_a.lat"), F.col("_b.lon"), F.col("_b.lat"), 6371.0)
    where = geo.drift_direction(F.col("_a.lon"), F.col("_a.lat"), F.col("_b.lon"), F.col("_b.lat"))
    return s.select("id", "points", "path_km", direct.alias("direct_km"), "mean_speed", "max_speed", where.alias("heading"))


def cloud_spread(track: DataFrame) -> DataFrame:
    """By step: particles, centroid, and largest and mean planar distance to it in km."""
    centre = track.groupBy("step").agg(F.avg("lon").alias("c_lon"), F.avg("lat").alias("c_lat"))
    d = geo.planar_km(F.col("c_lon"), F.col("c_lat"), F.col("lon"), F.col("lat"))
    return track.join(centre, "step").groupBy("step").agg(F.count("*").alias("particles"), F.first("c_lon").alias("c_lon"), F.first("c_lat").alias("c_lat"), F.max(d).alias("max_km"), F.avg(d).alias("mean_km"))


def density_grid(points: DataFrame, lo_lon: float, lo_lat: float, resolution: float) -> DataFrame:
    """Particles by cell of a regular grid."""
    cell = lambda c, lo: F.floor((F.col(c) - lo) / resolution).cast("int")
    return points.groupBy(cell("lon", lo_lon).alias("gx"), cell("lat", lo_lat).alias("gy")).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, name: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """bin and n over the range of the data; the last bin holds its upper end."""
    span = df.agg(F.min(name).alias("lo"), F.max(name).alias("hi"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor(F.try_divide(F.col(name) - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    rows = df.where(F.col(name).isNotNull()).join(F.broadcast(span))
    return rows.groupBy(*(by or []), place.alias("bin")).agg(F.count("*").alias("n"))


def oscillation_share(df: DataFrame) -> DataFrame:
    """Share of inner cells that are strict extrema; needs is_peak and is_valley of local_extrema()."""
    return df.agg(F.avg((F.col("is_peak") | F.col("is_valley")).cast("double")).alias("share"))


def _distance(metric: str) -> Column:
    """The distance of (xa, ya) and (xb, yb)."""
    dx, dy = F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")
    metrics: dict[str, Column] = {
        "euclidean": F.sqrt(dx * dx + dy * dy),
        "sqeuclidean": dx * dx + dy * dy,
        "cityblock": F.abs(dx) + F.abs(dy),
        "chebyshev": F.greatest(F.abs(dx), F.abs(dy)),
        "haversine": geo.haversine(F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb")),
    }
    return metrics[metric]


def _met(left: DataFrame, right: DataFrame, metric: str, most: float | None, cell: float, blocks: int = 32, salts: int = 16) -> DataFrame:
    """left (xa, ya and others) with right (xb, yb and others) and their distance: all pairs, or those of at most `most`.

    All rows meet block by block of both sides; near ones meet by cells and their neighbours, a cell's left rows in
    `salts` parts. The pairs may be many more than the rows, so the number of tasks follows from the cores, not from the
    size of the rows: 16 for each core, so that the tasks which got most of the keys end with the others."""
    part = lambda d, n: F.pmod(F.xxhash64(*d.columns), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    if most is None:
        keys = ["_p", "_q"]
        left, right = left.withColumn("_p", part(left, blocks)).withColumn("_q", every(blocks)), right.withColumn("_q", part(right, blocks)).withColumn("_p", every(blocks))
    else:
        size, keys = max(most, cell), ["_gx", "_gy", "_s"]
        place = lambda c: F.floor(F.col(c) / size)
        near = F.sequence(F.lit(-1), F.lit(1))
        left = left.withColumn("_s", part(left, salts)).withColumn("_gx", F.explode(F.transform(near, lambda k: place("xa") + k))).withColumn("_gy", F.explode(F.transform(near, lambda k: place("ya") + k)))
        right = right.withColumns({"_gx": place("xb"), "_gy": place("yb")}).withColumn("_s", every(salts))
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)
    pairs = left.repartition(tasks, *keys).join(right.repartition(tasks, *keys).hint("merge"), keys).drop(*keys).withColumn("distance", _distance(metric))
    return pairs if most is None else pairs.where(F.col("distance") <= most)


def distance_pairs(a: DataFrame, b: DataFrame, metric: str = "euclidean", most: float | None = None, cell: float = 1.0, digits: int | None = None, piece: int = 64) -> DataFrame:
    """id_a, id_b, distance (rounded to `digits` if given) of points (id, x, y).

    Points of one place go together, about `piece` of them to a row at most: places are compared, and their pairs of
    points are only written out in the task where the places have met. With `most`, places meet by cells of that size
    and their neighbours, so near pairs need no product of all rows. Without it every place of `a` is compared with all
    of `b`, in blocks: use it for stated, bounded point sets."""

    def places(d: DataFrame, side: str) -> DataFrame:
        pieces = F.ceil(F.count("*").over(Window.partitionBy("x", "y")) / piece)
        rows = d.select("id", "x", "y", F.pmod(F.xxhash64("id"), pieces).alias("_piece"))
        ids = F.transform(F.collect_list(F.struct("id")), lambda r: r["id"])  # keeps null ids
        return rows.groupBy("x", "y", "_piece").agg(ids.alias("ids")).select(F.col("x").alias(f"x{side}"), F.col("y").alias(f"y{side}"), F.col("ids").alias(f"ids_{side}"))

    distance = F.col("distance") if digits is None else rounded(F.col("distance"), digits).alias("distance")
    # code generated for the join and the explodes as one would hold all pairs of a row of `a` at a time, since a join looks
    # only between its left rows whether to stop; a function of a lambda keeps them apart, so two pieces' pairs are held
    whole = F.transform("ids_b", lambda i: i).alias("ids_b")
    pairs = _met(places(a, "a"), places(b, "b"), metric, most, cell).select("ids_a", whole, distance)
    return pairs.select(F.explode("ids_a").alias("id_a"), "ids_b", "distance").select("id_a", F.explode("ids_b").alias("id_b"), "distance")


def pair_summary(points: DataFrame, most: float, metric: str = "euclidean", cell: float = 1.0) -> DataFrame:
    """pairs (id_a < id_b), mean and population std of the distances of at most `most` between points (id, x, y).

    Places are compared and their pairs of points counted, not written out: both orders of all pairs, less those of rows
    with one id, are twice the pairs. Null ids are in no pair."""
    known = points.where(F.col("id").isNotNull()).groupBy("id", "x", "y").agg(F.count("*").alias("n"))
    side = lambda d, s: d.select(*(F.col(c).alias(c if c == "id" else f"{c}{s}") for c in d.columns))
    places = known.groupBy("x", "y").agg(F.sum("n").alias("n"))
    both = _met(side(places, "a"), side(places, "b"), metric, most, cell).select("distance", (F.col("na") * F.col("nb")).alias("w"))
    own = side(known, "a").join(side(known, "b"), "id").select(_distance(metric).alias("distance"), (-F.col("na") * F.col("nb")).alias("w")).where(F.col("distance") <= most)
    d, w = F.col("distance"), F.col("w")
    sums = both.union(own).agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w"), F.sum(w * d).alias("d"), F.sum(w * d * d).alias("dd"))
    mean = F.try_divide("d", "w")
    std = F.sqrt(F.greatest(F.lit(0.0), F.try_divide("dd", "w") - mean * mean))
    return sums.select(F.expr("w DIV 2").alias("pairs"), F.when(w > 0, mean).alias("mean"), F.when(w > 0, std).alias("std"))


def paired_error(source: DataFrame, target: DataFrame, key: str, distance: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
    """n and mean_error, the mean distance between the points (lon, lat) of both tables that have the same key; 0 without pairs."""
    pairs = source.select(key, F.col("lon").alias("_a"), F.col("lat").alias("_b")).join(target.select(key, "lon", "lat"), key)
    return pairs.agg(F.count("*").alias("n"), F.coalesce(F.avg(distance(F.col("_a"), F.col("_b"), F.col("lon"), F.col("lat"))), F.lit(0.0)).alias("mean_error"))


def grid_shape(df: DataFrame, n_x: int, n_y: int) -> DataFrame:
    """By slab: rows, places and coordinates on each axis, and whether they make a whole n_x by n_y grid."""
    d = df.groupBy("time_idx", "depth_idx").agg(F.count("*").alias("n"), *(F.countDistinct(c).alias(n) for c, n in (("j", "n_y"), ("i", "n_x"), ("lat", "n_lat"), ("lon", "n_lon"))))
    return d.withColumn("whole", (F.col("n") == n_x * n_y) & (F.col("n_lat") == n_y) & (F.col("n_lon") == n_x))


def with_status(df: DataFrame, column: str, status: str | None) -> DataFrame:
    """The rows of a status; all rows where none is asked for."""
    return df if status is None else df.where(F.col(column) == status)
