"""Queries on gridded fields: crops, statistics, derivatives, smoothing, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.operators import grid, interp, qc, stats, stencil
from pelagia.plans.catalogue import query, r
from pelagia.schema import rounded
from pelagia.sources import readers, views

N = views.SIDE
H = 0.125
AXES = interp.Axes(118.0, 21.0, H, N, N)
KEYS = ["time_idx", "depth_idx", "j", "i"]

WX = "wx AS (PARTITION BY time_idx, depth_idx, j ORDER BY i)"
WY = "wy AS (PARTITION BY time_idx, depth_idx, i ORDER BY j)"
WINDOWS = f"WINDOW {WX}, {WY}"


def slope(c: str, w: str, h: float = H, edge: str = "one") -> str:
    """The SQL of stencil.derivative()."""
    axis = "i" if w == "wx" else "j"
    inside = f"(lead({c}) OVER {w} - lag({c}) OVER {w}) / {2 * h}e0"
    if edge == "zero":
        return f"CASE WHEN {axis} = 0 OR {axis} = {N - 1} THEN 0e0 ELSE {inside} END"
    return f"CASE WHEN {axis} = 0 THEN (lead({c}) OVER {w} - {c}) / {h}e0 WHEN {axis} = {N - 1} THEN ({c} - lag({c}) OVER {w}) / {h}e0 ELSE {inside} END"


def gradients(edge: str = "one") -> str:
    return (
        f"g AS (SELECT *, {slope('water_u', 'wx', edge=edge)} AS u_x, {slope('water_v', 'wx', edge=edge)} AS v_x, "
        f"{slope('water_u', 'wy', edge=edge)} AS u_y, {slope('water_v', 'wy', edge=edge)} AS v_y FROM v_field {WINDOWS})"
    )


def gradient_field(spark: SparkSession, sf_dir: str, edge: str = "one_sided") -> DataFrame:
    return stencil.with_velocity_gradients(views.field(spark, sf_dir), H, H, edge)


@query("SELECT time_idx, j, i, lat, lon, water_u, water_v FROM v_field WHERE lon BETWEEN 119 AND 121 AND lat BETWEEN 22 AND 24 AND water_u IS NOT NULL AND water_v IS NOT NULL", "v_field")
def bbox_crop(spark, sf_dir):
    return readers.crop(views.field(spark, sf_dir), (119, 121), (22, 24)).where(stats.WET).select("time_idx", "j", "i", "lat", "lon", "water_u", "water_v")


@query("SELECT time_idx, j, i, water_u, water_v FROM v_field WHERE i % 4 = 0 AND j % 4 = 0", "v_field")
def stride_sample(spark, sf_dir):
    return readers.strided(views.field(spark, sf_dir), 4).select("time_idx", "j", "i", "water_u", "water_v")


@query("SELECT j, i, lat, lon, water_u, water_v FROM v_field WHERE time_idx = 1 AND depth_idx = 0", "v_field")
def select_slab(spark, sf_dir):
    return readers.slab(views.field(spark, sf_dir), 1, 0).select("j", "i", "lat", "lon", "water_u", "water_v")


@query(
    f"SELECT min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max, count(DISTINCT lat) AS n_lat, count(DISTINCT lon) AS n_lon, count(DISTINCT time_idx) AS n_time, "
    f"{r('(max(lat) - min(lat)) * 111.32e0')} AS span_lat_km, {r('(max(lon) - min(lon)) * 111.32e0 * cos(radians(avg(lat)))')} AS span_lon_km, "
    f"count(*) FILTER (water_u IS NOT NULL AND water_v IS NOT NULL) AS valid, {r('avg(CASE WHEN water_u IS NOT NULL AND water_v IS NOT NULL THEN 1e0 ELSE 0e0 END)')} AS coverage FROM v_field",
    "v_field",
)
def field_extent(spark, sf_dir):
    d = readers.extent(views.field(spark, sf_dir))
    return d.withColumns({c: rounded(F.col(c)) for c in ("span_lat_km", "span_lon_km", "coverage")})


@query("SELECT time_idx, j, i, CASE WHEN (i + j) % 5 IN (0, 1) THEN water_u END AS water_u FROM v_field", "v_field")
def quality_mask(spark, sf_dir):
    d = views.field(spark, sf_dir).withColumn("flag", (F.col("i") + F.col("j")) % 5)
    return qc.quality_mask(d, "water_u", (0, 1)).select("time_idx", "j", "i", "water_u")


@query(f"SELECT time_idx, j, i, {r('sqrt(water_u*water_u + water_v*water_v)')} AS speed, {r('degrees(atan2(water_v, water_u))')} AS direction_deg FROM v_field", "v_field")
def speed_direction(spark, sf_dir):
    d = stats.with_speed(views.field(spark, sf_dir))
    return d.select("time_idx", "j", "i", rounded(F.col("speed")).alias("speed"), rounded(F.col("direction_deg")).alias("direction_deg"))


@query(
    "s AS (SELECT *, sqrt(water_u*water_u + water_v*water_v) AS speed, degrees(atan2(water_v, water_u)) AS dir FROM v_field), p AS (SELECT quantile_cont(speed, 0.9) AS p90 FROM s) "
    + "SELECT "
    + ", ".join(f"{f}({c}) AS {c}_{f}" for c in ("lat", "lon") for f in ("min", "max"))
    + ", "
    + ", ".join(f"{r(f'{f}({c})')} AS {c}_{n}" for c in ("water_u", "water_v", "speed") for f, n in (("min", "min"), ("max", "max"), ("avg", "mean"), ("stddev_pop", "std")))
    + f", count(*) FILTER (speed IS NOT NULL) AS valid, count(*) FILTER (speed IS NULL) AS invalid, {r('avg(CASE WHEN speed IS NOT NULL THEN 1e0 ELSE 0e0 END)')} AS valid_share, "
    f"{r('median(dir)')} AS direction_median, {r('stddev_pop(dir)')} AS direction_std, {r('max(p90)')} AS speed_p90, count(*) FILTER (speed > p90) AS strong FROM s, p",
    "v_field",
)
def field_statistics(spark, sf_dir):
    d = stats.field_statistics(views.field(spark, sf_dir))
    exact = {"valid", "invalid", "strong", "lat_min", "lat_max", "lon_min", "lon_max"}
    return d.select(*(F.col(c) if c in exact else rounded(F.col(c)).alias(c) for c in d.columns))


@query(
    "s AS (SELECT *, sqrt(water_u*water_u + water_v*water_v) AS speed, degrees(atan2(water_v, water_u)) AS dir FROM v_field), "
    "m AS (SELECT lat FROM (SELECT lat, row_number() OVER (ORDER BY lat) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT lat FROM v_field)) WHERE k = n // 2 + 1) "
    f"SELECT {r('avg(speed)')} AS mean_speed, {r('max(speed)')} AS max_speed, {r('stddev_pop(speed)')} AS std_speed, {r('median(dir)')} AS median_direction, {r('avg(speed*speed)*0.5e0*1025e0', 4)} AS kinetic_energy, "
    f"{r('sum(speed*speed)*0.5e0*1025e0', 3)} AS total_energy, count(speed) AS cells, {r('2*7.2921159e-5*sin(radians(max(m.lat)))', 12)} AS coriolis, "
    f"{r('avg(speed)/(abs(2*7.2921159e-5*sin(radians(max(m.lat))))*100000e0)')} AS rossby FROM s, m",
    "v_field",
)
def flow_statistics(spark, sf_dir):
    d = stats.flow_statistics(views.field(spark, sf_dir))
    digits = {"kinetic_energy": 4, "total_energy": 3, "coriolis": 12}
    return d.select(*(F.col(c) if c == "cells" else rounded(F.col(c), digits.get(c, 6)).alias(c) for c in d.columns))


@query(f"{gradients()} SELECT time_idx, j, i, {r('u_x')} AS u_x, {r('u_y')} AS u_y, {r('v_x')} AS v_x, {r('v_y')} AS v_y FROM g", "v_field")
def gradient(spark, sf_dir):
    return gradient_field(spark, sf_dir).select("time_idx", "j", "i", *(rounded(F.col(c)).alias(c) for c in ("u_x", "u_y", "v_x", "v_y")))


@query(f"{gradients()} SELECT time_idx, j, i, {r('u_x + v_y')} AS divergence FROM g", "v_field")
def divergence(spark, sf_dir):
    return gradient_field(spark, sf_dir).select("time_idx", "j", "i", rounded(stencil.divergence()).alias("divergence"))


@query(f"{gradients()} SELECT time_idx, j, i, {r('v_x - u_y')} AS vorticity FROM g", "v_field")
def vorticity(spark, sf_dir):
    return gradient_field(spark, sf_dir).select("time_idx", "j", "i", rounded(stencil.vorticity()).alias("vorticity"))


@query(f"{gradients('zero')} SELECT time_idx, j, i, CASE WHEN i IN (0, {N - 1}) OR j IN (0, {N - 1}) THEN 0e0 ELSE {r('v_x - u_y')} END AS vorticity FROM g", "v_field")
def vorticity_inner(spark, sf_dir):
    border = F.col("i").isin(0, N - 1) | F.col("j").isin(0, N - 1)
    return gradient_field(spark, sf_dir, "zero").select("time_idx", "j", "i", F.when(border, 0.0).otherwise(rounded(stencil.vorticity())).alias("vorticity"))


@query(f"{gradients()} SELECT time_idx, j, i, {r('u_x')} AS s11, {r('(u_y + v_x)/2')} AS s12, {r('v_y')} AS s22 FROM g", "v_field")
def strain_rate(spark, sf_dir):
    return gradient_field(spark, sf_dir).select("time_idx", "j", "i", rounded(F.col("u_x")).alias("s11"), rounded(stencil.shear_strain()).alias("s12"), rounded(F.col("v_y")).alias("s22"))


@query(f"{gradients()} SELECT time_idx, j, i, {r('(u_x-v_y)*(u_x-v_y) + (u_y+v_x)*(u_y+v_x) - (v_x-u_y)*(v_x-u_y)')} AS okubo_weiss FROM g", "v_field")
def okubo_weiss(spark, sf_dir):
    return gradient_field(spark, sf_dir).select("time_idx", "j", "i", rounded(stencil.okubo_weiss()).alias("okubo_weiss"))


@query(
    f"{gradients()}, w AS (SELECT v_x - u_y AS z FROM g), p AS (SELECT quantile_cont(z, 0.1) AS lo, quantile_cont(z, 0.9) AS hi FROM w) "
    f"SELECT {r('avg(z)')} AS mean, {r('max(z)')} AS max, {r('min(z)')} AS min, {r('var_pop(z)')} AS variance, {r('max(lo)')} AS p_low, {r('max(hi)')} AS p_high, count(*) FILTER (z > hi) AS above, count(*) FILTER (z < lo) AS below FROM w, p",
    "v_field",
)
def vorticity_stats(spark, sf_dir):
    d = stats.tail_counts(gradient_field(spark, sf_dir).select(stencil.vorticity().alias("z")), "z")
    return d.select(*(F.col(c) if c in ("above", "below") else rounded(F.col(c)).alias(c) for c in d.columns))


@query(
    f"{gradients()} SELECT {r('avg(u_x+v_y)')} AS mean, {r('max(u_x+v_y)')} AS max, {r('min(u_x+v_y)')} AS min, count(*) FILTER (u_x+v_y < -1e-5) AS converging, count(*) FILTER (u_x+v_y > 1e-5) AS diverging FROM g",
    "v_field",
)
def divergence_stats(spark, sf_dir):
    d = gradient_field(spark, sf_dir).select(stencil.divergence().alias("d"))
    return d.agg(rounded(F.avg("d")).alias("mean"), rounded(F.max("d")).alias("max"), rounded(F.min("d")).alias("min"), F.count_if(F.col("d") < -1e-5).alias("converging"), F.count_if(F.col("d") > 1e-5).alias("diverging"))


@query(
    f"p AS (SELECT quantile_cont(water_u, 0.05) AS lo, quantile_cont(water_u, 0.95) AS hi FROM v_field) SELECT CAST(k AS INT) AS level_idx, {r('lo + (hi - lo) * k / 20e0')} AS level FROM p, range(21) t(k)",
    "v_field",
)
def contour_levels(spark, sf_dir):
    return stats.levels(views.field(spark, sf_dir), "water_u").select("level_idx", rounded(F.col("level")).alias("level"))


def _second(c: str, w: str, h: float = H) -> str:
    return f"(lead({c}) OVER {w} - 2*{c} + lag({c}) OVER {w}) / {h * h}e0"


@query(f"SELECT time_idx, j, i, {r(_second('water_u', 'wx') + ' + ' + _second('water_u', 'wy'))} AS laplacian FROM v_field {WINDOWS}", "v_field")
def laplacian(spark, sf_dir):
    return stencil.laplacian(views.field(spark, sf_dir), "water_u", H, H).select("time_idx", "j", "i", rounded(F.col("laplacian")).alias("laplacian"))


def mirrored(index: str) -> str:
    """The SQL of stencil.reflected()."""
    m = f"((({index}) % {2 * N} + {2 * N}) % {2 * N})"
    return f"CASE WHEN {m} >= {N} THEN {2 * N - 1} - {m} ELSE {m} END"


def smoothed(source: str, c: str, weights: list[float]) -> str:
    """The SQL of separable smoothing of c in source: x first, then y; null where a needed value is null."""
    w = ", ".join(f"({k}, {weights[abs(k)]!r}e0)" for k in range(1 - len(weights), len(weights)))
    return (
        f"wt(k, w) AS (VALUES {w}), "
        f"sx AS (SELECT a.time_idx, a.j, a.i, CASE WHEN count(*) = count(b.{c}) THEN sum(b.{c} * wt.w) END AS v FROM {source} a CROSS JOIN wt JOIN {source} b ON b.time_idx = a.time_idx AND b.j = a.j AND b.i = {mirrored('a.i + wt.k')} GROUP BY 1, 2, 3), "
        f"sy AS (SELECT a.time_idx, a.j, a.i, CASE WHEN count(*) = count(b.v) THEN sum(b.v * wt.w) END AS v FROM sx a CROSS JOIN wt JOIN sx b ON b.time_idx = a.time_idx AND b.i = a.i AND b.j = {mirrored('a.j + wt.k')} GROUP BY 1, 2, 3)"
    )


@query(f"{smoothed('v_tracer', 'c', [1 / 3, 1 / 3])} SELECT time_idx, j, i, {r('v')} AS c FROM sy", "v_tracer")
def smooth_uniform(spark, sf_dir):
    return stencil.smooth(tracer(spark, sf_dir), "c", N, N, size=3).select("time_idx", "j", "i", rounded(F.col("c")).alias("c"))


@query(f"{smoothed('v_field', 'water_u', stencil.gaussian_weights(1.0))} SELECT time_idx, j, i, {r('v')} AS water_u FROM sy", "v_field")
def smooth_gaussian(spark, sf_dir):
    return stencil.smooth(views.field(spark, sf_dir), "water_u", N, N, sigma=1.0).select("time_idx", "j", "i", rounded(F.col("water_u")).alias("water_u"))


@query(
    f"o(d) AS (VALUES (-1), (0), (1)) SELECT a.time_idx, a.j, a.i, {r('median(b.water_u)')} AS median FROM v_field a CROSS JOIN o ox CROSS JOIN o oy "
    f"JOIN v_field b ON b.time_idx = a.time_idx AND b.i = {mirrored('a.i + ox.d')} AND b.j = {mirrored('a.j + oy.d')} GROUP BY 1, 2, 3",
    "v_field",
)
def median_filter(spark, sf_dir):
    return stencil.median_filter(views.field(spark, sf_dir), "water_u", N, N).select("time_idx", "j", "i", rounded(F.col("median")).alias("median"))


@query(
    f"a AS (SELECT *, lead(water_u) OVER wx - lag(water_u) OVER wx AS dx, lead(water_u) OVER wx + 2*water_u + lag(water_u) OVER wx AS sx FROM v_field WINDOW {WX}) "
    f"SELECT time_idx, j, i, {r('lead(dx) OVER wy + 2*dx + lag(dx) OVER wy')} AS sobel_x, {r('lead(sx) OVER wy - lag(sx) OVER wy')} AS sobel_y FROM a WINDOW {WY}",
    "v_field",
)
def sobel_edges(spark, sf_dir):
    return stencil.sobel(views.field(spark, sf_dir), "water_u").select("time_idx", "j", "i", rounded(F.col("sobel_x")).alias("sobel_x"), rounded(F.col("sobel_y")).alias("sobel_y"))


@query(
    "a AS (SELECT *, "
    + ", ".join(f"{f}(c) OVER {w} AS {n}" for f, w, n in (("lag", "wx", "w"), ("lead", "wx", "e"), ("lag", "wy", "s"), ("lead", "wy", "n")))
    + f" FROM v_tracer {WINDOWS}) SELECT time_idx, j, i, coalesce(c > w AND c > e AND c > s AND c > n, false) AS is_peak, coalesce(c < w AND c < e AND c < s AND c < n, false) AS is_valley FROM a",
    "v_tracer",
)
def local_extrema(spark, sf_dir):
    return stencil.local_extrema(tracer(spark, sf_dir), "c").select("time_idx", "j", "i", "is_peak", "is_valley")


def tracer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view v_tracer: still water on land, a concentration from the cell's place."""
    d = views.field(spark, sf_dir)
    c = ((F.col("i") * 7 + F.col("j") * 13 + F.col("time_idx") * 5) % 101).cast("double") / 100.0
    return d.withColumns({"water_u": F.coalesce("water_u", F.lit(0.0)), "water_v": F.coalesce("water_v", F.lit(0.0)), "c": c})


# lookups

CORNERS = (
    "k AS (SELECT time_idx, j, i, "
    + ", ".join(f"coalesce({c}, 0e0) AS {c}00, coalesce(lead({c}) OVER wx, 0e0) AS {c}10, coalesce(lead({c}) OVER wy, 0e0) AS {c}01" for c in ("water_u", "water_v"))
    + f" FROM v_field {WINDOWS}), q AS (SELECT k.*, "
    + ", ".join(f"lead({c}10) OVER wy AS {c}11" for c in ("water_u", "water_v"))
    + f" FROM k WINDOW wy AS (PARTITION BY time_idx, i ORDER BY j))"
)


def blend(c: str, x: str = "fx", y: str = "fy") -> str:
    return f"{c}00*(1-{x})*(1-{y}) + {c}10*{x}*(1-{y}) + {c}01*(1-{x})*{y} + {c}11*{x}*{y}"


LOCATE = f"least(CAST(floor((lon - 118e0) / {H}e0) AS INT), {N - 2}) AS i, least(CAST(floor((lat - 21e0) / {H}e0) AS INT), {N - 2}) AS j"
INSIDE = "lon BETWEEN 118 AND 121.875 AND lat BETWEEN 21 AND 24.875"


def at_all_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every particle at every time of the field."""
    times = views.field(spark, sf_dir).select("time_idx", "depth_idx").distinct()
    return views.particles(spark, sf_dir).crossJoin(times)


@query(
    f"{CORNERS}, p AS (SELECT *, {LOCATE} FROM v_particle WHERE {INSIDE}), f AS (SELECT p.*, (lon - 118e0)/{H}e0 - i AS fx, (lat - 21e0)/{H}e0 - j AS fy FROM p) "
    f"SELECT f.id, q.time_idx, {r(blend('water_u'))} AS water_u, {r(blend('water_v'))} AS water_v FROM f JOIN q ON q.j = f.j AND q.i = f.i",
    "v_field",
    "v_particle",
)
def bilinear_gather(spark, sf_dir):
    d = interp.bilinear(views.field(spark, sf_dir), at_all_times(spark, sf_dir), ["water_u", "water_v"], AXES).where("water_u IS NOT NULL")
    return d.select("id", "time_idx", rounded(F.col("water_u")).alias("water_u"), rounded(F.col("water_v")).alias("water_v"))


AT = "greatest(0, least(CAST(ceil(({c} - {lo}e0) / {h}e0 - 0.5e0) AS INT), {n}))"
NEAR_I, NEAR_J = AT.format(c="lon", lo=118, h=H, n=N - 1), AT.format(c="lat", lo=21, h=H, n=N - 1)


@query(
    f"p AS (SELECT *, {NEAR_I} AS i, {NEAR_J} AS j FROM v_particle WHERE {INSIDE}) SELECT p.id, f.time_idx, p.j, p.i, f.water_u, f.water_v FROM p JOIN v_field f ON f.j = p.j AND f.i = p.i",
    "v_field",
    "v_particle",
)
def nearest_gather(spark, sf_dir):
    p = at_all_times(spark, sf_dir)
    return interp.nearest(views.field(spark, sf_dir), p, ["water_u", "water_v"], AXES).where("i IS NOT NULL").select("id", "time_idx", "j", "i", "water_u", "water_v")


@query(f"SELECT a.j, a.i, {r('a.water_u*(1-0.25e0) + b.water_u*0.25e0')} AS water_u, {r('a.water_v*(1-0.25e0) + b.water_v*0.25e0')} AS water_v FROM v_field a JOIN v_field b ON a.time_idx = 1 AND b.time_idx = 2 AND a.j = b.j AND a.i = b.i", "v_field")
def temporal_interp(spark, sf_dir):
    return interp.in_time(views.field(spark, sf_dir), 1.25, ["water_u", "water_v"]).select("j", "i", rounded(F.col("water_u")).alias("water_u"), rounded(F.col("water_v")).alias("water_v"))


@query(
    f"{CORNERS}, g AS (SELECT CAST(y.k AS INT) AS gj, CAST(x.k AS INT) AS gi, 118e0 + x.k*0.3125e0 AS lon, 21e0 + y.k*0.3125e0 AS lat FROM range(13) x(k), range(13) y(k)), p AS (SELECT *, {LOCATE} FROM g), "
    f"f AS (SELECT p.*, (lon - 118e0)/{H}e0 - i AS fx, (lat - 21e0)/{H}e0 - j AS fy FROM p) SELECT q.time_idx, gj, gi, {r(blend('water_u'))} AS water_u FROM f JOIN q ON q.j = f.j AND q.i = f.i",
    "v_field",
)
def regrid(spark, sf_dir):
    return interp.regrid(views.field(spark, sf_dir), ["water_u"], AXES, 0.3125, None).select("time_idx", "gj", "gi", rounded(F.col("water_u")).alias("water_u"))


@query(
    f"p AS (SELECT id, {NEAR_I} AS ci, {NEAR_J} AS cj, lon, lat FROM v_particle), w AS (SELECT j, i, min(lat) AS w_lat, min(lon) AS w_lon FROM v_field GROUP BY 1, 2 HAVING count(water_u) = count(*)), "
    "m AS (SELECT p.id, greatest(abs(w.i - ci), abs(w.j - cj)) AS ring, (w_lon - lon)*(w_lon - lon) + (w_lat - lat)*(w_lat - lat) AS d, w.j, w.i FROM p JOIN w ON abs(w.i - ci) <= 4 AND abs(w.j - cj) <= 4) "
    "SELECT id, j, i, ring FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ring, d, j, i) AS k FROM m) WHERE k = 1",
    "v_field",
    "v_particle",
)
def wet_cell_fix(spark, sf_dir):
    cells = views.field(spark, sf_dir).groupBy("j", "i").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"), F.every(F.col("water_u").isNotNull()).alias("wet"))
    wet = cells.where("wet")
    return interp.wet_cell_fix(views.particles(spark, sf_dir), wet, AXES).select("id", "j", "i", "ring")


@query(
    "SELECT id, (SELECT l.k FROM (SELECT row_number() OVER (ORDER BY lat) - 1 AS k, lat AS v FROM (SELECT DISTINCT lat FROM v_field)) l ORDER BY abs(l.v - p.lat), l.k LIMIT 1) AS nearest_idx FROM v_particle p",
    "v_field",
    "v_particle",
)
def nearest_axis_index(spark, sf_dir):
    axis = views.field(spark, sf_dir).select(F.col("lat").alias("value"), F.col("j").cast("long").alias("idx")).distinct()
    return interp.nearest_index(axis, views.particles(spark, sf_dir), "lat").select("id", "nearest_idx")


@query("SELECT CAST(floor((lon - 118e0)/0.5e0) AS INT) AS gx, CAST(floor((lat - 21e0)/0.5e0) AS INT) AS gy, count(*) AS n FROM v_particle GROUP BY 1, 2", "v_particle")
def density_grid(spark, sf_dir):
    return stats.density_grid(views.particles(spark, sf_dir), 118.0, 21.0, 0.5)


@query(f"s AS (SELECT source_id AS id, CAST(i AS DOUBLE) AS x, CAST(j AS DOUBLE) AS y FROM v_source) SELECT a.id AS id_a, b.id AS id_b, {r('sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y))')} AS distance FROM s a, s b", "v_source")
def distance_matrix(spark, sf_dir):
    s = views.sources(spark, sf_dir).select(F.col("source_id").alias("id"), F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"))
    return stats.distance_pairs(s, s, digits=6)


@query(f"p AS (SELECT id, lon AS x, lat AS y FROM v_particle) SELECT a.id AS id_a, b.id AS id_b, {r('abs(a.x-b.x) + abs(a.y-b.y)')} AS distance FROM p a, p b WHERE abs(a.x-b.x) + abs(a.y-b.y) <= 0.0625e0", "v_particle")
def pairs_within(spark, sf_dir):
    p = views.particles(spark, sf_dir).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return stats.distance_pairs(p, p, "cityblock", 0.0625, 0.0625, digits=6)


@query("e AS (SELECT min(water_u) AS lo, max(water_u) AS hi FROM v_field) SELECT CAST(least(floor((water_u - lo)/(hi - lo)*20), 19) AS INT) AS bin, count(*) AS n FROM v_field, e WHERE water_u IS NOT NULL GROUP BY 1", "v_field")
def field_histogram(spark, sf_dir):
    return stats.histogram(views.field(spark, sf_dir), "water_u", 20)


@query(
    "SELECT time_idx, "
    f"count(water_u) AS n, min(water_u) AS min, max(water_u) AS max, {r('avg(water_u)')} AS mean, {r('stddev_samp(water_u)')} AS std, {r('var_samp(water_u)')} AS variance, {r('median(water_u)')} AS median, {r('sqrt(sum(water_u*water_u))')} AS norm FROM v_field GROUP BY 1",
    "v_field",
)
def field_moments(spark, sf_dir):
    d = stats.moments(views.field(spark, sf_dir), "water_u", ["time_idx"])
    return d.select(*(F.col(c) if c in ("time_idx", "n", "min", "max") else rounded(F.col(c)).alias(c) for c in d.columns))


@query("SELECT time_idx, j, i, least(CASE WHEN sqrt((j-16)*(j-16) + (i-16)*(i-16)) <= 5 THEN 2 ELSE 0 END, 3) AS level FROM v_field", "v_field")
def refine_by_radius(spark, sf_dir):
    d = views.field(spark, sf_dir).withColumn("level", F.lit(0))
    return grid.refine_by_radius(d, 16, 16, 5, 2, 3).select("time_idx", "j", "i", "level")


@query(f"SELECT time_idx, j, i, depth_idx*{N * N} + j*{N} + i AS cell FROM v_field", "v_field")
def flat_index(spark, sf_dir):
    d = views.field(spark, sf_dir).withColumn("cell", grid.flat_index(F.col("i"), F.col("j"), F.col("depth_idx"), N, N))
    back = grid.from_flat(F.col("cell"), N, N)
    return d.select("time_idx", back["j"].alias("j"), back["i"].alias("i"), "cell")


@query(
    f"l AS (SELECT f.time_idx, f.j, f.i, CAST(k AS INT) AS k, k/4e0 AS sigma, 100e0 + f.i AS depth, f.water_u AS eta FROM v_field f, range(5) t(k) WHERE f.water_u IS NOT NULL) "
    f"SELECT time_idx, j, i, k, {r('-depth + sigma*(depth + eta)')} AS z, {r('(lead(sigma) OVER (PARTITION BY time_idx, j, i ORDER BY k) - sigma)*(depth + eta)')} AS thickness FROM l",
    "v_field",
)
def sigma_thickness(spark, sf_dir):
    base = views.field(spark, sf_dir).where("water_u IS NOT NULL")
    lv = base.select("time_idx", "j", "i", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"), (100.0 + F.col("i")).alias("depth"), F.col("water_u").alias("eta")).withColumn("sigma", F.col("k") / 4.0)
    d = grid.layer_thickness(lv)
    return d.select("time_idx", "j", "i", "k", rounded(grid.sigma_to_z(F.col("sigma"), F.col("depth"), F.col("eta"))).alias("z"), rounded(F.col("thickness")).alias("thickness"))


# quality control

QC_SQL = (
    f"b AS (SELECT count(water_u) AS n, avg(water_u) AS mean, stddev_pop(water_u) AS std, quantile_cont(water_u, 0.25) AS q1, quantile_cont(water_u, 0.5) AS q2, quantile_cont(water_u, 0.75) AS q3 FROM v_field), "
    f"m AS (SELECT quantile_cont(abs(water_u - q2), 0.5) AS mad FROM v_field, b), "
    f"g AS (SELECT *, {slope('water_u', 'wx')} AS gx, {slope('water_u', 'wy')} AS gy, abs(water_u - lag(water_u) OVER wt) AS dt FROM v_field {WINDOWS}, wt AS (PARTITION BY depth_idx, j, i ORDER BY time_idx)), "
    f"h AS (SELECT *, sqrt(gx*gx + gy*gy) AS gr FROM g), e AS (SELECT least(2*quantile_cont(gr, 0.95), 5e0) AS edge FROM h), "
    "fl AS (SELECT time_idx, depth_idx, j, i, water_u, CAST(CASE WHEN water_u IS NULL THEN 3 WHEN dt > 2e0*std THEN 1 WHEN gr > edge THEN 1 "
    "WHEN n >= 10 AND abs((water_u - mean)/std) > 3 AND (water_u < q1 - 1.5e0*(q3-q1) OR water_u > q3 + 1.5e0*(q3-q1)) AND abs(0.6745e0*(water_u - q2)/mad) > 3 THEN 1 "
    "WHEN water_u < -0.9e0 OR water_u > 0.9e0 THEN 2 ELSE 0 END AS INT) AS flag FROM h, b, m, e)"
)
LIMITS = (-0.9, 0.9)


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.flag(views.field(spark, sf_dir), "water_u", LIMITS, H, H)


@query(f"{QC_SQL} SELECT time_idx, j, i, flag FROM fl", "v_field")
def qc_flags(spark, sf_dir):
    return flagged(spark, sf_dir).select("time_idx", "j", "i", "flag")


@query(f"{QC_SQL} SELECT flag, count(*) AS n, {r('count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM fl)')} AS share FROM fl GROUP BY 1", "v_field")
def qc_report(spark, sf_dir):
    return qc.report(flagged(spark, sf_dir)).withColumn("share", rounded(F.col("share")))


def repair_sql(axis: str, by: str, source: str = "kn", out: str = "water_u") -> str:
    """Linear filling of x in `source` along one axis between known neighbours."""
    w = f"PARTITION BY {by} ORDER BY {axis}"
    return (
        f"SELECT *, last_value(x IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0, last_value(CASE WHEN x IS NOT NULL THEN {axis} END IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p0, "
        f"first_value(x IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1, first_value(CASE WHEN x IS NOT NULL THEN {axis} END IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1 FROM {source}"
    )


FILLED = "CASE WHEN x IS NOT NULL THEN x ELSE v0 + (v1 - v0)*CAST({a} - p0 AS DOUBLE)/nullif(p1 - p0, 0) END"


@query(
    f"{QC_SQL}, kn AS (SELECT *, CASE WHEN flag NOT IN (2, 3) THEN water_u END AS x FROM fl), t AS ({repair_sql('time_idx', 'depth_idx, j, i')}), f AS (SELECT *, {FILLED.format(a='time_idx')} AS y FROM t) "
    f"SELECT time_idx, j, i, {r('y')} AS water_u, CASE WHEN flag IN (2, 3) AND y IS NOT NULL THEN 4 ELSE flag END AS flag FROM f",
    "v_field",
)
def qc_repair_time(spark, sf_dir):
    return qc.repair_in_time(flagged(spark, sf_dir), "water_u").select("time_idx", "j", "i", rounded(F.col("water_u")).alias("water_u"), "flag")


@query(
    f"{QC_SQL}, kn AS (SELECT *, CASE WHEN flag NOT IN (2, 3) THEN water_u END AS x FROM fl), a AS (SELECT time_idx, j, i, {FILLED.format(a='i')} AS fx FROM ({repair_sql('i', 'time_idx, depth_idx, j')})), "
    f"b2 AS (SELECT time_idx, j, i, x, flag, {FILLED.format(a='j')} AS fy FROM ({repair_sql('j', 'time_idx, depth_idx, i')})), f AS (SELECT b2.*, coalesce((fx + fy)/2, fx, fy) AS y FROM b2 JOIN a USING (time_idx, j, i)) "
    f"SELECT time_idx, j, i, CASE WHEN flag IN (2, 3) THEN {r('y')} ELSE {r('x')} END AS water_u, CASE WHEN flag IN (2, 3) AND y IS NOT NULL THEN 4 ELSE flag END AS flag FROM f",
    "v_field",
)
def qc_repair_space(spark, sf_dir):
    return qc.repair_in_space(flagged(spark, sf_dir), "water_u").select("time_idx", "j", "i", rounded(F.col("water_u")).alias("water_u"), "flag")


@query()
def qc_process(spark, sf_dir):
    return qc.process(views.field(spark, sf_dir), "water_u", LIMITS, N, N).select("time_idx", "j", "i", rounded(F.col("water_u")).alias("water_u"), "flag")


@query("SELECT time_idx, j, i, water_u, 0 AS part FROM v_field WHERE time_idx < 2 UNION ALL SELECT time_idx, j, i, water_u, 1 AS part FROM v_field WHERE time_idx >= 2", "v_field")
def concat_time(spark, sf_dir):
    d = views.field(spark, sf_dir)
    part = lambda cond, k: d.where(cond).select("time_idx", "j", "i", "water_u", F.lit(k).alias("part"))
    return readers.concat_time([part("time_idx < 2", 0), part("time_idx >= 2", 1)])


@query("SELECT time_idx, j, i, lat, lon, water_u, water_v FROM v_field", "v_field")
def merge_uv(spark, sf_dir):
    d = views.field(spark, sf_dir)
    return readers.merge_uv(d.drop("water_v"), d.drop("water_u", "lat", "lon")).select("time_idx", "j", "i", "lat", "lon", "water_u", "water_v")
