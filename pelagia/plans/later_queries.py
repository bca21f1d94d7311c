"""Queries of mode splitting, implicit steps along lines, local analyses and adaptive particles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pelagia.functions.ocean import GRAVITY, RHO0
from pelagia.lineage import shared_folder
from pelagia.operators import adaptive, cubic, ensemble, interp, lines, particles, quadtree, series, split
from pelagia.plans.catalogue import query, r
from pelagia.plans.field_queries import AXES, CORNERS, H, N, WX, WY, blend, tracer
from pelagia.plans.model_queries import OBS_BLOCK, block_observations
from pelagia.schema import rounded
from pelagia.sources import sinks, views

DX, DZ, LAYERS = 1000.0, 10.0, 3

# mode splitting

DT, SUB, CORIOLIS, VISCOSITY = 40.0, 2, 1e-4, 1e-3
FLAT = "WINDOW fx AS (PARTITION BY time_idx, j ORDER BY i), fy AS (PARTITION BY time_idx, i ORDER BY j)"


def _between(c: str, w: str, h: float) -> str:
    """Central difference, a wall cell standing for what lies behind it."""
    return f"(coalesce(lead({c}) OVER {w}, {c}) - coalesce(lag({c}) OVER {w}, {c}))/{2 * h}e0"


def _friction(c: str) -> str:
    return f"{VISCOSITY}*(coalesce(lead({c}) OVER wz - {c}, 0e0) - coalesce({c} - lag({c}) OVER wz, 0e0))/{DZ * DZ}e0"


def _flux(c: str, w: str) -> str:
    """What leaves a cell less what enters it; nothing passes the walls."""
    return f"(coalesce((h*{c} + lead(h*{c}) OVER {w})/2, 0e0) - coalesce((lag(h*{c}) OVER {w} + h*{c})/2, 0e0))/{DX}e0"


def _sub_step(k: int) -> str:
    ds = DT / SUB
    return (
        f", e{k} AS (SELECT time_idx, j, i, h, u, v, gx, gy, su, sv, eta - {ds}e0*({_flux('u', 'fx')} + {_flux('v', 'fy')}) AS eta FROM s{k} {FLAT}), "
        f"v{k} AS (SELECT time_idx, j, i, h, gx, gy, su, sv, eta, u + {ds}e0*({CORIOLIS}*v - {GRAVITY}*{_between('eta', 'fx', DX)} + gx) AS u, v + {ds}e0*(-{CORIOLIS}*u - {GRAVITY}*{_between('eta', 'fy', DX)} + gy) AS v FROM e{k} {FLAT}), "
        f"s{k + 1} AS (SELECT time_idx, j, i, h, u, v, gx, gy, su + u AS su, sv + v AS sv, eta FROM v{k})"
    )


LAYERED = (
    f"l AS (SELECT time_idx, CAST(k AS INT) AS depth_idx, j, i, water_u/(k + 1) AS u, water_v/(k + 1) AS v, {RHO0} + k*0.5e0 + c*0.1e0 AS density FROM v_tracer, range({LAYERS}) t(k)), "
    f"p AS (SELECT *, sum((density - {RHO0})*{DZ}*({GRAVITY}/{RHO0})) OVER (PARTITION BY time_idx, j, i ORDER BY depth_idx) - (density - {RHO0})*{DZ}*({GRAVITY}/{RHO0})/2 AS p FROM l), "
    f"g AS (SELECT *, {_friction('u')} - {_between('p', 'wx', DX)} AS gx, {_friction('v')} - {_between('p', 'wy', DX)} AS gy FROM p WINDOW {WX}, {WY}, wz AS (PARTITION BY time_idx, j, i ORDER BY depth_idx)), "
    f"s0 AS (SELECT m.*, 0e0 AS su, 0e0 AS sv, c/10e0 AS eta FROM (SELECT time_idx, j, i, {DZ * LAYERS}e0 AS h, avg(u) AS u, avg(v) AS v, avg(gx) AS gx, avg(gy) AS gy FROM g GROUP BY 1, 2, 3) m JOIN v_tracer USING (time_idx, j, i))"
)


@query(
    LAYERED
    + "".join(_sub_step(k) for k in range(SUB))
    + f", n AS (SELECT time_idx, depth_idx, j, i, u + {DT}e0*({CORIOLIS}*v + gx) AS u, v + {DT}e0*(-{CORIOLIS}*u + gy) AS v FROM g), "
    f"o AS (SELECT *, avg(u) OVER c AS mu, avg(v) OVER c AS mv FROM n WINDOW c AS (PARTITION BY time_idx, j, i)) "
    f"SELECT o.time_idx, o.depth_idx, o.j, o.i, {r(f'o.u - mu + su/{SUB}')} AS u, {r(f'o.v - mv + sv/{SUB}')} AS v, {r('eta')} AS eta FROM o JOIN s{SUB} s ON s.time_idx = o.time_idx AND s.j = o.j AND s.i = o.i",
    "v_tracer",
)
def mode_split(spark, sf_dir):
    """One step of three layers with two sub-steps of their depth mean, at every time."""
    k = F.col("depth_idx")
    t = tracer(spark, sf_dir).withColumn("depth_idx", F.explode(F.array(*map(F.lit, range(LAYERS)))))
    layers = t.select("time_idx", "depth_idx", "j", "i", (F.col("water_u") / (k + 1)).alias("u"), (F.col("water_v") / (k + 1)).alias("v"), F.lit(DZ).alias("dz"), (RHO0 + k * 0.5 + F.col("c") * 0.1).alias("density"))
    surface = tracer(spark, sf_dir).select("time_idx", "j", "i", (F.col("c") / 10).alias("eta"))
    new, eta = split.split_step(layers, surface, DT, SUB, DX, DX, CORIOLIS, VISCOSITY)
    made = new.join(eta, ["time_idx", "j", "i"])
    return made.select("time_idx", "depth_idx", "j", "i", *(rounded(F.col(c)).alias(c) for c in ("u", "v", "eta")))


# implicit steps

STEP, SPREAD = 5000.0, 50.0
HALF = STEP * SPREAD / (2 * DX * DX)


def _solved(name: str, source: str, axis: str, across: str) -> str:
    """CTEs that solve one half step along `axis` from source (time_idx, j, i, c): down with ratios, then up."""
    last, w = N - 1, "wy" if axis == "i" else "wx"
    inner = f"{across} BETWEEN 1 AND {last - 1}"
    d = f"(1 + 2*{HALF} + {HALF}*f.ratio)"
    return (
        f"{name}r AS (SELECT time_idx, j, i, CASE WHEN {axis} IN (0, {last}) THEN c ELSE c + {HALF}*(lead(c) OVER {w} - 2*c + lag(c) OVER {w}) END AS c FROM {source} WINDOW wx AS (PARTITION BY time_idx, j ORDER BY i), wy AS (PARTITION BY time_idx, i ORDER BY j)), "
        f"{name}f AS (SELECT time_idx, j, i, 0e0 AS ratio, c AS x FROM {name}r WHERE {axis} = 0 AND {inner} UNION ALL "
        f"SELECT s.time_idx, s.j, s.i, CASE WHEN s.{axis} = {last} THEN 0e0 ELSE -{HALF}/{d} END, CASE WHEN s.{axis} = {last} THEN s.c ELSE (s.c + {HALF}*f.x)/{d} END FROM {name}f f JOIN {name}r s ON s.time_idx = f.time_idx AND s.{across} = f.{across} AND s.{axis} = f.{axis} + 1), "
        f"{name}b AS (SELECT time_idx, j, i, x FROM {name}f WHERE {axis} = {last} UNION ALL "
        f"SELECT f.time_idx, f.j, f.i, f.x - f.ratio*b.x FROM {name}b b JOIN {name}f f ON f.time_idx = b.time_idx AND f.{across} = b.{across} AND f.{axis} = b.{axis} - 1), "
        f"{name} AS (SELECT time_idx, j, i, x AS c FROM {name}b UNION ALL SELECT time_idx, j, i, c FROM {source} WHERE NOT {inner})"
    )


@query(f"{_solved('a', 'v_tracer', 'i', 'j')}, {_solved('z', 'a', 'j', 'i')} SELECT time_idx, j, i, {r('c')} AS c FROM z", "v_tracer")
def alternating_diffusion(spark, sf_dir):
    """One implicit diffusion step of every slab by alternating directions."""
    made = lines.alternating_diffusion(tracer(spark, sf_dir), STEP, DX, DX, SPREAD, N, N)
    return made.select("time_idx", "j", "i", rounded(F.col("c")).alias("c"))


# local analyses


@query(
    f"{OBS_BLOCK}, m AS (SELECT block, cell, avg(x) AS m, coalesce(var_samp(x), 0e0) AS p, count(*) AS k FROM v_ensemble GROUP BY 1, 2) "
    f"SELECT m.block, m.cell, {r('CASE WHEN y IS NULL THEN m ELSE m + p/(p + r)*(y - m) END')} AS mean, {r('CASE WHEN y IS NULL THEN p ELSE p*r/(p + r) END')} AS variance FROM m LEFT JOIN ob ON ob.block = m.block AND ob.cell = m.cell",
    "v_ensemble",
)
def own_cell_analysis(spark, sf_dir):
    """The local analysis where an observation reaches its own cell alone, which has a closed form."""
    made = ensemble.mean_and_spread(ensemble.local_analysis(views.ensemble(spark, sf_dir), block_observations(spark, sf_dir), 0.4))
    return made.select("block", "cell", rounded(F.col("mean")).alias("mean"), rounded(F.col("variance")).alias("variance"))


@query()
def local_analysis(spark, sf_dir):
    """Every member after the analysis of each cell from the observations within 12 cells of it."""
    made = ensemble.local_analysis(views.ensemble(spark, sf_dir), block_observations(spark, sf_dir), 6.0)
    return made.select("member", "block", "cell", rounded(F.col("x")).alias("x"))


# adaptive particles

END, FIRST, TOLERANCE = 0.03, 0.01, 0.0004


def _seen(source: str, lon: str, lat: str, name: str) -> str:
    """source with the velocity at lon, lat; zero where no cell is."""
    inside = f"{lon} BETWEEN 118 AND 121.875 AND {lat} BETWEEN 21 AND 24.875"
    place = f"CASE WHEN {inside} THEN least(CAST(floor(({lon} - 118e0)/{H}e0) AS INT), {N - 2}) END AS ci, CASE WHEN {inside} THEN least(CAST(floor(({lat} - 21e0)/{H}e0) AS INT), {N - 2}) END AS cj"
    fx, fy = f"(({lon} - 118e0)/{H}e0 - ci)", f"(({lat} - 21e0)/{H}e0 - cj)"
    return f"(SELECT p.* EXCLUDE (ci, cj), coalesce({blend('q.water_u', fx, fy)}, 0e0) AS {name}u, coalesce({blend('q.water_v', fx, fy)}, 0e0) AS {name}v FROM (SELECT *, {place} FROM {source}) p LEFT JOIN q ON q.time_idx = p.time_idx AND q.j = p.cj AND q.i = p.ci)"


_TRIED = _seen(f"(SELECT *, lon + au*(h/2) AS hx, lat + av*(h/2) AS hy FROM {_seen(f'(SELECT *, least(dt, {END} - t) AS h FROM w WHERE t < {END})', 'lon', 'lat', 'a')})", "hx", "hy", "b")
_LEAST, _MOST = FIRST * adaptive.LEAST, FIRST * adaptive.MOST


@query(
    f"{CORNERS}, w AS (SELECT id, t.time_idx, lon, lat, 0e0 AS t, CAST({FIRST} AS DOUBLE) AS dt, 0 AS n_steps, 0 AS n_tried, 0e0 AS error FROM v_particle, (SELECT DISTINCT time_idx FROM v_field) t UNION ALL "
    f"SELECT id, time_idx, CASE WHEN ok THEN x ELSE lon END, CASE WHEN ok THEN y ELSE lat END, CASE WHEN NOT ok THEN t WHEN h = {END} - t THEN {END} ELSE t + h END, "
    f"CASE WHEN NOT ok THEN greatest(h*0.5e0, {_LEAST}) WHEN e < {TOLERANCE}*0.1e0 THEN least(dt*1.5e0, {_MOST}) ELSE dt END, n_steps + CAST(ok AS INT), n_tried + 1, CASE WHEN ok THEN greatest(error, e) ELSE error END "
    f"FROM (SELECT *, e <= {TOLERANCE} OR h <= {_LEAST} AS ok FROM (SELECT *, sqrt((x - lon - au*h)*(x - lon - au*h) + (y - lat - av*h)*(y - lat - av*h)) AS e FROM (SELECT *, hx + bu*(h/2) AS x, hy + bv*(h/2) AS y FROM {_TRIED})))) "
    f"SELECT id, time_idx, {r('lon')} AS lon, {r('lat')} AS lat, n_steps, n_tried, {r('error')} AS error FROM w WHERE t >= {END}",
    "v_field",
    "v_particle",
)
def adaptive_arrivals(spark, sf_dir):
    """Every particle in the field of every time, with its own steps to the end time."""
    f = views.field(spark, sf_dir)
    p = views.particles(spark, sf_dir).join(F.broadcast(f.select("time_idx").distinct()))
    made = adaptive.to_end(p, interp.corners(f, ["water_u", "water_v"]), AXES, END, FIRST, TOLERANCE)
    return made.select("id", "time_idx", rounded(F.col("lon")).alias("lon"), rounded(F.col("lat")).alias("lat"), "n_steps", "n_tried", rounded(F.col("error")).alias("error"))


# cubic lookups


def _splined(name: str, source: str, c: str, axis: str, out: str) -> str:
    """CTE `name`: source with `out`, the slope along `axis` of the spline through column c of every line."""
    last, across = N - 1, "j" if axis == "i" else "i"
    w = f"(PARTITION BY time_idx, {across} ORDER BY {axis})"
    d = lambda k: f"(lead({c}, {k + 1}) OVER {w} - lead({c}, {k}) OVER {w})" if k >= 0 else f"(lag({c}, {-k - 1}) OVER {w} - lag({c}, {-k}) OVER {w})"
    right = f"CASE {axis} WHEN 0 THEN (5*(lead({c}) OVER {w} - {c}) + {d(1)})/2 WHEN {last} THEN (5*({c} - lag({c}) OVER {w}) + {d(-2)})/2 ELSE 3*(lead({c}) OVER {w} - lag({c}) OVER {w}) END"
    lower, main, upper = f"CASE WHEN s.{axis} = {last} THEN 2 ELSE 1 END", f"CASE WHEN s.{axis} = {last} THEN 1 ELSE 4 END", f"CASE WHEN s.{axis} = {last} THEN 0 ELSE 1 END"
    den = f"({main} - {lower}*f.ratio)"
    return (
        f"{name}r AS (SELECT time_idx, j, i, {right} AS x FROM {source}), "
        f"{name}f AS (SELECT time_idx, j, i, 2e0 AS ratio, x FROM {name}r WHERE {axis} = 0 UNION ALL SELECT s.time_idx, s.j, s.i, {upper}/{den}, (s.x - {lower}*f.x)/{den} FROM {name}f f JOIN {name}r s ON s.time_idx = f.time_idx AND s.{across} = f.{across} AND s.{axis} = f.{axis} + 1), "
        f"{name}b AS (SELECT time_idx, j, i, x FROM {name}f WHERE {axis} = {last} UNION ALL SELECT f.time_idx, f.j, f.i, f.x - f.ratio*b.x FROM {name}b b JOIN {name}f f ON f.time_idx = b.time_idx AND f.{across} = b.{across} AND f.{axis} = b.{axis} - 1), "
        f"{name} AS (SELECT s.*, b.x AS {out} FROM {source} s JOIN {name}b b USING (time_idx, j, i))"
    )


def _curve(v0: str, s0: str, v1: str, s1: str, t: str) -> str:
    return f"({v0}*(1 + 2*{t})*(1 - {t})*(1 - {t}) + {s0}*{t}*(1 - {t})*(1 - {t}) + {v1}*{t}*{t}*(3 - 2*{t}) - {s1}*{t}*{t}*(1 - {t}))"


def _side(c: str, s: str, lower: str, upper: str) -> str:
    return _curve(f"{lower}.{c}", f"{lower}.{s}", f"{upper}.{c}", f"{upper}.{s}", "fy")


@query(
    f"{_splined('sx', 'v_tracer', 'c', 'i', 'c_x')}, {_splined('sy', 'sx', 'c', 'j', 'c_y')}, {_splined('sz', 'sy', 'c_x', 'j', 'c_xy')}, "
    f"p0 AS (SELECT p.*, t.time_idx, least(CAST(floor((lon - 118e0)/{H}e0) AS INT), {N - 2}) AS i, least(CAST(floor((lat - 21e0)/{H}e0) AS INT), {N - 2}) AS j FROM v_particle p, (SELECT DISTINCT time_idx FROM v_field) t), "
    f"p1 AS (SELECT *, (lon - 118e0)/{H}e0 - i AS fx, (lat - 21e0)/{H}e0 - j AS fy FROM p0) "
    f"SELECT p1.id, p1.time_idx, {r(_curve(_side('c', 'c_y', 'a', 'e'), _side('c_x', 'c_xy', 'a', 'e'), _side('c', 'c_y', 'b', 'f'), _side('c_x', 'c_xy', 'b', 'f'), 'fx'))} AS c FROM p1 "
    "JOIN sz a ON a.time_idx = p1.time_idx AND a.j = p1.j AND a.i = p1.i JOIN sz b ON b.time_idx = p1.time_idx AND b.j = p1.j AND b.i = p1.i + 1 "
    "JOIN sz e ON e.time_idx = p1.time_idx AND e.j = p1.j + 1 AND e.i = p1.i JOIN sz f ON f.time_idx = p1.time_idx AND f.j = p1.j + 1 AND f.i = p1.i + 1",
    "v_tracer",
    "v_particle",
)
def bicubic_gather(spark, sf_dir):
    """The tracer at every particle's place at every time, by bicubic splines."""
    t = tracer(spark, sf_dir)
    p = views.particles(spark, sf_dir).join(F.broadcast(t.select("time_idx").distinct())).withColumn("depth_idx", F.lit(0))
    return cubic.bicubic(t, p, ["c"], AXES).select("id", "time_idx", rounded(F.col("c")).alias("c"))


TIMES, TARGETS, DEPTHS = [0.0, 1.0, 2.5, 4.0], [0.5, 2.0, 3.0], [0.0, 10.0, 30.0]


def _through_all(x: str) -> str:
    """The cubic through a cell's four times at x, which a spline without knots at its inner points is."""
    terms = []
    for k, t in enumerate(TIMES):
        terms.append(f"max(CASE WHEN time_idx = {k} THEN water_u END)*" + "*".join(f"({x} - {o}e0)/{t - o}e0" for o in TIMES if o != t))
    return " + ".join(terms)


@query(f"SELECT target, depth_idx, j, i, {r(_through_all('target'))} AS water_u FROM v_field, (SELECT unnest({TARGETS}::DOUBLE[]) AS target) GROUP BY 1, 2, 3, 4", "v_field")
def field_between_times(spark, sf_dir):
    made = cubic.at_times(views.field(spark, sf_dir), ["water_u"], TIMES, TARGETS, "cubic")
    return made.select("target", "depth_idx", "j", "i", rounded(F.col("water_u")).alias("water_u"))


def _four_corners(q: str) -> str:
    return f"({q}.c00*(1 - fx)*(1 - fy) + {q}.c10*fx*(1 - fy) + {q}.c01*(1 - fx)*fy + {q}.c11*fx*fy)"


_SIXTEEN = "({}*(1 - fz) + {}*fz)*(1 - ft) + ({}*(1 - fz) + {}*fz)*ft".format(*(_four_corners(f"q{n}") for n in range(4)))
_PLACE = (
    f"l AS (SELECT time_idx, CAST(k AS INT) AS depth_idx, j, i, c/(k + 1) AS c FROM v_tracer, range({len(DEPTHS)}) t(k)), "
    "o AS (SELECT *, lead(c) OVER wx AS c10 FROM l WINDOW wx AS (PARTITION BY time_idx, depth_idx, j ORDER BY i)), "
    "q AS (SELECT time_idx, depth_idx, j, i, c AS c00, c10, lead(c) OVER wy AS c01, lead(c10) OVER wy AS c11 FROM o WINDOW wy AS (PARTITION BY time_idx, depth_idx, i ORDER BY j)), "
    "p AS (SELECT id, lon, lat, CAST(id % 30 AS DOUBLE) AS depth, CAST(id % 40 AS DOUBLE)/10e0 AS time FROM v_particle), "
    f"b AS (SELECT *, least(CAST(floor((lon - 118e0)/{H}e0) AS INT), {N - 2}) AS i, least(CAST(floor((lat - 21e0)/{H}e0) AS INT), {N - 2}) AS j, CASE WHEN depth < 10 THEN 0 ELSE 1 END AS k, CASE WHEN time < 1 THEN 0 WHEN time < 2.5e0 THEN 1 ELSE 2 END AS m FROM p), "
    f"w AS (SELECT *, (lon - 118e0)/{H}e0 - i AS fx, (lat - 21e0)/{H}e0 - j AS fy, CASE k WHEN 0 THEN depth/10 ELSE (depth - 10)/20 END AS fz, CASE m WHEN 0 THEN time WHEN 1 THEN (time - 1)/1.5e0 ELSE (time - 2.5e0)/1.5e0 END AS ft FROM b)"
)


@query(
    f"{_PLACE} SELECT id, {r(_SIXTEEN)} AS c FROM w "
    + " ".join(f"JOIN q q{n} ON q{n}.time_idx = w.m + {n // 2} AND q{n}.depth_idx = w.k + {n % 2} AND q{n}.j = w.j AND q{n}.i = w.i" for n in range(4)),
    "v_tracer",
    "v_particle",
)
def sixteen_corner_gather(spark, sf_dir):
    """The tracer of three layers at every particle's place, depth and time, linear in all four directions."""
    t = tracer(spark, sf_dir).withColumn("depth_idx", F.explode(F.array(*map(F.lit, range(len(DEPTHS)))))).withColumn("c", F.col("c") / (F.col("depth_idx") + 1))
    p = views.particles(spark, sf_dir).withColumns({"depth": (F.col("id") % 30).cast("double"), "time": (F.col("id") % 40).cast("double") / 10})
    return cubic.anywhere(t, p, ["c"], AXES, DEPTHS, TIMES).select("id", rounded(F.col("c")).alias("c"))


# cubic filling: the slopes of all known points by a sweep down and up

_DOWN = "(s.b - s.a*f.ratio)"


@query(
    "k AS (SELECT key, idx, value AS v, row_number() OVER w AS n, count(*) OVER (PARTITION BY key) AS m, CAST(lead(idx) OVER w - idx AS DOUBLE) AS h, CAST(idx - lag(idx) OVER w AS DOUBLE) AS g, "
    "(lead(value) OVER w - value)/(lead(idx) OVER w - idx) AS d, (value - lag(value) OVER w)/(idx - lag(idx) OVER w) AS e FROM v_series WHERE value IS NOT NULL WINDOW w AS (PARTITION BY key ORDER BY idx)), "
    "t AS (SELECT *, lead(h) OVER w AS h1, lead(d) OVER w AS d1, lag(g) OVER w AS g1, lag(e) OVER w AS e1 FROM k WINDOW w AS (PARTITION BY key ORDER BY idx)), "
    "y AS (SELECT key, idx, v, n, m, CASE n WHEN m THEN g + g1 ELSE h END AS a, CASE n WHEN 1 THEN h1 WHEN m THEN g1 ELSE 2*(g + h) END AS b, CASE n WHEN 1 THEN h + h1 WHEN m THEN 0 ELSE g END AS c, "
    "CASE n WHEN 1 THEN ((h + 2*(h + h1))*h1*d + h*h*d1)/(h + h1) WHEN m THEN ((g + 2*(g + g1))*g1*e + g*g*e1)/(g + g1) ELSE 3*(h*e + g*d) END AS z FROM t), "
    f"f AS (SELECT key, n, c/b AS ratio, z/b AS x FROM y WHERE n = 1 UNION ALL SELECT s.key, s.n, s.c/{_DOWN}, (s.z - s.a*f.x)/{_DOWN} FROM f JOIN y s ON s.key = f.key AND s.n = f.n + 1), "
    "u AS (SELECT f.key, f.n, f.x FROM f JOIN y ON y.key = f.key AND y.n = f.n AND y.m = y.n UNION ALL SELECT f.key, f.n, f.x - f.ratio*u.x FROM u JOIN f ON f.key = u.key AND f.n = u.n - 1), "
    "o AS (SELECT y.key, y.idx, y.v, u.x AS s FROM y JOIN u ON u.key = y.key AND u.n = y.n), "
    "lo AS (SELECT a.key, a.idx, a.value, o.idx AS p0, o.v AS v0, o.s AS s0 FROM v_series a ASOF LEFT JOIN o ON a.key = o.key AND a.idx >= o.idx), "
    "b AS (SELECT lo.*, o.idx AS p1, o.v AS v1, o.s AS s1, CAST(o.idx - p0 AS DOUBLE) AS w, CAST(lo.idx - p0 AS DOUBLE)/(o.idx - p0) AS q FROM lo ASOF LEFT JOIN o ON lo.key = o.key AND lo.idx <= o.idx) "
    f"SELECT key, idx, {r('CASE WHEN value IS NOT NULL THEN value WHEN p1 - p0 - 1 <= 3 THEN v0*(1 + 2*q)*(1 - q)*(1 - q) + s0*w*q*(1 - q)*(1 - q) + v1*q*q*(3 - 2*q) - s1*w*q*q*(1 - q) END')} AS filled FROM b",
    "v_series",
)
def gap_fill_cubic(spark, sf_dir):
    return series.fill_gaps_cubic(views.series(spark, sf_dir), 3).select("key", "idx", rounded(F.col("filled")).alias("filled"))


# structures


STEEP = 0.9


@query(
    "g AS (SELECT j, i, avg(water_u) AS v FROM v_field GROUP BY 1, 2), b AS (SELECT j // 2 AS y, i // 2 AS x, avg(v) AS v, coalesce(max(v) - min(v) > " + str(STEEP) + ", false) AS s FROM g GROUP BY 1, 2), "
    "f AS (SELECT 4 AS level, y, x, v, 2 AS n, y*2 AS y0, x*2 AS x0 FROM b WHERE NOT s UNION ALL SELECT 5, g.j, g.i, g.v, 1, g.j, g.i FROM g JOIN b ON b.y = g.j // 2 AND b.x = g.i // 2 WHERE s), "
    "t AS (SELECT a.level, a.y, a.x, CASE WHEN o.x0 + o.n = a.x0 THEN 1 WHEN o.x0 = a.x0 + a.n THEN 2 WHEN o.y0 + o.n = a.y0 THEN 3 ELSE 4 END AS side, a.v AS own, o.v, a.n AS n, o.n AS m FROM f a JOIN f o ON "
    "((o.x0 + o.n = a.x0 OR o.x0 = a.x0 + a.n) AND o.y0 < a.y0 + a.n AND a.y0 < o.y0 + o.n) OR ((o.y0 + o.n = a.y0 OR o.y0 = a.y0 + a.n) AND o.x0 < a.x0 + a.n AND a.x0 < o.x0 + o.n)), "
    "q AS (SELECT level, y, x, coalesce((avg(v) - max(own))/((max(n) + max(m))/2e0)*max(n), 0e0) AS flux FROM t GROUP BY level, y, x, side), "
    f"z AS (SELECT level, y, x, sum(flux) AS flux FROM q GROUP BY 1, 2, 3) SELECT f.level, CAST(f.y AS INT) AS y, CAST(f.x AS INT) AS x, {r('f.v', 9)} AS value, {r('coalesce(flux, 0e0)/(n*n)', 9)} AS laplacian FROM f JOIN z ON z.level = f.level AND z.y = f.y AND z.x = f.x",
    "v_field",
)
def quadtree_laplacian(spark, sf_dir):
    """The field's mean over all times on cells that are joined by four where it is flat, and its fluxes across both sizes."""
    mean = views.field(spark, sf_dir).groupBy("j", "i").agg(F.avg("water_u").alias("v"))
    leaves = quadtree.balanced(quadtree.from_cells(mean, "v", 4, 5, STEEP))
    made = quadtree.laplacian(leaves, width=float(N))
    return made.select("level", "y", "x", rounded(F.col("value"), 9).alias("value"), rounded(F.col("laplacian"), 9).alias("laplacian"))


@query(f"SELECT time_idx, j, i, {r('water_u', 5)} AS water_u FROM v_field WHERE water_u IS NOT NULL", "v_field")
def radial_basis_known(spark, sf_dir):
    """Radial interpolation asked for at every cell of every slab, where it is known: it returns the data."""
    f = views.field(spark, sf_dir)
    made = interp.radial_basis(f, "water_u", f.select("lon", "lat").distinct(), AXES)
    met = made.join(f.select("time_idx", "depth_idx", "j", "i", "lon", "lat", "water_u"), ["time_idx", "depth_idx", "lon", "lat"]).where("water_u IS NOT NULL")
    return met.select("time_idx", "j", "i", rounded(F.col("value"), 5).alias("water_u"))


@query()
def radial_basis_land(spark, sf_dir):
    """The cells on land of every slab, filled by radial interpolation in patches."""
    f = views.field(spark, sf_dir)
    made = interp.radial_basis(f, "water_u", f.where("water_u IS NULL").select("lon", "lat").distinct(), AXES)
    return made.select("time_idx", "lon", "lat", rounded(F.col("value")).alias("water_u"))


@query()
def leading_modes(spark, sf_dir):
    """The three strongest modes of each block's members, by random projection."""
    d = views.ensemble(spark, sf_dir).select("block", F.col("member").alias("step"), "cell", "x")
    return series.leading_modes(d, 3, more=16, rounds=2)


@query()
def multitaper_spectrum(spark, sf_dir):
    return series.spectrum(views.series(spark, sf_dir), 1.0, "multitaper")


@query(f"SELECT c_custkey AS id, {r('118.5e0 + CAST(c_custkey % 48 AS DOUBLE) * 0.0625e0', 3)} AS start, true AS near FROM customer")
def walked(spark, sf_dir):
    """All particles after one random step, none of which is over six of its standard deviations."""
    p = views.particles(spark, sf_dir)
    moved = particles.random_walk(p.withColumn("start", F.col("lon")), ["lon", "lat"], 0.5, 1e-4)
    return moved.select("id", rounded(F.col("start"), 3).alias("start"), (F.abs(F.col("lon") - F.col("start")) < 0.06).alias("near"))


@query("SELECT time_idx, count(*) AS n, count(magnitude) AS n_wet, round(sum(magnitude), 4) + 0e0 AS total FROM (SELECT time_idx, sqrt(water_u*water_u + water_v*water_v) AS magnitude FROM v_field, range(2)) GROUP BY 1", "v_field")
def exported_vectors(spark, sf_dir):
    """The field on two layers, exported as a vector field and read again."""
    f = views.field(spark, sf_dir).withColumn("depth_idx", F.explode(F.array(F.lit(0), F.lit(1))))
    out = sinks.Export(spark, f"{shared_folder(spark)}/exports/{uuid.uuid4().hex}").set_coordinate_system("geographic")
    back = spark.read.parquet(out.vector_field_3d(f, "current", ("water_u", "water_v")))
    made = back.groupBy("time_idx").agg(F.count("*").alias("n"), F.count("magnitude").alias("n_wet"), rounded(F.sum("magnitude"), 4).alias("total"))
    return made.select("time_idx", "n", "n_wet", "total")
