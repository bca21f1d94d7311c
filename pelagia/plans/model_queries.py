"""Queries of models: particle drift, tracer transport, flow, ensembles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.operators import ensemble, flow, particles, series, stats, transport
from pelagia.plans.catalogue import query, r
from pelagia.plans.field_queries import AXES, CORNERS, H, INSIDE, N, WINDOWS, WX, WY, at_all_times, blend, tracer
from pelagia.schema import rounded
from pelagia.sources import generators, sinks, views

STEPS = 4
D = 1000.0
DT = 100.0

TRACK = (
    f"{CORNERS}, tr AS (SELECT id, 0 AS step, lon, lat FROM v_particle UNION ALL "
    f"SELECT id, step + 1, lon + u*10800e0/(111000e0*cos(radians(lat))), lat + v*10800e0/111000e0 FROM (SELECT p.id, p.step, p.lon, p.lat, {blend('water_u', 'p.fx', 'p.fy')} AS u, {blend('water_v', 'p.fx', 'p.fy')} AS v FROM "
    f"(SELECT *, (lon - 118e0)/{H}e0 - i AS fx, (lat - 21e0)/{H}e0 - j AS fy FROM (SELECT *, least(CAST(floor((lon - 118e0)/{H}e0) AS INT), {N - 2}) AS i, least(CAST(floor((lat - 21e0)/{H}e0) AS INT), {N - 2}) AS j FROM tr WHERE step < {STEPS})) p "
    f"JOIN q ON q.time_idx = p.step AND q.j = p.j AND q.i = p.i) s WHERE lon + u*10800e0/(111000e0*cos(radians(lat))) BETWEEN 118 AND 121.875 AND lat + v*10800e0/111000e0 BETWEEN 21 AND 24.875)"
)
SPEEDS = (
    f", pl AS (SELECT *, least(CAST(floor((lon - 118e0)/{H}e0) AS INT), {N - 2}) AS i, least(CAST(floor((lat - 21e0)/{H}e0) AS INT), {N - 2}) AS j FROM tr), af AS (SELECT *, (lon - 118e0)/{H}e0 - i AS fx, (lat - 21e0)/{H}e0 - j AS fy FROM pl), "
    f"uv AS (SELECT a.id, a.step, a.lon, a.lat, {blend('water_u')} AS u, {blend('water_v')} AS v FROM af a LEFT JOIN q ON q.time_idx = a.step AND q.j = a.j AND q.i = a.i AND a.step < {STEPS})"
)


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles.drift(views.field(spark, sf_dir), views.particles(spark, sf_dir), AXES, STEPS)


@query(f"{TRACK} SELECT id, step, {r('lon')} AS lon, {r('lat')} AS lat FROM tr", "v_field", "v_particle")
def drift_track(spark, sf_dir):
    return track(spark, sf_dir).select("id", "step", rounded(F.col("lon")).alias("lon"), rounded(F.col("lat")).alias("lat"))


def rk4_step(k: int) -> str:
    """CTEs that carry s<k> (id, lon, lat) one Runge-Kutta step on, to s<k+1>."""
    at, made = f"(SELECT *, lon AS x, lat AS y FROM s{k})", []
    for stage, reach in enumerate((0.5, 0.5, 1.0, 0.0)):
        cell = f"CASE WHEN x BETWEEN 118 AND 121.875 AND y BETWEEN 21 AND 24.875 THEN least(CAST(floor(({{}})/{H}e0) AS INT), {N - 2}) END"
        placed = f"SELECT *, {cell.format('x - 118e0')} AS ci, {cell.format('y - 21e0')} AS cj FROM {at}"
        inner = f"SELECT p.*, (x - 118e0)/{H}e0 - ci AS fx, (y - 21e0)/{H}e0 - cj AS fy, q.* EXCLUDE (time_idx, j, i) FROM ({placed}) p LEFT JOIN q ON q.time_idx = {k} AND q.j = p.cj AND q.i = p.ci"
        a, b = f"coalesce({blend('water_u')}, 0e0)/(111000e0*cos(radians(y)))", f"coalesce({blend('water_v')}, 0e0)/111000e0"
        before = "".join(f", a{m}, b{m}" for m in range(stage))
        slopes = f"SELECT id, lon, lat{before}, {a} AS a{stage}, {b} AS b{stage} FROM ({inner})"
        made.append(f"r{k}{stage} AS (SELECT *, lon + {reach * 10800}e0*a{stage} AS x, lat + {reach * 10800}e0*b{stage} AS y FROM ({slopes}))")
        at = f"r{k}{stage}"
    moved = f"SELECT id, lon + (a0 + 2*a1 + 2*a2 + a3)*1800e0 AS lon, lat + (b0 + 2*b1 + 2*b2 + b3)*1800e0 AS lat FROM {at}"
    return ", ".join([*made, f"s{k + 1} AS (SELECT * FROM ({moved}) WHERE {INSIDE})"])


@query(
    f"{CORNERS}, s0 AS (SELECT id, lon, lat FROM v_particle), {rk4_step(0)}, {rk4_step(1)} " + " UNION ALL ".join(f"SELECT id, {k} AS step, {r('lon')} AS lon, {r('lat')} AS lat FROM s{k}" for k in range(3)),
    "v_field",
    "v_particle",
)
def drift_rk4(spark, sf_dir):
    d = particles.drift_rk4(views.field(spark, sf_dir), views.particles(spark, sf_dir), AXES, 2)
    return d.select("id", "step", rounded(F.col("lon")).alias("lon"), rounded(F.col("lat")).alias("lat"))


def hav(a: str, b: str) -> str:
    h = f"(sin((radians({b}.lat) - radians({a}.lat))/2)*sin((radians({b}.lat) - radians({a}.lat))/2) + cos(radians({a}.lat))*cos(radians({b}.lat))*sin(radians({b}.lon - {a}.lon)/2)*sin(radians({b}.lon - {a}.lon)/2))"
    return f"2*6371e0*atan2(sqrt({h}), sqrt(1 - {h}))"


@query(
    f"{TRACK}{SPEEDS}, legs AS (SELECT b.id, {hav('a', 'b')} AS km FROM tr a JOIN tr b ON a.id = b.id AND b.step = a.step + 1), ends AS (SELECT id, max(step) AS s FROM tr GROUP BY 1), "
    f"di AS (SELECT a.id, {hav('a', 'b')} AS km FROM tr a JOIN ends e ON a.id = e.id AND a.step = 0 JOIN tr b ON b.id = e.id AND b.step = e.s), sp AS (SELECT id, count(*) AS n, avg(sqrt(u*u + v*v)) AS m, max(sqrt(u*u + v*v)) AS x FROM uv GROUP BY 1) "
    f"SELECT sp.id, sp.n AS points, {r('coalesce((SELECT sum(km) FROM legs l WHERE l.id = sp.id), 0e0)')} AS path_km, {r('di.km')} AS direct_km, {r('m')} AS mean_speed, {r('x')} AS max_speed FROM sp JOIN di ON di.id = sp.id",
    "v_field",
    "v_particle",
)
def drift_stats(spark, sf_dir):
    d = stats.trajectory_statistics(track(spark, sf_dir))
    return d.select("id", "points", *(rounded(F.col(c)).alias(c) for c in ("path_km", "direct_km", "mean_speed", "max_speed")))


@query(
    f"{TRACK}, ce AS (SELECT step, avg(lon) AS c_lon, avg(lat) AS c_lat FROM tr GROUP BY 1), di AS (SELECT tr.step, c_lon, c_lat, sqrt((lat - c_lat)*111.32e0*(lat - c_lat)*111.32e0 + (lon - c_lon)*111.32e0*cos(radians(c_lat))*(lon - c_lon)*111.32e0*cos(radians(c_lat))) AS km FROM tr JOIN ce ON tr.step = ce.step) "
    f"SELECT step, count(*) AS particles, {r('max(c_lon)')} AS c_lon, {r('max(c_lat)')} AS c_lat, {r('max(km)')} AS max_km, {r('avg(km)')} AS mean_km FROM di GROUP BY 1",
    "v_field",
    "v_particle",
)
def cloud_spread(spark, sf_dir):
    d = stats.cloud_spread(track(spark, sf_dir))
    return d.select("step", "particles", *(rounded(F.col(c)).alias(c) for c in ("c_lon", "c_lat", "max_km", "mean_km")))


@query(f"{TRACK} SELECT id, step, CAST(id AS VARCHAR) || ',' || CAST(step AS VARCHAR) || ',' || printf('%.6f', lon) || ',' || printf('%.6f', lat) AS value FROM tr", "v_field", "v_particle")
def track_lines(spark, sf_dir):
    return sinks.track_lines(track(spark, sf_dir))


@query(
    f"p AS (SELECT id, lon, lat, {INSIDE} AS inside, least(CAST(floor((lon - 118e0)/{H}e0) AS INT), {N - 2}) AS i, least(CAST(floor((lat - 21e0)/{H}e0) AS INT), {N - 2}) AS j FROM v_particle) SELECT p.id, t.time_idx, p.inside, p.inside AND f.water_u IS NOT NULL AS wet FROM p CROSS JOIN (SELECT DISTINCT time_idx FROM v_field) t LEFT JOIN v_field f ON f.time_idx = t.time_idx AND f.j = p.j AND f.i = p.i",
    "v_field",
    "v_particle",
)
def particle_validation(spark, sf_dir):
    return particles.validate(at_all_times(spark, sf_dir), views.field(spark, sf_dir), AXES).select("id", "time_idx", "inside", "wet")


#: A Runge-Kutta step turns and shrinks by this complex number; ten steps by its tenth power.
TURN = (1 - 0.02**2 / 2 + 0.02**4 / 24 + 1j * (0.02 - 0.02**3 / 6)) ** 10


@query(
    f"p AS (SELECT c_custkey AS id, 0.1e0*cos(c_custkey*0.0628e0) AS x, 0.1e0*sin(c_custkey*0.0628e0) AS y FROM customer) SELECT id, {r(f'0.5e0 + x*{TURN.real!r} - y*{TURN.imag!r}', 9)} AS x, {r(f'0.5e0 + x*{TURN.imag!r} + y*{TURN.real!r}', 9)} AS y FROM p",
    "v_particle",
)
def rotation_rk4(spark, sf_dir):
    """A particle for each customer on a circle, after ten steps about its middle."""
    p = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), (0.5 + 0.1 * F.cos(F.col("c_custkey") * 0.0628)).alias("x"), (0.5 + 0.1 * F.sin(F.col("c_custkey") * 0.0628)).alias("y"))
    return particles.rotate_rk4(p, 2.0, 0.01, 10).select("id", rounded(F.col("x"), 9).alias("x"), rounded(F.col("y"), 9).alias("y"))


# transport


def adv(c: str, vel: str, w: str, h: float = D) -> str:
    return f"{vel}*CASE WHEN {vel} > 0 THEN ({c} - lag({c}) OVER {w})/{h}e0 ELSE (lead({c}) OVER {w} - {c})/{h}e0 END"


def lap(c: str, h: float = D) -> str:
    return f"((lead({c}) OVER wx - 2*{c} + lag({c}) OVER wx)/{h * h}e0 + (lead({c}) OVER wy - 2*{c} + lag({c}) OVER wy)/{h * h}e0)"


UPWIND = f"coalesce({adv('c', 'water_u', 'wx')} + {adv('c', 'water_v', 'wy')}, 0e0)"
RATE = f"coalesce(50e0*{lap('c')}, 0e0) - {UPWIND}"


@query(f"SELECT time_idx, j, i, {r(UPWIND, 9)} AS advection FROM v_tracer {WINDOWS}", "v_tracer")
def upwind_advection(spark, sf_dir):
    d = transport.advection(tracer(spark, sf_dir), "upwind", D, D)
    return d.select("time_idx", "j", "i", rounded(F.col("advection"), 9).alias("advection"))


def lw(vel: str, w: str) -> str:
    return f"{vel}*(lead(c) OVER {w} - lag(c) OVER {w})/{2 * D}e0 - {vel}*{vel}*{DT / 2}e0*(lead(c) OVER {w} - 2*c + lag(c) OVER {w})/{D * D}e0"


@query(f"SELECT time_idx, j, i, {r('coalesce(' + lw('water_u', 'wx') + ' + ' + lw('water_v', 'wy') + ', 0e0)', 13)} AS advection FROM v_tracer {WINDOWS}", "v_tracer")
def lax_wendroff_advection(spark, sf_dir):
    d = transport.advection(tracer(spark, sf_dir), "lax_wendroff", D, D, DT)
    return d.select("time_idx", "j", "i", rounded(F.col("advection"), 13).alias("advection"))


def quick_sql(vel: str, w: str) -> str:
    at = lambda k: f"lead(c, {k}) OVER {w}" if k > 0 else f"lag(c, {-k}) OVER {w}" if k < 0 else "c"
    plus = lambda k: f"(3*{at(k + 1)} + 6*{at(k)} - {at(k - 1)})/8"
    minus = lambda k: f"(3*{at(k)} + 6*{at(k + 1)} - {at(k + 2)})/8"
    return f"{vel}*CASE WHEN {vel} > 0 THEN {plus(0)} - {plus(-1)} ELSE {minus(0)} - {minus(-1)} END/{D}e0"


@query(f"SELECT time_idx, j, i, {r('coalesce(' + quick_sql('water_u', 'wx') + ' + ' + quick_sql('water_v', 'wy') + ', 0e0)', 12)} AS advection FROM v_tracer {WINDOWS}", "v_tracer")
def quick_advection(spark, sf_dir):
    d = transport.advection(tracer(spark, sf_dir), "quick", D, D)
    return d.select("time_idx", "j", "i", rounded(F.col("advection"), 12).alias("advection"))


#: A cell's neighbours along both axes as columns, x_3 (three behind) to x3 (three ahead).
AROUND = "n AS (SELECT time_idx, j, i, water_u, water_v, " + ", ".join(f"{'lead' if k > 0 else 'lag'}(c, {abs(k)}) OVER w{a} AS {a}{str(k).replace('-', '_')}" for a in "xy" for k in range(-3, 4)) + f" FROM v_tracer {WINDOWS})"


def _at(axis: str):
    return lambda k: f"{axis}{str(k).replace('-', '_')}"


def weno_face(a: str, b: str, c: str, d: str, e: str) -> str:
    """SQL of the face value from five cells: three candidates weighed by how smooth they are."""
    sq = lambda x: f"({x})*({x})"
    smooth = (f"13/12e0*{sq(f'{a} - 2*{b} + {c}')} + {sq(f'{a} - 4*{b} + 3*{c}')}/4", f"13/12e0*{sq(f'{b} - 2*{c} + {d}')} + {sq(f'{b} - {d}')}/4", f"13/12e0*{sq(f'{c} - 2*{d} + {e}')} + {sq(f'3*{c} - 4*{d} + {e}')}/4")
    raw = [f"({g}e0/(({x} + 1e-6)*({x} + 1e-6)))" for g, x in zip((0.1, 0.6, 0.3), smooth, strict=True)]
    faces = (f"(2*{a} - 7*{b} + 11*{c})/6", f"(5*{c} - {b} + 2*{d})/6", f"(2*{c} + 5*{d} - {e})/6")
    return f"(({' + '.join(f'{w}*({x})' for w, x in zip(raw, faces, strict=True))})/({' + '.join(raw)}))"


def weno_sql(vel: str, axis: str) -> str:
    at = _at(axis)
    plus = lambda k: weno_face(*(at(k + m) for m in (-2, -1, 0, 1, 2)))
    minus = lambda k: weno_face(*(at(k + m) for m in (3, 2, 1, 0, -1)))
    return f"{vel}*CASE WHEN {vel} > 0 THEN {plus(0)} - {plus(-1)} ELSE {minus(0)} - {minus(-1)} END/{D}e0"


def muscl_sql(vel: str, axis: str) -> str:
    at = _at(axis)

    def slope(k: int) -> str:
        back, ahead = f"({at(k)} - {at(k - 1)})", f"({at(k + 1)} - {at(k)})"
        return f"CASE WHEN abs({ahead}) < 1e-15 THEN 0e0 ELSE greatest(0e0, least(1e0, {back}/{ahead}))*{ahead} END"

    right = lambda k: f"({at(k)} + 0.5e0*{slope(k)})"
    left = lambda k: f"({at(k)} - 0.5e0*{slope(k)})"
    return f"{vel}*CASE WHEN {vel} > 0 THEN {right(0)} - {right(-1)} ELSE {left(1)} - {left(0)} END/{D}e0"


@query(f"{AROUND} SELECT time_idx, j, i, {r('coalesce(' + weno_sql('water_u', 'x') + ' + ' + weno_sql('water_v', 'y') + ', 0e0)', 9)} AS advection FROM n", "v_tracer")
def weno_advection(spark, sf_dir):
    return transport.advection(tracer(spark, sf_dir), "weno5", D, D).select("time_idx", "j", "i", rounded(F.col("advection"), 9).alias("advection"))


@query(f"{AROUND} SELECT time_idx, j, i, {r('coalesce(' + muscl_sql('water_u', 'x') + ' + ' + muscl_sql('water_v', 'y') + ', 0e0)', 9)} AS advection FROM n", "v_tracer")
def muscl_advection(spark, sf_dir):
    return transport.advection(tracer(spark, sf_dir), "muscl", D, D).select("time_idx", "j", "i", rounded(F.col("advection"), 9).alias("advection"))


@query(f"SELECT time_idx, j, i, {r('coalesce(50e0*' + lap('c') + ', 0e0)', 9)} AS diffusion FROM v_tracer {WINDOWS}", "v_tracer")
def diffusion(spark, sf_dir):
    return transport.diffusion(tracer(spark, sf_dir), 50.0, D, D).select("time_idx", "j", "i", rounded(F.col("diffusion"), 9).alias("diffusion"))


@query(
    f"a AS (SELECT *, (lead(c) OVER wx - 2*c + lag(c) OVER wx)/{D * D}e0 AS xx, (lead(c) OVER wx - lag(c) OVER wx)/{2 * D}e0 AS cx FROM v_tracer WINDOW {WX}) "
    f"SELECT time_idx, j, i, {r(f'coalesce(100e0*xx + 40e0*(lead(cx) OVER wy - lag(cx) OVER wy)/{2 * D}e0 + 25e0*(lead(c) OVER wy - 2*c + lag(c) OVER wy)/{D * D}e0, 0e0)', 9)} AS diffusion FROM a WINDOW {WY}",
    "v_tracer",
)
def anisotropic_diffusion(spark, sf_dir):
    d = transport.anisotropic_diffusion(tracer(spark, sf_dir), 100.0, 20.0, 25.0, D, D)
    return d.select("time_idx", "j", "i", rounded(F.col("diffusion"), 9).alias("diffusion"))


@query(
    f"e1 AS (SELECT * REPLACE (c + {DT}e0*({RATE}) AS c) FROM v_tracer {WINDOWS}), e2 AS (SELECT * REPLACE (c + {DT}e0*({RATE}) AS c) FROM e1 {WINDOWS}) SELECT time_idx, j, i, {r('c')} AS c FROM e2",
    "v_tracer",
)
def transport_steps(spark, sf_dir):
    d = transport.run(tracer(spark, sf_dir), 2, lambda df, k: transport.euler_step(df, DT, D, D, 50.0))
    return d.select("time_idx", "j", "i", rounded(F.col("c")).alias("c"))


def edges(kind: str, value: float = 0.5) -> str:
    """SQL of transport.boundary(): x first, then y."""
    def one(axis: str, w: str) -> str:
        first, last = {
            "dirichlet": (f"{value}e0", f"{value}e0"),
            "neumann": (f"lead(c) OVER {w} - {value * D}e0", f"lag(c) OVER {w} + {value * D}e0"),
            "periodic": (f"nth_value(c, {N - 1}) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", f"nth_value(c, 2) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
        }[kind]
        return f"CASE WHEN {axis} = 0 THEN {first} WHEN {axis} = {N - 1} THEN {last} ELSE c END"

    return f"bx AS (SELECT * REPLACE ({one('i', 'wx')} AS c) FROM v_tracer WINDOW {WX}), by_ AS (SELECT * REPLACE ({one('j', 'wy')} AS c) FROM bx WINDOW {WY}) SELECT time_idx, j, i, {r('c')} AS c FROM by_"


def bounded(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return transport.boundary(tracer(spark, sf_dir), kind, N, N, D, D, 0.5).select("time_idx", "j", "i", rounded(F.col("c")).alias("c"))


@query(edges("dirichlet"), "v_tracer")
def boundary_dirichlet(spark, sf_dir):
    return bounded(spark, sf_dir, "dirichlet")


@query(edges("neumann"), "v_tracer")
def boundary_neumann(spark, sf_dir):
    return bounded(spark, sf_dir, "neumann")


@query(edges("periodic"), "v_tracer")
def boundary_periodic(spark, sf_dir):
    return bounded(spark, sf_dir, "periodic")


@query(
    f"SELECT time_idx, j, i, {r(f'CASE WHEN i = 0 THEN 0.5e0 - (lead(c) OVER wx - c)/{D}e0 WHEN i = {N - 1} THEN 0.5e0 - (c - lag(c) OVER wx)/{D}e0 ELSE c END')} AS c FROM v_tracer WINDOW {WX}",
    "v_tracer",
)
def boundary_robin(spark, sf_dir):
    return bounded(spark, sf_dir, "robin")


@query(
    "live AS (SELECT j, i, sum(intensity)*10e0 AS a FROM v_source WHERE 900 BETWEEN t_start AND t_end GROUP BY 1, 2) " f"SELECT t.time_idx, t.j, t.i, {r('c + coalesce(a, 0e0)')} AS c FROM v_tracer t LEFT JOIN live l ON t.j = l.j AND t.i = l.i",
    "v_tracer",
    "v_source",
)
def source_interval(spark, sf_dir):
    d = transport.add_sources(tracer(spark, sf_dir), views.sources(spark, sf_dir), 900.0, 10.0)
    return d.select("time_idx", "j", "i", rounded(F.col("c")).alias("c"))


@query(
    f"cells AS (SELECT DISTINCT j, i FROM v_field), m AS (SELECT c.j, c.i, intensity, CAST((s.j - c.j)*(s.j - c.j) + (s.i - c.i)*(s.i - c.i) AS DOUBLE)/4e0 AS m FROM cells c JOIN v_source s ON abs(s.j - c.j) <= 6 AND abs(s.i - c.i) <= 6) "
    f"SELECT c.j, c.i, {r('coalesce(sum(greatest(exp(-m/4), 0.3e0*exp(-m/2))*intensity), 0e0)')} AS c FROM cells c LEFT JOIN m ON m.j = c.j AND m.i = c.i GROUP BY 1, 2",
    "v_field",
    "v_source",
)
def source_superposition(spark, sf_dir):
    cells = views.field(spark, sf_dir).select("j", "i").distinct()
    return transport.superpose(cells, views.sources(spark, sf_dir), 2, 6).withColumn("c", rounded(F.col("c")))


@query(
    f"k AS (SELECT time_idx, j, i, c AS a, 1 - c/2 AS b, 0e0 AS p, 0.2e0*c*(1 - c/2) AS rate FROM v_tracer) SELECT time_idx, j, i, {r('greatest(0e0, (a - 10e0*rate*0.1e0)*exp(-0.01e0))')} AS a, {r('greatest(0e0, b - 10e0*rate*0.1e0)')} AS b, {r('greatest(0e0, p + 10e0*rate*0.1e0)')} AS p FROM k",
    "v_tracer",
)
def reactions(spark, sf_dir):
    d = tracer(spark, sf_dir).select("time_idx", "j", "i", F.col("c").alias("a"), (1 - F.col("c") / 2).alias("b"), F.lit(0.0).alias("p"))
    d = transport.react(d, [("a", "b", "p", 0.2)], 1.0, {"a": 0.01})
    return d.select("time_idx", "j", "i", *(rounded(F.col(c)).alias(c) for c in ("a", "b", "p")))


@query(
    f"t AS (SELECT *, max(c) OVER (PARTITION BY time_idx) AS mx, row_number() OVER (PARTITION BY time_idx ORDER BY c DESC, j, i) AS k FROM v_tracer) SELECT time_idx, {r('sum(c)*1e6', 2)} AS mass, max(c) AS max, {r('avg(c)')} AS mean, max(j) FILTER (k = 1) AS max_j, max(i) FILTER (k = 1) AS max_i, count(*) FILTER (c > 0.001e0*mx)*1e6 AS area FROM t GROUP BY 1",
    "v_tracer",
)
def tracer_statistics(spark, sf_dir):
    d = stats.tracer_statistics(tracer(spark, sf_dir), "c", D * D)
    return d.select("time_idx", rounded(F.col("mass"), 2).alias("mass"), "max", rounded(F.col("mean")).alias("mean"), "max_j", "max_i", "area")


@query(
    f"SELECT time_idx, {r(f'sum(CASE WHEN i = {N - 1} THEN water_u*c WHEN i = 0 THEN -water_u*c ELSE 0e0 END)*{D}e0 + sum(CASE WHEN j = {N - 1} THEN water_v*c WHEN j = 0 THEN -water_v*c ELSE 0e0 END)*{D}e0', 4)} AS flux FROM v_tracer GROUP BY 1",
    "v_tracer",
)
def boundary_flux(spark, sf_dir):
    return stats.boundary_flux(tracer(spark, sf_dir), "c", N, N, D, D).select("time_idx", rounded(F.col("flux"), 4).alias("flux"))


@query(
    f"m AS (SELECT max(abs(water_u)) AS u, max(abs(water_v)) AS v, max(sqrt(water_u*water_u + water_v*water_v)) AS s FROM v_field) SELECT {r(f'0.5e0*least({D}e0/u, {D}e0/v, {D}e0/sqrt(9810e0))')} AS flow_step, {r(f'least(0.5e0*{D}e0/s, 0.25e0*{D * D}e0/50e0)')} AS tracer_step, {r(f's*{D}e0/50e0')} AS peclet, {r(f'u/{D}e0 + v/{D}e0', 9)} AS courant_per_second FROM m",
    "v_field",
)
def time_step_limits(spark, sf_dir):
    d = stats.time_step_limits(views.field(spark, sf_dir), D, D, 50.0)
    return d.select(*(rounded(F.col(c), 9 if c == "courant_per_second" else 6).alias(c) for c in d.columns))


@query(
    f"x AS (SELECT key, idx, coalesce(value, 0e0) AS c FROM v_series), n AS (SELECT key, idx, c, coalesce(lag(c) OVER o, last_value(c) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS l, coalesce(lead(c) OVER o, first_value(c) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS r FROM x WINDOW o AS (PARTITION BY key ORDER BY idx)) SELECT key, idx, {r('c + 0.1e0*(0.5e0*(r - 2*c + l) - 1e0*(c - l))')} AS c FROM n",
    "v_series",
)
def series_transport(spark, sf_dir):
    d = views.series(spark, sf_dir).select("key", "idx", F.coalesce("value", F.lit(0.0)).alias("c"))
    return transport.series_step(d, 1.0, 0.5, 1.0, 0.1).select("key", "idx", rounded(F.col("c")).alias("c"))


CELL = 13915.0
_DAMP = "CASE least({a}, {n} - {a}) WHEN 0 THEN 0.45e0 WHEN 1 THEN 0.9e0 ELSE 1e0 END"
_W1 = math.exp(-12.5) / (1 + 2 * math.exp(-12.5))


def _one_sided(c: str, w: str, axis: str) -> str:
    return f"CASE {axis} WHEN 0 THEN (lead({c}) OVER {w} - {c})/{CELL}e0 WHEN {N - 1} THEN ({c} - lag({c}) OVER {w})/{CELL}e0 ELSE (lead({c}) OVER {w} - lag({c}) OVER {w})/{2 * CELL}e0 END"


@query(
    f"a AS (SELECT *, {_one_sided('c', 'wx', 'i')} AS cx, {_one_sided('c', 'wy', 'j')} AS cy FROM v_tracer {WINDOWS}), b AS (SELECT *, {_one_sided('cx', 'wx', 'i')} AS cxx, {_one_sided('cy', 'wy', 'j')} AS cyy FROM a {WINDOWS}), "
    f"d AS (SELECT time_idx, depth_idx, j, i, greatest(0e0, c + 300*(-water_u*cx - water_v*cy + 500*(cxx + cyy) - 5e-5*c))*{_DAMP.format(a='i', n=N - 1)}*{_DAMP.format(a='j', n=N - 1)} AS c FROM b), "
    f"e AS (SELECT time_idx, depth_idx, j, i, {1 - 2 * _W1!r}::DOUBLE*c + {_W1!r}::DOUBLE*(coalesce(lag(c) OVER wx, c) + coalesce(lead(c) OVER wx, c)) AS c FROM d {WINDOWS}) "
    f"SELECT time_idx, j, i, {r(f'{1 - 2 * _W1!r}::DOUBLE*c + {_W1!r}::DOUBLE*(coalesce(lag(c) OVER wy, c) + coalesce(lead(c) OVER wy, c))')} AS c FROM e {WINDOWS}",
    "v_tracer",
)
def dispersion_step(spark, sf_dir):
    return transport.dispersion_step(tracer(spark, sf_dir), 300.0, 13915.0, N, N).select("time_idx", "j", "i", rounded(F.col("c")).alias("c"))


@query()
def implicit_step(spark, sf_dir):
    return transport.implicit_diffusion(tracer(spark, sf_dir), 5000.0, D, D, 50.0, 0.5).select("time_idx", "j", "i", rounded(F.col("c")).alias("c"))


# flow


FLOW = "fl AS (SELECT time_idx, depth_idx, j, i, water_u AS u, water_v AS v, c AS eta FROM v_tracer)"


def flow_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracer(spark, sf_dir).select("time_idx", "depth_idx", "j", "i", F.col("water_u").alias("u"), F.col("water_v").alias("v"), F.col("c").alias("eta"))


def cen(c: str, w: str) -> str:
    return f"(lead({c}) OVER {w} - lag({c}) OVER {w})/{2 * D}e0"


@query(
    f"{FLOW}, g AS (SELECT *, {cen('u', 'wx')} AS ux, {cen('v', 'wy')} AS vy, {cen('eta', 'wx')} AS ex, {cen('eta', 'wy')} AS ey FROM fl {WINDOWS}) "
    f"SELECT time_idx, j, i, {r('CASE WHEN ux IS NULL OR vy IS NULL THEN u ELSE u + 2e0*(1e-4*v - 9.81e0*ex) END', 10)} AS u, {r('CASE WHEN ux IS NULL OR vy IS NULL THEN v ELSE v + 2e0*(-1e-4*u - 9.81e0*ey) END', 10)} AS v, {r('CASE WHEN ux IS NULL OR vy IS NULL THEN eta ELSE eta - 2e0*1000e0*(ux + vy) END', 10)} AS eta FROM g",
    "v_tracer",
)
def barotropic_step(spark, sf_dir):
    d = flow.barotropic_step(flow_state(spark, sf_dir), 2.0, D, D, 1e-4)
    return d.select("time_idx", "j", "i", *(rounded(F.col(c), 10).alias(c) for c in ("u", "v", "eta")))


@query(
    f"{FLOW} SELECT time_idx, j, i, {r('coalesce(eta + 10e0*(100e0*' + lap('eta') + ' - u*' + cen('eta', 'wx') + ' - v*' + cen('eta', 'wy') + '), eta)', 12)} AS eta FROM fl {WINDOWS}",
    "v_tracer",
)
def flow_tracer_step(spark, sf_dir):
    return flow.tracer_step(flow_state(spark, sf_dir), "eta", 10.0, D, D, 100.0).select("time_idx", "j", "i", rounded(F.col("eta"), 12).alias("eta"))


@query(
    f"{FLOW}, x AS (SELECT *, CASE WHEN i = 0 THEN lead(eta) OVER wx WHEN i = {N - 1} THEN lag(eta) OVER wx ELSE eta END AS ex FROM fl WINDOW {WX}) SELECT time_idx, j, i, CASE WHEN i IN (0, {N - 1}) OR j IN (0, {N - 1}) THEN 0e0 ELSE u END AS u, CASE WHEN j = 0 THEN lead(ex) OVER wy WHEN j = {N - 1} THEN lag(ex) OVER wy ELSE ex END AS eta FROM x WINDOW {WY}",
    "v_tracer",
)
def flow_walls(spark, sf_dir):
    return flow.walls(flow_state(spark, sf_dir), N, N).select("time_idx", "j", "i", "u", "eta")


@query(f"{FLOW} SELECT time_idx, {r('sum((u*u + v*v)/2)*1e6', 1)} AS kinetic, {r('sum(eta*eta)*0.5e0*9.81e0*1e6', 1)} AS potential FROM fl GROUP BY 1", "v_tracer")
def flow_energy(spark, sf_dir):
    return flow.energy(flow_state(spark, sf_dir), D, D).select("time_idx", rounded(F.col("kinetic"), 1).alias("kinetic"), rounded(F.col("potential"), 1).alias("potential"))


@query(
    f"{FLOW} SELECT time_idx, {r(f'(sum(CASE WHEN i = 0 THEN u ELSE 0e0 END) - sum(CASE WHEN i = {N - 1} THEN u ELSE 0e0 END))*{D}e0 + (sum(CASE WHEN j = 0 THEN v ELSE 0e0 END) - sum(CASE WHEN j = {N - 1} THEN v ELSE 0e0 END))*{D}e0', 3)} AS imbalance FROM fl GROUP BY 1",
    "v_tracer",
)
def mass_imbalance(spark, sf_dir):
    return flow.mass_imbalance(flow_state(spark, sf_dir), N, N, D, D).select("time_idx", rounded(F.col("imbalance"), 3).alias("imbalance"))


@query(
    "d AS (SELECT time_idx, j, i, lon - 121 AS dx, lat - 23.75e0 AS dy FROM v_field), s AS (SELECT *, sqrt(dx*dx + dy*dy) AS r FROM d), t AS (SELECT *, CASE WHEN r <= 0.01e0 THEN 0e0 ELSE 0.5e0*exp(-2*r)/r END AS s FROM s) "
    f"SELECT time_idx, j, i, {r('-dy*s')} AS water_u, {r('dx*s')} AS water_v FROM t",
    "v_field",
)
def vortex_field(spark, sf_dir):
    """The vortex at every cell of the field."""
    made = generators.swirled(views.field(spark, sf_dir))
    return made.select("time_idx", "j", "i", rounded(F.col("water_u")).alias("water_u"), rounded(F.col("water_v")).alias("water_v"))


# ensembles


@query(f"SELECT block, cell, {r('avg(x)')} AS mean, {r('coalesce(var_samp(x), 0e0)')} AS variance, {r('coalesce(stddev_samp(x), 0e0)')} AS std FROM v_ensemble GROUP BY 1, 2", "v_ensemble")
def ensemble_mean(spark, sf_dir):
    return ensemble.mean_and_spread(views.ensemble(spark, sf_dir)).select("block", "cell", *(rounded(F.col(c)).alias(c) for c in ("mean", "variance", "std")))


@query(f"d AS (SELECT block, x, avg(x) OVER (PARTITION BY block, cell) AS m FROM v_ensemble) SELECT block, {r('sqrt(avg((x - m)*(x - m)))')} AS spread, {r('sqrt(avg(m*m))')} AS mean_norm FROM d GROUP BY 1", "v_ensemble")
def ensemble_spread(spark, sf_dir):
    return ensemble.spread(views.ensemble(spark, sf_dir)).select("block", rounded(F.col("spread")).alias("spread"), rounded(F.col("mean_norm")).alias("mean_norm"))


@query(
    f"d AS (SELECT block, member, cell, x - avg(x) OVER (PARTITION BY block, cell) AS d FROM v_ensemble), n AS (SELECT count(DISTINCT member) AS n FROM v_ensemble), s AS (SELECT a.block, a.cell AS r, b.cell AS c, sum(a.d*b.d) AS s, (b.cell - a.cell)/3e0 AS q FROM d a JOIN d b ON a.block = b.block AND a.member = b.member AND b.cell - a.cell BETWEEN 0 AND 6 GROUP BY 1, 2, 3) "
    f"SELECT block, r, c, {r('s/(n - 1)*CASE WHEN q <= 1 THEN (((-0.25e0*q + 0.5e0)*q + 0.625e0)*q - 5e0/3)*q*q + 1 WHEN q <= 2 THEN ((((q/12 - 0.5e0)*q + 0.625e0)*q + 5e0/3)*q - 5)*q + 4 - 2/(3*q) ELSE 0e0 END')} AS covariance FROM s, n",
    "v_ensemble",
)
def localized_covariance(spark, sf_dir):
    return ensemble.covariance(views.ensemble(spark, sf_dir), 3.0).withColumn("covariance", rounded(F.col("covariance")))


@query(f"d AS (SELECT *, avg(x) OVER (PARTITION BY block, cell) AS m FROM v_ensemble) SELECT member, block, cell, {r('m + 1.05e0*(x - m)', 10)} AS x FROM d", "v_ensemble")
def inflation(spark, sf_dir):
    return ensemble.inflate(views.ensemble(spark, sf_dir), 1.05).withColumn("x", rounded(F.col("x"), 10))


OBS_BLOCK = "ob AS (SELECT CAST(o_orderkey % 25 AS BIGINT) AS block, CAST(o_custkey % 64 AS INT) AS cell, avg(CAST(o_orderkey % 200 AS DOUBLE)/100e0 - 1) AS y, 0.25e0 AS r FROM orders GROUP BY 1, 2)"


def block_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy((F.col("o_orderkey") % 25).cast("long").alias("block"), (F.col("o_custkey") % 64).cast("int").alias("cell")).agg(F.avg((F.col("o_orderkey") % 200).cast("double") / 100.0 - 1).alias("y")).withColumn("r", F.lit(0.25))


@query(
    f"{OBS_BLOCK}, d AS (SELECT e.*, coalesce(var_samp(x) OVER (PARTITION BY block, cell), 0e0) AS p FROM v_ensemble e) SELECT member, d.block, d.cell, {r('CASE WHEN y IS NULL THEN x ELSE x + p/(p + r)*(y - x) END')} AS x FROM d LEFT JOIN ob ON ob.block = d.block AND ob.cell = d.cell",
    "v_ensemble",
)
def scalar_analysis(spark, sf_dir):
    return ensemble.scalar_analysis(views.ensemble(spark, sf_dir), block_observations(spark, sf_dir)).select("member", "block", "cell", rounded(F.col("x")).alias("x"))


@query(
    f"{OBS_BLOCK}, m AS (SELECT block, cell, avg(x) AS m FROM v_ensemble GROUP BY 1, 2) SELECT {r('sqrt(avg((m - y)*(m - y)))')} AS rmse, {r('corr(m, y)')} AS correlation, {r('avg(m - y)')} AS bias, count(*) AS n FROM m JOIN ob USING (block, cell)",
    "v_ensemble",
)
def filter_quality(spark, sf_dir):
    d = ensemble.quality(ensemble.mean_and_spread(views.ensemble(spark, sf_dir)), block_observations(spark, sf_dir))
    return d.select(*(rounded(F.col(c)).alias(c) for c in ("rmse", "correlation", "bias")), "n")


@query(
    "v AS (SELECT obs_type, CASE obs_type WHEN 'sla' THEN abs(value) <= 2 WHEN 'sst' THEN value BETWEEN -2 AND 35 ELSE value BETWEEN 0 AND 1 END AS ok FROM v_obs) SELECT obs_type, count(*) AS n, count(*) FILTER (ok) AS n_valid, bool_and(ok) AS all_valid FROM v GROUP BY 1",
    "v_obs",
)
def observation_validity(spark, sf_dir):
    return ensemble.observation_validity(views.observations(spark, sf_dir))


@query(
    f"st AS (SELECT time_idx, j, i, 10e0 + c AS t, 34e0 + c AS s, water_u AS u, water_v AS v, c - 0.5e0 AS eta FROM v_tracer), n AS (SELECT *, t + 0.5e0*(0.001e0*(15 - t) - 0.01e0*sqrt(u*u + v*v)*t) AS t1, u - 0.5e0*9.81e0*1e-4*eta AS u1, v + 0.5e0*9.81e0*1e-4*eta AS v1 FROM st) "
    f"SELECT time_idx, j, i, {r('greatest(-2e0, least(35e0, t1))')} AS temperature, {r('u1')} AS u, {r('eta - 0.5e0*0.01e0*sqrt(u1*u1 + v1*v1)')} AS eta FROM n",
    "v_tracer",
)
def ensemble_forecast(spark, sf_dir):
    d = tracer(spark, sf_dir).select("time_idx", "j", "i", (10 + F.col("c")).alias("temperature"), (34 + F.col("c")).alias("salinity"), F.col("water_u").alias("u"), F.col("water_v").alias("v"), (F.col("c") - 0.5).alias("eta"))
    return ensemble.forecast(d, 0.5).select("time_idx", "j", "i", *(rounded(F.col(c)).alias(c) for c in ("temperature", "u", "eta")))


@query()
def ensemble_analysis(spark, sf_dir):
    return ensemble.analysis(views.ensemble(spark, sf_dir), block_observations(spark, sf_dir), 6.0).withColumn("x", rounded(F.col("x")))


@query()
def orthogonal_modes(spark, sf_dir):
    d = views.ensemble(spark, sf_dir).select("block", F.col("member").alias("step"), "cell", "x")
    return series.orthogonal_modes(d, 3)


@query(f"SELECT {r('2*7.2921159e-5*sin(radians((min(lat) + max(lat))/2))', 12)} AS coriolis, {r('radians((max(lon) - min(lon))/(count(DISTINCT lon) - 1))*6371000e0*cos(radians((min(lat) + max(lat))/2))', 3)} AS dx, {r('radians((max(lat) - min(lat))/(count(DISTINCT lat) - 1))*6371000e0', 3)} AS dy FROM v_field", "v_field")
def grid_spacing(spark, sf_dir):
    d = flow.grid_spacing(views.field(spark, sf_dir))
    return d.select(rounded(F.col("coriolis"), 12).alias("coriolis"), rounded(F.col("dx"), 3).alias("dx"), rounded(F.col("dy"), 3).alias("dy"))
