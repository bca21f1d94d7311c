"""Queries of coupled models, the set-up of filters, alerts, and checks of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagia.functions.geo import haversine
from pelagia.operators import assimilation, coupled, ensemble, interp, stats
from pelagia.plans.catalogue import query, r
from pelagia.plans.field_queries import AXES, CORNERS, H, INSIDE, N, WX, WY, at_all_times, blend, slope, tracer
from pelagia.plans.model_queries import OBS_BLOCK, block_observations, hav
from pelagia.schema import rounded
from pelagia.sources import synthetic, views
from pelagia.streaming import alerts as streams

DX = 1000.0


def upwind_sql(velocity: str, w: str, axis: str) -> str:
    return f"CASE WHEN {axis} BETWEEN 1 AND {N - 2} THEN {velocity}*CASE WHEN {velocity} > 0 THEN (c - lag(c) OVER {w})/{DX}e0 ELSE (lead(c) OVER {w} - c)/{DX}e0 END ELSE 0e0 END"


@query(f"SELECT time_idx, j, i, {r('c - 100e0*(' + upwind_sql('water_u', 'wx', 'i') + ' + ' + upwind_sql('water_v', 'wy', 'j') + ')', 9)} AS c FROM v_tracer WINDOW {WX}, {WY}", "v_tracer")
def layer_advection(spark, sf_dir):
    return coupled.advected(tracer(spark, sf_dir), 100.0, DX, DX).select("time_idx", "j", "i", rounded(F.col("c"), 9).alias("c"))


@query()
def dispersion_3d(spark, sf_dir):
    """Three layers of the tracer, fed by the suppliers' sources in the first."""
    t = tracer(spark, sf_dir).withColumn("depth_idx", F.explode(F.array(*map(F.lit, range(3))))).withColumn("c", F.col("c") / (F.col("depth_idx") + 1))
    s = views.sources(spark, sf_dir).withColumn("depth_idx", F.lit(0))
    return coupled.dispersion_3d_step(t, 100.0, DX, DX, (N, N, 3), 0.005, 0.001, s, 700.0, 1e-4)


@query()
def dispersed(spark, sf_dir):
    return coupled.dispersed(tracer(spark, sf_dir), 900.0, DX, N, N)


@query()
def coupled_run(spark, sf_dir):
    """Particles after two coupled steps of every time's flow."""
    t = tracer(spark, sf_dir).select("time_idx", "depth_idx", "j", "i", F.col("water_u").alias("u"), F.col("water_v").alias("v"), (F.col("c") / 10).alias("eta"), "c")
    p = at_all_times(spark, sf_dir).drop("depth_idx")
    *_, (_, _, moved) = coupled.coupled(t, p, AXES, 2, 10.0, H * coupled.DEGREE, 1e-4, sources=views.sources(spark, sf_dir))
    return moved


@query(
    f"{CORNERS}, c0 AS (SELECT * FROM q), a0 AS (SELECT id, t.time_idx, lon, lat, least(CAST(floor((lon - 118e0)/{H}e0) AS INT), {N - 2}) AS i, least(CAST(floor((lat - 21e0)/{H}e0) AS INT), {N - 2}) AS j FROM v_particle, (SELECT DISTINCT time_idx FROM v_field) t WHERE {INSIDE}), "
    f"a AS (SELECT p.id, p.time_idx, p.lon, p.lat, {blend('water_u', f'((p.lon - 118e0)/{H}e0 - p.i)', f'((p.lat - 21e0)/{H}e0 - p.j)')} AS au, {blend('water_v', f'((p.lon - 118e0)/{H}e0 - p.i)', f'((p.lat - 21e0)/{H}e0 - p.j)')} AS av FROM a0 p JOIN c0 ON c0.time_idx = p.time_idx AND c0.j = p.j AND c0.i = p.i), "
    f"h AS (SELECT *, lon + au*0.005e0 AS hx, lat + av*0.005e0 AS hy FROM a), b0 AS (SELECT *, least(CAST(floor((hx - 118e0)/{H}e0) AS INT), {N - 2}) AS i, least(CAST(floor((hy - 21e0)/{H}e0) AS INT), {N - 2}) AS j FROM h), "
    f"b AS (SELECT p.id, p.time_idx, p.lon, p.lat, p.au, p.av, p.hx, p.hy, {blend('water_u', f'((p.hx - 118e0)/{H}e0 - p.i)', f'((p.hy - 21e0)/{H}e0 - p.j)')} AS bu, {blend('water_v', f'((p.hx - 118e0)/{H}e0 - p.i)', f'((p.hy - 21e0)/{H}e0 - p.j)')} AS bv FROM b0 p JOIN c0 ON c0.time_idx = p.time_idx AND c0.j = p.j AND c0.i = p.i), "
    f"e AS (SELECT *, sqrt((bu - au)*(bu - au) + (bv - av)*(bv - av))*0.005e0 AS err FROM b) "
    f"SELECT id, time_idx, {r('CASE WHEN err <= 0.0005e0 THEN hx + bu*0.005e0 ELSE lon END')} AS lon, {r('CASE WHEN err <= 0.0005e0 THEN hy + bv*0.005e0 ELSE lat END')} AS lat, {r('err')} AS error, err <= 0.0005e0 AS taken FROM e",
    "v_field",
    "v_particle",
)
def step_doubling(spark, sf_dir):
    cells = interp.corners(views.field(spark, sf_dir), ["water_u", "water_v"])
    made = coupled.step_doubling(at_all_times(spark, sf_dir), cells, AXES, 0.01, 0.0005)
    return made.select("id", "time_idx", rounded(F.col("lon")).alias("lon"), rounded(F.col("lat")).alias("lat"), rounded(F.col("error")).alias("error"), "taken")


def number(x: float) -> str:
    """A number as SQL that keeps all of its digits."""
    return f"CAST('{x!r}' AS DOUBLE)"


WIDTH, DEEP = 100_000.0, 40.0
_TURNS = " ".join(f"{{sign}} (CASE WHEN {{r{n}}} < {radius * synthetic.CORE}e0 THEN {number(strength / (radius * synthetic.CORE))} WHEN {{r{n}}} < {radius}e0 THEN {number(strength * radius * synthetic.CORE)}/({{r{n}}}*{{r{n}}}) ELSE 0e0 END*exp(-({{r{n}}}/{radius}e0)*({{r{n}}}/{radius}e0)))*({{axis}} - {{m{n}}})" for n, (_, _, strength, radius) in enumerate(synthetic.EDDIES))


def _turned(sign: str, axis: str) -> str:
    """SQL of what all eddies add to a velocity across `axis`."""
    radii = {f"r{n}": f"sqrt((x - {WIDTH / 2 + e}e0)*(x - {WIDTH / 2 + e}e0) + (y - {WIDTH / 2 + o}e0)*(y - {WIDTH / 2 + o}e0))" for n, (e, o, _, _) in enumerate(synthetic.EDDIES)}
    middles = {f"m{n}": f"{WIDTH / 2 + (o if axis == 'y' else e)}e0" for n, (e, o, _, _) in enumerate(synthetic.EDDIES)}
    return _TURNS.format(sign=sign, axis=axis, **radii, **middles)


@query(
    f"g AS (SELECT time_idx, CAST(k AS INT) AS depth_idx, j, i, i*{number(WIDTH / (N - 1))} AS x, j*{number(WIDTH / (N - 1))} AS y, k*10e0 AS z FROM v_field, range(5) t(k)), "
    f"v AS (SELECT *, (0.5e0 {_turned('-', 'y')})*exp(-z/50) AS u, (0.1e0*sin(2*pi()*x/{WIDTH}e0) {_turned('+', 'x')})*exp(-z/50) AS v FROM g), "
    f"s AS (SELECT *, {slope('u', 'wx', 1.0)} AS ux, {slope('v', 'wy', 1.0)} AS vy FROM v WINDOW {WX}, {WY}), "
    "w AS (SELECT *, sum(CASE WHEN depth_idx > 0 THEN -(ux + vy)*10 ELSE 0e0 END) OVER (PARTITION BY time_idx, j, i ORDER BY depth_idx) AS w FROM s) "
    f"SELECT time_idx, depth_idx, j, i, {r('u')} AS u, {r('v')} AS v, {r('w')} AS w, {r(f'25 - 15*(z/{DEEP}e0) + 2*sin(2*pi()*x/{WIDTH}e0)*exp(-z/30)')} AS temperature, {r(f'35 + (y - {WIDTH / 2}e0)/{WIDTH}e0 + 0.5e0*(z/{DEEP}e0)')} AS salinity FROM w",
    "v_field",
)
def layered_ocean(spark, sf_dir):
    """Five layers of the analytic ocean on the field's cells and times."""
    d = views.field(spark, sf_dir).withColumn("depth_idx", F.explode(F.array(*map(F.lit, range(5)))))
    d = d.select("time_idx", "depth_idx", "j", "i", *((F.col(c) * (WIDTH / (N - 1))).alias(a) for c, a in (("i", "x"), ("j", "y"))), (F.col("depth_idx") * 10.0).alias("z"))
    made = synthetic.layered(d, WIDTH, DEEP, 10.0)
    return made.select("time_idx", "depth_idx", "j", "i", *(rounded(F.col(c)).alias(c) for c in ("u", "v", "w", "temperature", "salinity")))


@query()
def initial_ensemble(spark, sf_dir):
    """20 members drawn around each block's mean with its own localised covariance, made definite by a small diagonal."""
    e = views.ensemble(spark, sf_dir)
    mean = ensemble.mean_and_spread(e).select("block", "cell", "mean")
    cov = ensemble.covariance(e, 4.0).withColumn("covariance", F.col("covariance") + F.when(F.col("r") == F.col("c"), 1e-3).otherwise(0.0))
    return assimilation.initial_ensemble(mean, cov, 20)


@query()
def definite_covariance(spark, sf_dir):
    return assimilation.positive_definite(ensemble.covariance(views.ensemble(spark, sf_dir), 4.0))


@query(
    "m AS (SELECT block, x, x - avg(x) OVER (PARTITION BY block, cell) AS d FROM v_ensemble), s AS (SELECT block, count(CASE WHEN abs(x) <= 0.3e0 THEN NULL ELSE 1 END) AS n_invalid, sqrt(avg(d*d)) AS s FROM m GROUP BY 1) "
    f"SELECT block, n_invalid, {r('s')} AS spread, n_invalid = 0 AND s BETWEEN 1e-10 AND 100 AS consistent, NOT s BETWEEN 1e-8 AND 1000 AS diverged FROM s",
    "v_ensemble",
)
def ensemble_consistency(spark, sf_dir):
    d = assimilation.consistency(views.ensemble(spark, sf_dir), (-0.3, 0.3))
    return d.withColumn("spread", rounded(F.col("spread")))


@query(
    f"a AS (SELECT block, cell, avg(x) AS m0, coalesce(var_samp(x), 0e0) AS p FROM v_ensemble GROUP BY 1, 2), {OBS_BLOCK}, b AS (SELECT a.block, CASE WHEN y IS NULL THEN 0e0 ELSE p/(p + r)*(y - m0) END AS d FROM a LEFT JOIN ob ON ob.block = a.block AND ob.cell = a.cell) SELECT block, {r('sqrt(sum(d*d))')} AS norm FROM b GROUP BY 1",
    "v_ensemble",
)
def increment_norms(spark, sf_dir):
    e = views.ensemble(spark, sf_dir)
    made = assimilation.increment_norms(e, ensemble.scalar_analysis(e, block_observations(spark, sf_dir)))
    return made.select("block", rounded(F.col("norm")).alias("norm"))


@query(
    f"p AS (SELECT id, lon, lat FROM v_particle), q AS (SELECT id, lon + CAST(id % 7 AS DOUBLE)*0.001e0 AS lon, lat FROM v_particle) SELECT count(*) AS n, {r('avg(' + hav('a', 'b') + ')')} AS mean_error FROM p a JOIN q b ON a.id = b.id",
    "v_particle",
)
def transformation_error(spark, sf_dir):
    p = views.particles(spark, sf_dir)
    q = p.withColumn("lon", F.col("lon") + (F.col("id") % 7).cast("double") * 0.001)
    made = stats.paired_error(p, q, "id", lambda *at: haversine(*at, radius=6371.0))
    return made.select("n", rounded(F.col("mean_error")).alias("mean_error"))


@query(f"SELECT time_idx, depth_idx, count(*) AS n, count(DISTINCT j) AS n_y, count(DISTINCT i) AS n_x, count(DISTINCT lat) AS n_lat, count(DISTINCT lon) AS n_lon, count(*) = {N * N} AND count(DISTINCT lat) = {N} AND count(DISTINCT lon) = {N} AS whole FROM v_field GROUP BY 1, 2", "v_field")
def grid_shape(spark, sf_dir):
    return stats.grid_shape(views.field(spark, sf_dir), N, N)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def tasks_by_status(spark, sf_dir):
    return stats.with_status(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderstatus", "F").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "WITH l AS (SELECT event_type AS key, quantile_disc(value, 0.9) AS lim FROM events WHERE value IS NOT NULL GROUP BY 1), w AS (SELECT time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) AS start, event_type AS key, count(value) AS n, avg(value) AS mean, max(value) AS most FROM events GROUP BY 1, 2) "
    f"SELECT CAST(epoch(start) AS BIGINT) AS start, w.key, n, {r('mean')} AS mean, most, l.lim AS \"limit\" FROM w JOIN l ON l.key = w.key WHERE most > l.lim",
)
def metric_alerts(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.col("event_type").alias("key"), "value")
    limits = e.where("value IS NOT NULL").groupBy("key").agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY value)").alias("limit"))
    made = streams.alerts(e, limits, width="1 hour")
    return made.select(F.col("start").cast("timestamp").cast("long").alias("start"), "key", "n", rounded(F.col("mean")).alias("mean"), "most", "limit")
