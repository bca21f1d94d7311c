"""Queries of the remaining operators: ordinary differential equations, layers, angles, tasks, sessions of releases."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from pelagia.operators import ensemble, grid, ode, particles, stats, stencil, transport
from pelagia.plans.catalogue import query, r
from pelagia.plans.field_queries import N, WX, gradient_field, gradients, mirrored, tracer
from pelagia.plans.model_queries import DT, D, OBS_BLOCK, block_observations, lap
from pelagia.schema import rounded
from pelagia.sources import generators, views

#: Weights of a narrow Gaussian.
HALF = stencil.gaussian_weights(0.5)


@query(
    "a AS (SELECT *, lag(c) OVER wx AS w, lead(c) OVER wx AS e, lag(c) OVER wy AS s, lead(c) OVER wy AS n FROM v_tracer WINDOW wx AS (PARTITION BY time_idx, depth_idx, j ORDER BY i), wy AS (PARTITION BY time_idx, depth_idx, i ORDER BY j)) "
    f"SELECT {r('avg(CASE WHEN (c > w AND c > e AND c > s AND c > n) OR (c < w AND c < e AND c < s AND c < n) THEN 1e0 ELSE 0e0 END)')} AS share FROM a WHERE i BETWEEN 1 AND {N - 2} AND j BETWEEN 1 AND {N - 2}",
    "v_tracer",
)
def oscillations(spark, sf_dir):
    d = stencil.local_extrema(tracer(spark, sf_dir), "c").where(f"i BETWEEN 1 AND {N - 2} AND j BETWEEN 1 AND {N - 2}")
    return stats.oscillation_share(d).select(rounded(F.col("share")).alias("share"))


@query(
    f"wt(k, w) AS (VALUES {', '.join(f'({k}, {HALF[abs(k)]!r}e0)' for k in range(1 - len(HALF), len(HALF)))}), "
    f"m AS (SELECT a.time_idx, a.j, a.i, sum(cos(radians(b.c*300))*w) AS x, sum(sin(radians(b.c*300))*w) AS y FROM v_tracer a CROSS JOIN wt JOIN v_tracer b ON b.time_idx = a.time_idx AND b.j = a.j AND b.i = {mirrored('a.i + wt.k')} GROUP BY 1, 2, 3) "
    f"SELECT time_idx, j, i, {r('CASE WHEN degrees(atan2(y, x)) < 0 THEN degrees(atan2(y, x)) + 360 ELSE degrees(atan2(y, x)) END', 5)} AS smoothed FROM m",
    "v_tracer",
)
def smooth_angles(spark, sf_dir):
    d = tracer(spark, sf_dir).withColumn("angle", F.col("c") * 300)
    return stencil.smooth_angles(d, "angle", "i", N, 0.5).select("time_idx", "j", "i", rounded(F.col("smoothed"), 5).alias("smoothed"))


@query(f"{gradients()} SELECT time_idx, j, i, {r('-(u_x + v_y)*10e0')} AS w FROM g", "v_field")
def vertical_velocity(spark, sf_dir):
    return stencil.vertical_velocity(gradient_field(spark, sf_dir), 10.0).select("time_idx", "j", "i", rounded(F.col("w")).alias("w"))


@query(f"SELECT j, i, {r('sum(c)*25e0')} AS total FROM v_tracer GROUP BY 1, 2", "v_tracer")
def column_total(spark, sf_dir):
    return tracer(spark, sf_dir).groupBy("j", "i").agg(rounded(F.sum(F.col("c") * 25.0)).alias("total"))


@query("SELECT event_type, count(*) AS n, " + r("sum(value)", 3) + " AS total, min(value) AS least, max(value) AS most, " + r("avg(value)") + " AS mean, " + r("avg(CASE WHEN value > 50 THEN 1e0 ELSE 0e0 END)") + " AS share FROM events GROUP BY 1")
def task_statistics(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), rounded(F.sum("value"), 3).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), rounded(F.avg("value")).alias("mean"), rounded(F.avg((F.col("value") > 50).cast("double"))).alias("share"))


@query("SELECT event_id, event_type, " + r("avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)", 9) + " AS recent FROM events")
def recent_average(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(-59, 0)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", rounded(F.avg("value").over(w), 9).alias("recent"))


@query(
    "p AS (SELECT id, lon AS x, lat AS y FROM v_particle ) SELECT count(*) AS pairs, " + r("avg(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)))") + " AS mean, " + r("stddev_pop(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)))") + " AS std FROM p a JOIN p b ON a.id < b.id AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 0.015625e0",
    "v_particle",
)
def pair_distances(spark, sf_dir):
    p = views.particles(spark, sf_dir).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return stats.pair_summary(p, 0.125, cell=0.125).select("pairs", rounded(F.col("mean")).alias("mean"), rounded(F.col("std")).alias("std"))


@query("SELECT id, " + r("lon*exp(-0.5e0)", 2) + " AS x FROM v_particle", "v_particle")
def decay_rk4(spark, sf_dir):
    d = views.particles(spark, sf_dir).select("id", F.col("lon").alias("x"))
    return ode.solve(d, ["x"], 0.05, 10, lambda s, t: {"x": -s["x"]}).select("id", rounded(F.col("x"), 2).alias("x"))


@query("SELECT id, " + r("lon*exp(-0.5e0)", 4) + " AS x, " + r("lat*exp(-1e0)", 4) + " AS y FROM v_particle", "v_particle")
def decay_adaptive(spark, sf_dir):
    d = views.particles(spark, sf_dir).select("id", F.array("lon", "lat").alias("state"))
    made = ode.solve_adaptive(d, "state", 0.5, lambda y, t: y * [-1.0, -2.0], 1e-9)
    return made.select("id", rounded(F.col("state")[0], 4).alias("x"), rounded(F.col("state")[1], 4).alias("y"))


@query()
def decay_implicit(spark, sf_dir):
    d = views.particles(spark, sf_dir).select("id", F.array("lon", "lat").alias("state"))
    return ode.solve_batches(d, "state", 0.1, 5, lambda y, t: y * [-1.0, -20.0], ode.GAUSS2)


@query()
def streamlines(spark, sf_dir):
    p = views.particles(spark, sf_dir).select("id", (F.col("lon") - 120).alias("x"), (F.col("lat") - 23).alias("y"))
    return ode.streamlines(p, 0.1, 5, lambda x, y: (-y, x))


@query("SELECT event_id, count(*) AS n, min(first_step) AS first_step FROM (SELECT id % 3 AS event_id, CAST(round(id % 3*12/2e0) AS INT) AS first_step FROM v_particle) GROUP BY 1", "v_particle")
def release_schedule(spark, sf_dir):
    s = views.particles(spark, sf_dir).select((F.col("id") % 3).alias("event_id"), (F.col("id") % 3 * 12).cast("double").alias("time_hours"), "lon", "lat")
    made = particles.release(s, 2.0)
    return made.groupBy(F.split("id", "-")[0].cast("long").alias("event_id")).agg(F.count("*").alias("n"), F.min("first_step").alias("first_step"))


@query(
    f"a AS (SELECT block, cell, avg(x) AS m0, coalesce(var_samp(x), 0e0) AS p FROM v_ensemble GROUP BY 1, 2), {OBS_BLOCK}, b AS (SELECT a.block, CASE WHEN y IS NULL THEN 0e0 ELSE p/(p + r)*(y - m0) END AS d FROM a LEFT JOIN ob ON ob.block = a.block AND ob.cell = a.cell) SELECT block, {r('sqrt(avg(d*d))')} AS change FROM b GROUP BY 1",
    "v_ensemble",
)
def observation_impact(spark, sf_dir):
    e = views.ensemble(spark, sf_dir)
    after = ensemble.mean_and_spread(ensemble.scalar_analysis(e, block_observations(spark, sf_dir))).select("block", "cell", F.col("mean").alias("m1"))
    d = ensemble.mean_and_spread(e).join(after, ["block", "cell"])
    return d.groupBy("block").agg(rounded(F.sqrt(F.avg((F.col("m1") - F.col("mean")) * (F.col("m1") - F.col("mean"))))).alias("change"))


@query(f"s AS (SELECT block, cell, coalesce(var_samp(x), 0e0) AS p FROM v_ensemble GROUP BY 1, 2) SELECT block, {r('greatest(1e0, least(2e0, 0.02e0/avg(p)))')} AS factor FROM s GROUP BY 1", "v_ensemble")
def adaptive_inflation(spark, sf_dir):
    s = ensemble.mean_and_spread(views.ensemble(spark, sf_dir)).groupBy("block").agg(F.avg("variance").alias("p"))
    return s.select("block", rounded(ensemble.adaptive_factor(F.lit(0.02), F.col("p"))).alias("factor"))


@query(
    f"g AS (SELECT *, (lead(c) OVER wx - lag(c) OVER wx)/2e0 AS gx FROM v_tracer WINDOW {WX}) SELECT time_idx, j, i, CASE WHEN abs(gx) > 0.05e0 THEN 2 ELSE 1 END AS level FROM g",
    "v_tracer",
)
def refine_by_gradient(spark, sf_dir):
    d = tracer(spark, sf_dir).withColumn("gx", stencil.derivative(F.col("c"), stencil.along_x(), 1.0, "null")).withColumn("level", F.lit(1))
    return grid.refine_by_gradient(d, "gx", 0.05, 3).select("time_idx", "j", "i", "level")


@query(
    f"s1 AS (SELECT *, coalesce(50e0*{lap('c')}, 0e0) AS k FROM v_tracer WINDOW {WX}, wy AS (PARTITION BY time_idx, depth_idx, i ORDER BY j)), s2 AS (SELECT time_idx, depth_idx, j, i, c, k AS k1, c + {DT}e0*k AS c1 FROM s1), "
    f"s3 AS (SELECT *, coalesce(50e0*{lap('c1')}, 0e0) AS k2 FROM s2 WINDOW {WX}, wy AS (PARTITION BY time_idx, depth_idx, i ORDER BY j)) SELECT time_idx, j, i, {r(f'c1 + {DT}e0*(1.5e0*k2 - 0.5e0*k1)', 9)} AS c FROM s3",
    "v_tracer",
)
def adams_bashforth(spark, sf_dir):
    d = transport.diffusion(tracer(spark, sf_dir), 50.0, D, D).select("time_idx", "depth_idx", "j", "i", F.col("diffusion").alias("k1"), (F.col("c") + DT * F.col("diffusion")).alias("c"))
    d = transport.diffusion(d, 50.0, D, D)
    return d.select("time_idx", "j", "i", rounded(F.col("c") + DT * (1.5 * F.col("diffusion") - 0.5 * F.col("k1")), 9).alias("c"))


@query(f"SELECT time_idx, j, i, {r('10*sin(radians(lon*18))*cos(radians(lat*18)) + 5*sin(time_idx*(2*pi()/365))')} AS sla FROM v_field", "v_field")
def sea_level_days(spark, sf_dir):
    """The analytic sea level at every cell and time of the field."""
    return generators.sea_level_over(views.field(spark, sf_dir)).select("time_idx", "j", "i", rounded(F.col("sla")).alias("sla"))


@query(f"SELECT id, step, {r('lon')} AS lon FROM (SELECT id, s AS step, lon + s*0.25e0 AS lon FROM v_particle, range(6) t(s)) WHERE step >= 3", "v_particle")
def trailing_positions(spark, sf_dir):
    t = views.particles(spark, sf_dir).select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("step"), "lon").withColumn("lon", F.col("lon") + F.col("step") * 0.25)
    return grid.last_n(t, ["id"], "step", 3).select("id", "step", rounded(F.col("lon")).alias("lon"))


QUARTER = math.pi / 2


@query(f"SELECT time_idx, j, i, {r(f'c*cos({QUARTER}e0*c)')} AS c FROM v_tracer", "v_tracer")
def reaction_term(spark, sf_dir):
    return tracer(spark, sf_dir).select("time_idx", "j", "i", rounded(F.col("c") * F.cos(QUARTER * F.col("c"))).alias("c"))
