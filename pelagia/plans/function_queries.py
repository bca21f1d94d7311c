"""Queries of functions that no other query reaches: coordinates, grids, surfaces, layers, paths, requests, state files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pelagia.functions import geo, ocean
from pelagia.lineage import shared_folder
from pelagia.operators import assimilation, grid, interp, ode, particles, series, transport
from pelagia.plans.catalogue import query, r
from pelagia.plans.field_queries import AXES, H, N, tracer
from pelagia.schema import rounded
from pelagia.sources import readers, sinks, views
from pelagia.streaming import cycles, events


def _rounded(*names: str, digits: int = 6) -> list:
    return [rounded(F.col(c), digits).alias(c) for c in names]


@query("SELECT id, (lon*1.5e0 BETWEEN -180 AND 180) AND (lat*4.1e0 BETWEEN -90 AND 90) AS valid FROM v_particle", "v_particle")
def coordinate_validity(spark, sf_dir):
    return views.particles(spark, sf_dir).select("id", geo.valid_coordinates(F.col("lon") * 1.5, F.col("lat") * 4.1).alias("valid"))


@query(
    "a AS (SELECT id, 1 + CAST(id % 9 AS DOUBLE) AS r, radians(lon) AS theta, radians(lat) AS phi FROM v_particle), c AS (SELECT id, r*sin(phi)*cos(theta) AS x, r*sin(phi)*sin(theta) AS y, r*cos(phi) AS z FROM a) "
    f"SELECT id, {r('x')} AS x, {r('y')} AS y, {r('z')} AS z, {r('sqrt(x*x + y*y + z*z)')} AS r, {r('atan2(y, x)')} AS theta, {r('acos(z/sqrt(x*x + y*y + z*z))')} AS phi FROM c",
    "v_particle",
)
def spherical_round_trip(spark, sf_dir):
    p = views.particles(spark, sf_dir).select("id", geo.spherical_to_cartesian(1 + (F.col("id") % 9).cast("double"), F.radians("lon"), F.radians("lat")).alias("c")).select("id", "c.*")
    back = p.withColumn("b", geo.cartesian_to_spherical(F.col("x"), F.col("y"), F.col("z"))).select("id", "x", "y", "z", "b.*")
    return back.select("id", *_rounded("x", "y", "z", "r", "theta", "phi"))


@query(f"SELECT id, greatest(0, least({N - 1}, CAST(round((lon - 118e0)/0.1e0) AS INT))) AS i, greatest(0, least({N - 1}, CAST(round((lat - 22e0)/0.1e0) AS INT))) AS j FROM v_particle", "v_particle")
def world_cells(spark, sf_dir):
    at = lambda c, lo: geo.world_to_grid(F.col(c), lo, 0.1, N)
    return views.particles(spark, sf_dir).select("id", at("lon", 118.0).alias("i"), at("lat", 22.0).alias("j"))


@query(f"SELECT time_idx, j, i, {r('(c*40 - 50 + 60)/(60 + c)')} AS sigma FROM v_tracer", "v_tracer")
def sigma_of_heights(spark, sf_dir):
    d = tracer(spark, sf_dir)
    return d.select("time_idx", "j", "i", rounded(grid.z_to_sigma(F.col("c") * 40 - 50, F.lit(60.0), F.col("c"))).alias("sigma"))


@query(f"SELECT time_idx, j, i, {r(f'(1025 + c)*{ocean.GRAVITY}*100 + (1025 + c)*{ocean.GRAVITY}*(c/10)', 3)} AS pressure FROM v_tracer", "v_tracer")
def hydrostatic(spark, sf_dir):
    made = ocean.hydrostatic_pressure(1025 + F.col("c"), F.col("c") / 10, 100.0)
    return tracer(spark, sf_dir).select("time_idx", "j", "i", rounded(made, 3).alias("pressure"))


@query(f"SELECT event_type AS key, {r('avg(value)', 3)} AS lowest FROM events WHERE value IS NOT NULL GROUP BY 1")
def least_squares_place(spark, sf_dir):
    """Where each type's sum of squared distances is least, by golden sections of it: its mean."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("value IS NOT NULL")
    sums = e.groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    search = F.udf(lambda n, s, lo, hi: ode.golden_section(lambda x: n * x * x - 2 * s * x, lo, hi, 1e-7 * max(1.0, hi - lo)), "double")
    return sums.select("key", rounded(search("n", "s", "lo", "hi"), 3).alias("lowest"))


@query(f"SELECT time_idx, j, i, CASE WHEN j = 3 AND i = 4 THEN 9e0 ELSE {r('c')} END AS c FROM v_tracer", "v_tracer")
def one_cell_set(spark, sf_dir):
    return grid.set_value(tracer(spark, sf_dir), "c", {"j": 3, "i": 4}, 9.0).select("time_idx", "j", "i", *_rounded("c"))


@query("SELECT time_idx, j, i, CASE WHEN abs(water_u) < 0.5e0 THEN greatest(i % 4 - 1, 0) ELSE i % 4 END AS level FROM v_field", "v_field")
def coarsened(spark, sf_dir):
    d = views.field(spark, sf_dir).withColumn("level", F.col("i") % 4)
    return grid.coarsen(d, "water_u", 0.5).select("time_idx", "j", "i", "level")


@query(
    "SELECT name, n, n_null FROM (SELECT 'time_idx' AS name, count(*) AS n, count(*) - count(time_idx) AS n_null FROM v_field UNION ALL SELECT 'lat', count(*), count(*) - count(lat) FROM v_field UNION ALL SELECT 'water_u', count(*), count(*) - count(water_u) FROM v_field UNION ALL SELECT 'water_v', count(*), count(*) - count(water_v) FROM v_field)",
    "v_field",
)
def column_report(spark, sf_dir):
    return readers.describe_columns(views.field(spark, sf_dir)).where("name IN ('time_idx', 'lat', 'water_u', 'water_v')").select("name", "n", "n_null")


@query("SELECT CAST(d AS DATE) AS day, count(o_orderkey) AS n FROM (SELECT unnest(generate_series(CAST(min(o_orderdate) AS TIMESTAMP), CAST(max(o_orderdate) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM orders) LEFT JOIN orders ON CAST(o_orderdate AS DATE) = CAST(d AS DATE) GROUP BY 1")
def orders_by_day(spark, sf_dir):
    """Every day from the first order to the last, with its orders."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("day"), "o_orderkey")
    ends = o.agg(F.min("day").cast("string").alias("lo"), F.max("day").cast("string").alias("hi")).first()
    return readers.date_range(spark, ends["lo"], ends["hi"]).join(o, "day", "left").groupBy("day").agg(F.count("o_orderkey").alias("n"))


@query(f"SELECT id, {r('1 + 2.1e0*(lon - 120) - 0.53e0*(lat - 23)*(lat - 23) + 0.271e0*(lon - 120)*(lat - 23) + 0.00000123e0', 5)} AS z FROM v_particle", "v_particle")
def fitted_surface(spark, sf_dir):
    """A quadratic surface over all particles, fitted to its own values and given back."""
    x, y = F.col("lon") - 120.0, F.col("lat") - 23.0
    p = views.particles(spark, sf_dir).select("id", x.alias("x"), y.alias("y"), (1 + 2.1 * x - 0.53 * y * y + 0.271 * x * y + 0.00000123).alias("z"))
    powers, coefficients = series.polynomial_surface(p)
    return p.select("id", rounded(series.surface_value(powers, coefficients, F.col("x"), F.col("y")), 5).alias("z"))


@query(
    f"l AS (SELECT time_idx, CAST(k AS INT) AS depth_idx, j, i, c*(k + 1) AS c FROM v_tracer, range(3) t(k)), o AS (SELECT *, lead(c) OVER wx AS c10 FROM l WINDOW wx AS (PARTITION BY time_idx, depth_idx, j ORDER BY i)), "
    "q AS (SELECT time_idx, depth_idx, j, i, c AS c00, c10, lead(c) OVER wy AS c01, lead(c10) OVER wy AS c11 FROM o WINDOW wy AS (PARTITION BY time_idx, depth_idx, i ORDER BY j)), "
    f"p AS (SELECT id, t.time_idx, lon, lat, CAST(id % 30 AS DOUBLE) AS depth, least(CAST(floor((lon - 118e0)/{H}e0) AS INT), {N - 2}) AS i, least(CAST(floor((lat - 21e0)/{H}e0) AS INT), {N - 2}) AS j, CASE WHEN id % 30 < 10 THEN 0 ELSE 1 END AS k FROM v_particle, (SELECT DISTINCT time_idx FROM v_field) t), "
    f"w AS (SELECT *, (lon - 118e0)/{H}e0 - i AS fx, (lat - 21e0)/{H}e0 - j AS fy, CASE k WHEN 0 THEN depth/10 ELSE (depth - 10)/20 END AS fz FROM p) "
    f"SELECT id, w.time_idx, {r('(a.c00*(1-fx)*(1-fy) + a.c10*fx*(1-fy) + a.c01*(1-fx)*fy + a.c11*fx*fy)*(1 - fz) + (b.c00*(1-fx)*(1-fy) + b.c10*fx*(1-fy) + b.c01*(1-fx)*fy + b.c11*fx*fy)*fz')} AS c "
    "FROM w JOIN q a ON a.time_idx = w.time_idx AND a.depth_idx = k AND a.j = w.j AND a.i = w.i JOIN q b ON b.time_idx = w.time_idx AND b.depth_idx = k + 1 AND b.j = w.j AND b.i = w.i",
    "v_tracer",
    "v_particle",
)
def trilinear_gather(spark, sf_dir):
    """The tracer of three layers at every particle's place and depth at every time."""
    t = tracer(spark, sf_dir).withColumn("depth_idx", F.explode(F.array(*map(F.lit, range(3))))).withColumn("c", F.col("c") * (F.col("depth_idx") + 1))
    p = views.particles(spark, sf_dir).withColumn("depth", (F.col("id") % 30).cast("double")).join(F.broadcast(t.select("time_idx").distinct()))
    return interp.between_layers(t, p, ["c"], AXES, [0.0, 10.0, 30.0]).select("id", "time_idx", *_rounded("c"))


@query(
    "WITH t AS (SELECT event_type AS key, epoch_us(CAST(ts AS TIMESTAMP))/1e6 AS x FROM events WHERE event_id % 10 = 0), p AS (SELECT event_type AS key, epoch_us(CAST(ts AS TIMESTAMP))/1e6 AS x, avg(value) AS value FROM events WHERE event_id % 10 <> 0 AND value IS NOT NULL GROUP BY 1, 2), "
    "lo AS (SELECT t.key, t.x, p.x AS x0, p.value AS v0 FROM t ASOF LEFT JOIN p ON t.key = p.key AND t.x >= p.x), b AS (SELECT lo.*, p.x AS x1, p.value AS v1 FROM lo ASOF LEFT JOIN p ON lo.key = p.key AND lo.x <= p.x) "
    f"SELECT key, {r('x', 3)} AS x, {r('CASE WHEN x0 = x1 THEN v0 ELSE v0 + (v1 - v0)*(x - x0)/(x1 - x0) END', 4)} AS value FROM b",
)
def bracketed_events(spark, sf_dir):
    """Every tenth event's value, read off the events of its type around it in time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("key"), "ts", "event_id", "value")
    known = e.where("event_id % 10 <> 0").groupBy("key", "ts").agg(F.avg("value").alias("value"))
    made = series.bracket_time(known, e.where("event_id % 10 = 0").select("key", "ts"))
    return made.select("key", rounded(F.col("x"), 3).alias("x"), rounded(F.col("value"), 4).alias("value"))


@query("SELECT count(*) AS n, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS n_wet, count(*) AS n_places FROM (SELECT j, i, bool_or(water_u IS NOT NULL AND water_v IS NOT NULL) AS ok FROM v_field GROUP BY 1, 2) WHERE ok", "v_field")
def sampled_wet_cells(spark, sf_dir):
    """A sample as large as there are wet cells holds each of them once."""
    f = views.field(spark, sf_dir)
    s = particles.sample_wet(f, N * N)
    wet = f.where("water_u IS NOT NULL AND water_v IS NOT NULL").select("j", "i", F.lit(1).alias("ok")).distinct()
    return s.join(wet, ["j", "i"], "left").agg(F.count("*").alias("n"), F.sum("ok").alias("n_wet"), F.countDistinct("j", "i").alias("n_places"))


@query("SELECT c_custkey AS id, 4 AS n_points, true AS starts_there FROM customer")
def json_paths(spark, sf_dir):
    """Each particle's path of four steps as JSON, parsed again."""
    p = views.particles(spark, sf_dir)
    t = p.select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("step"), "lon", "lat").withColumn("lon", F.col("lon") + F.col("step") * 0.25)
    back = sinks.track_paths(t).select(F.from_json("value", "id LONG, path ARRAY<ARRAY<DOUBLE>>").alias("v")).select("v.*").join(p, "id")
    return back.select("id", F.size("path").alias("n_points"), ((F.col("path")[0][0] == F.col("lon")) & (F.col("path")[3][1] == F.col("lat"))).alias("starts_there"))


@query("SELECT 'run_' || (o_orderkey % 3) AS action, count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_lacking FROM orders GROUP BY 1")
def parsed_requests(spark, sf_dir):
    """JSON requests made of all orders, by action, and how many lack a parameter."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    given = F.when(F.col("o_orderkey") % 2 == 1, F.lit("dt"))
    text = F.to_json(F.struct(F.concat(F.lit("run_"), (F.col("o_orderkey") % 3).cast("string")).alias("action"), F.map_from_arrays(F.array(F.coalesce(given, F.lit("other"))), F.array(F.lit("1"))).alias("parameters")))
    parsed = readers.requests(o.select(text.alias("value")))
    lacks = F.size(readers.required(F.col("parameters"), "dt")) > 0
    return parsed.groupBy("action").agg(F.count("*").alias("n"), F.sum(lacks.cast("int")).alias("n_lacking"))


@query(f"SELECT block, count(*) AS n, {r('sum(x)', 4)} AS total FROM v_ensemble GROUP BY 1", "v_ensemble")
def saved_state(spark, sf_dir):
    """The ensemble saved as a state, loaded again and summed by block."""
    path = f"{shared_folder(spark)}/states/{uuid.uuid4().hex}"
    assimilation.save_state(views.ensemble(spark, sf_dir), assimilation.Settings(), 3, path)
    return assimilation.load_state(spark, path)[0].groupBy("block").agg(F.count("*").alias("n"), rounded(F.sum("x"), 4).alias("total"))


@query(f"SELECT time_idx, {r('max(abs(c - m))', 3)} AS off FROM (SELECT time_idx, 0e0 AS c, 0e0 AS m FROM v_field) GROUP BY 1", "v_field")
def relaxed_to_mean(spark, sf_dir):
    """Every slab relaxed to its mean until it stands still: nothing is left of the differences."""
    from pyspark.sql import Window

    w = Window.partitionBy("time_idx", "depth_idx")
    made, _ = transport.steady_state(tracer(spark, sf_dir), lambda d: d.withColumn("c", F.col("c") + 0.9 * (F.avg("c").over(w) - F.col("c"))), 1e-6)
    return made.withColumn("m", F.avg("c").over(w)).groupBy("time_idx").agg(rounded(F.max(F.abs(F.col("c") - F.col("m"))), 3).alias("off"))


@query("SELECT time_idx, j, i, lat, lon, water_u, water_v FROM v_field", "v_field")
def json_round_trip(spark, sf_dir):
    """The field as JSON texts, read again: numbers keep all their digits and nulls stay null."""
    f = views.field(spark, sf_dir).select("time_idx", "j", "i", "lat", "lon", "water_u", "water_v")
    schema = ", ".join(f"{c} {t}" for c, t in f.dtypes)
    return sinks.json_rows(f).select(F.from_json("value", schema).alias("v")).select("v.*")


@query(
    f"SELECT time_idx, j, i, {r('lon')} AS lon0, {r('lat')} AS lat0, {r('lon + water_u')} AS lon1, {r('lat + water_v')} AS lat1, {r('sqrt(water_u*water_u + water_v*water_v)')} AS speed, {r('degrees(atan2(water_v, water_u))')} AS direction FROM v_field WHERE i % 5 = 0 AND j % 5 = 0 AND water_u IS NOT NULL AND water_v IS NOT NULL",
    "v_field",
)
def geojson_round_trip(spark, sf_dir):
    """The vector lines as GeoJSON texts, read again: both ends, the speed and the direction."""
    feature = "type STRING, geometry STRUCT<type: STRING, coordinates: ARRAY<ARRAY<DOUBLE>>>, properties STRUCT<speed: DOUBLE, direction: DOUBLE>"
    d = sinks.vector_lines(views.field(spark, sf_dir), 5).withColumn("v", F.from_json("value", feature)).where("v.type = 'Feature' AND v.geometry.type = 'LineString'")
    at = lambda k, m: rounded(F.col("v.geometry.coordinates")[k][m])
    return d.select("time_idx", "j", "i", at(0, 0).alias("lon0"), at(0, 1).alias("lat0"), at(1, 0).alias("lon1"), at(1, 1).alias("lat1"), rounded(F.col("v.properties.speed")).alias("speed"), rounded(F.col("v.properties.direction")).alias("direction"))


# what streams do, on whole tables


@query(
    f"SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP))) AS BIGINT) AS start, event_type AS key, count(value) AS n, {r('avg(value)')} AS mean, {r('coalesce(stddev_pop(value), 0e0)')} AS std, min(value) AS min, max(value) AS max FROM events GROUP BY 1, 2"
)
def windowed_events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.col("event_type").alias("key"), "value")
    made = events.windowed_statistics(e)
    return made.select(F.col("start").cast("timestamp").cast("long").alias("start"), "key", "n", rounded(F.col("mean")).alias("mean"), rounded(F.coalesce("std", F.lit(0.0))).alias("std"), "min", "max")


@query("SELECT CAST(CASE WHEN value IS NULL THEN 3 WHEN value NOT BETWEEN 5 AND 80 THEN 2 ELSE 0 END AS INT) AS flag, count(*) AS n FROM v_series GROUP BY 1", "v_series")
def flags_on_arrival(spark, sf_dir):
    return events.flagged(views.series(spark, sf_dir), (5, 80)).groupBy("flag").agg(F.count("*").alias("n"))


@query(
    "e AS (SELECT event_type AS key, date_trunc('day', CAST(ts AS TIMESTAMP)) AS day, value, event_id FROM events), f AS (SELECT key, day, row_number() OVER (PARTITION BY key ORDER BY day) AS n FROM (SELECT DISTINCT key, day FROM e)), "
    "o AS (SELECT key, day, sum(1/0.5e0) AS p, sum((value/10)/0.5e0) AS q, count(*) AS n_obs FROM e WHERE value IS NOT NULL AND event_id % 3 = 0 GROUP BY 1, 2), "
    "c AS (SELECT f.key, f.day, f.n, coalesce(p, 0e0) AS p, coalesce(q, 0e0) AS q, coalesce(n_obs, 0) AS n_obs FROM f LEFT JOIN o ON o.key = f.key AND o.day = f.day), "
    "z AS (SELECT key, day, n, n_obs, 0.1e0 AS forecast, (0.1e0/1.2e0 + q)/(1/1.2e0 + p) AS analysis, 1/(1/1.2e0 + p) AS variance FROM c WHERE n = 1 UNION ALL "
    "SELECT c.key, c.day, c.n, c.n_obs, z.analysis + 0.1e0, ((z.analysis + 0.1e0)/(z.variance + 0.2e0) + c.q)/(1/(z.variance + 0.2e0) + c.p), 1/(1/(z.variance + 0.2e0) + c.p) FROM z JOIN c ON c.key = z.key AND c.n = z.n + 1) "
    f"SELECT key, CAST(epoch(day) AS BIGINT) AS cycle, {r('forecast')} AS forecast, {r('analysis')} AS analysis, {r('variance')} AS variance, n_obs FROM z",
    "v_series",
)
def analysed_cycles(spark, sf_dir):
    """Daily cycles of each event type: a forecast a day, and every third event as an observation."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")
    forecasts = e.select("key", F.date_trunc("day", "ts").alias("ts")).distinct().withColumns({"drift": F.lit(0.1), "noise": F.lit(0.2)})
    observations = e.where("value IS NOT NULL AND event_id % 3 = 0").select("key", "ts", (F.col("value") / 10).alias("y"), F.lit(0.5).alias("r"))
    made = cycles.in_batch(cycles.joined(forecasts, observations, "1 DAY", "1 hour"))
    return made.select("key", F.col("cycle").cast("long").alias("cycle"), *_rounded("forecast", "analysis", "variance"), "n_obs")
