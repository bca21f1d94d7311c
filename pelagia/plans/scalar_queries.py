"""Queries of scalar functions: projections, distances, ocean physics, limiters, array algebra, text outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.functions import geo, mathx, ocean
from pelagia.operators import qc
from pelagia.plans.catalogue import query, r
from pelagia.schema import rounded
from pelagia.sources import sinks, views

A, B = "6378137e0", "6356752.314245e0"
FL = f"(({A} - {B})/{A})"
E2 = f"(2*{FL} - {FL}*{FL})"
NR = f"({A}/sqrt(1 - {E2}*sin(radians(lat))*sin(radians(lat))))"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.particles(spark, sf_dir)


def parts(d: DataFrame, s, digits: int = 6, **names: str) -> DataFrame:
    """id and the rounded parts of a struct."""
    return d.select("id", *(rounded(s[field], digits).alias(out) for out, field in names.items()))


@query(f"SELECT id, {r(f'{A}*radians(lon)', 4)} AS x, {r(f'{A}*ln(tan(pi()/4 + radians(lat)/2))', 4)} AS y FROM v_particle", "v_particle")
def mercator(spark, sf_dir):
    return parts(points(spark, sf_dir), geo.mercator(F.col("lon"), F.col("lat")), 4, x="x", y="y")


@query(f"SELECT id, {r('lon')} AS lon, {r('lat')} AS lat FROM v_particle", "v_particle")
def mercator_round_trip(spark, sf_dir):
    xy = geo.mercator(F.col("lon"), F.col("lat"), 110.0, 500.0, 700.0)
    return parts(points(spark, sf_dir), geo.inverse_mercator(xy["x"], xy["y"], 110.0, 500.0, 700.0), lon="lon", lat="lat")


@query(
    f"n AS (SELECT id, {NR} AS n, radians(lon) AS l, radians(lat) AS p FROM v_particle) SELECT id, {r('n*cos(p)*cos(l)', 4)} AS x, {r('n*cos(p)*sin(l)', 4)} AS y, {r(f'n*(1 - {E2})*sin(p)', 4)} AS z FROM n",
    "v_particle",
)
def ecef(spark, sf_dir):
    return parts(points(spark, sf_dir), geo.geographic_to_cartesian(F.col("lon"), F.col("lat")), 4, x="x", y="y", z="z")


@query(f"SELECT id, {r('lon')} AS lon, {r('lat')} AS lat FROM v_particle", "v_particle")
def ecef_round_trip(spark, sf_dir):
    c = geo.geographic_to_cartesian(F.col("lon"), F.col("lat"))
    return parts(points(spark, sf_dir), geo.cartesian_to_geographic(c["x"], c["y"], c["z"]), lon="lon", lat="lat")


@query(
    f"k AS (SELECT id, 2*{A}/(1 + sin(radians(lat))) AS k, radians(lon) AS l, radians(lat) AS p FROM v_particle) SELECT id, {r('k*cos(p)*sin(l)', 4)} AS x, {r('-k*cos(p)*cos(l)', 4)} AS y FROM k",
    "v_particle",
)
def stereographic_polar(spark, sf_dir):
    return parts(points(spark, sf_dir), geo.stereographic(F.col("lon"), F.col("lat")), 4, x="x", y="y")


@query(
    f"q AS (SELECT id, radians(lon - 120) AS l, radians(lat) AS p, sin(radians(23e0)) AS s0, cos(radians(23e0)) AS c0 FROM v_particle), k AS (SELECT *, 2*{A}/(1 + s0*sin(p) + c0*cos(p)*cos(l)) AS k FROM q) SELECT id, {r('k*cos(p)*sin(l)', 4)} AS x, {r('k*(c0*sin(p) - s0*cos(p)*cos(l))', 4)} AS y FROM k",
    "v_particle",
)
def stereographic_oblique(spark, sf_dir):
    return parts(points(spark, sf_dir), geo.stereographic(F.col("lon"), F.col("lat"), 120.0, 23.0), 4, x="x", y="y")


@query(
    f"b AS (SELECT id, lon, lat, radians(lat) AS p, CAST(floor((lon + 180)/6) + 1 AS INT) AS zone, {E2} AS e2, {NR} AS n FROM v_particle), "
    "c AS (SELECT *, tan(p)*tan(p) AS t, e2*cos(p)*cos(p)/(1 - e2) AS c, cos(p)*radians(lon - ((zone - 1)*6 - 177)) AS a, "
    f"{A}*((1 - e2/4 - 3*e2*e2/64 - 5*e2*e2*e2/256)*p - 3*(e2 + e2*e2/4 + 15*e2*e2*e2/128)/8*sin(2*p) + 15*(e2*e2 + 3*e2*e2*e2/4)/256*sin(4*p) - 35*e2*e2*e2/3072*sin(6*p)) AS m FROM b) "
    f"SELECT id, {r('0.9996e0*n*(a + (1 - t + c)*a*a*a/6 + (5 - 18*t + t*t + 72*c - 58*e2)*a*a*a*a*a/120) + 500000e0', 3)} AS x, "
    f"{r('0.9996e0*(m + n*tan(p)*(a*a/2 + (5 - t + 9*c + 4*c*c)*a*a*a*a/24 + (61 - 58*t + t*t + 600*c - 330*e2)*a*a*a*a*a*a/720))', 3)} AS y, zone, 'N' AS hemisphere FROM c",
    "v_particle",
)
def utm(spark, sf_dir):
    s = geo.utm(F.col("lon"), F.col("lat"))
    return points(spark, sf_dir).select("id", rounded(s["x"], 3).alias("x"), rounded(s["y"], 3).alias("y"), s["zone"].alias("zone"), s["hemisphere"].alias("hemisphere"))


HAV = "sin((radians(23e0) - radians(lat))/2)*sin((radians(23e0) - radians(lat))/2) + cos(radians(lat))*cos(radians(23e0))*sin(radians(120e0 - lon)/2)*sin(radians(120e0 - lon)/2)"


@query(f"h AS (SELECT id, {HAV} AS a FROM v_particle) SELECT id, {r('2*6371000e0*atan2(sqrt(a), sqrt(1 - a))', 3)} AS metres FROM h", "v_particle")
def haversine(spark, sf_dir):
    return points(spark, sf_dir).select("id", rounded(geo.haversine(F.col("lon"), F.col("lat"), F.lit(120.0), F.lit(23.0)), 3).alias("metres"))


@query(
    f"b AS (SELECT id, degrees(atan2(sin(radians(120e0 - lon))*cos(radians(23e0)), cos(radians(lat))*sin(radians(23e0)) - sin(radians(lat))*cos(radians(23e0))*cos(radians(120e0 - lon)))) AS d FROM v_particle) SELECT id, {r('CASE WHEN d < 0 THEN d + 360 ELSE d END')} AS bearing FROM b",
    "v_particle",
)
def bearing(spark, sf_dir):
    return points(spark, sf_dir).select("id", rounded(geo.bearing(F.col("lon"), F.col("lat"), F.lit(120.0), F.lit(23.0))).alias("bearing"))


@query(f"SELECT id, {r('sqrt((23e0 - lat)*111.32e0*(23e0 - lat)*111.32e0 + (120e0 - lon)*111.32e0*cos(radians(lat))*(120e0 - lon)*111.32e0*cos(radians(lat)))')} AS km FROM v_particle", "v_particle")
def planar_distance(spark, sf_dir):
    return points(spark, sf_dir).select("id", rounded(geo.planar_km(F.col("lon"), F.col("lat"), F.lit(120.0), F.lit(23.0))).alias("km"))


@query(
    f"l AS (SELECT id, (lon - 118)*111320e0*cos(radians(21e0)) AS x, (lat - 21)*111320e0 AS y FROM v_particle), t AS (SELECT id, x*cos(radians(-30e0)) - y*sin(radians(-30e0)) AS x, x*sin(radians(-30e0)) + y*cos(radians(-30e0)) AS y FROM l) SELECT id, CAST(round_even(x/1000e0, 0) AS BIGINT) AS gx, CAST(round_even(y/1000e0, 0) AS BIGINT) AS gy FROM t",
    "v_particle",
)
def grid_index(spark, sf_dir):
    g = geo.geographic_to_grid(F.col("lon"), F.col("lat"), 118.0, 21.0, 1000.0, 1000.0, 30.0)
    return points(spark, sf_dir).select("id", g["gx"].alias("gx"), g["gy"].alias("gy"))


@query("SELECT id, id % 40 AS gx, id % 23 AS gy FROM v_particle", "v_particle")
def grid_round_trip(spark, sf_dir):
    d = points(spark, sf_dir).select("id", (F.col("id") % 40).alias("gx"), (F.col("id") % 23).alias("gy"))
    ll = geo.grid_to_geographic(F.col("gx"), F.col("gy"), 118.0, 21.0, 500.0, 500.0, 20.0)
    g = geo.geographic_to_grid(ll["lon"], ll["lat"], 118.0, 21.0, 500.0, 500.0, 20.0)
    return d.select("id", g["gx"].alias("gx"), g["gy"].alias("gy"))


@query(
    f"q AS (SELECT id, radians(lat) AS p, radians(lon) AS l, radians(CAST(id % 360 AS DOUBLE)) AS b, 50000e0/6371000e0 AS d FROM v_particle), s AS (SELECT *, asin(sin(p)*cos(d) + cos(p)*sin(d)*cos(b)) AS p2 FROM q) SELECT id, {r('degrees(l + atan2(sin(b)*sin(d)*cos(p), cos(d) - sin(p)*sin(p2)))')} AS lon, {r('degrees(p2)')} AS lat FROM s",
    "v_particle",
)
def destination(spark, sf_dir):
    return parts(points(spark, sf_dir), geo.destination(F.col("lon"), F.col("lat"), (F.col("id") % 360).cast("double"), F.lit(50000.0)), lon="lon", lat="lat")


@query(f"SELECT id, {r('lon')} AS x, {r('lat')} AS y FROM v_particle", "v_particle")
def transform_chain(spark, sf_dir):
    return parts(points(spark, sf_dir), geo.transform_chain(["WGS84", "MERCATOR", "WGS84"], F.col("lon"), F.col("lat")), x="x", y="y")


@query("SELECT id, CASE WHEN lon > 119 AND lon < 121 AND lat > 22 AND lat < 24 THEN true ELSE false END AS inside FROM v_particle WHERE lon NOT IN (119, 121) AND lat NOT IN (22, 24)", "v_particle")
def in_polygon(spark, sf_dir):
    ring = [(119.0, 22.0), (121.0, 22.0), (121.0, 24.0), (119.0, 24.0)]
    return points(spark, sf_dir).where("lon NOT IN (119, 121) AND lat NOT IN (22, 24)").select("id", geo.in_ring(F.col("lon"), F.col("lat"), ring).alias("inside"))


# ocean


@query(f"SELECT id, {r('2*7.2921159e-5*sin(radians(lat))', 12)} AS f FROM v_particle", "v_particle")
def coriolis(spark, sf_dir):
    return points(spark, sf_dir).select("id", rounded(ocean.coriolis(F.col("lat")), 12).alias("f"))


STATE = "st AS (SELECT c_custkey AS id, CAST(c_custkey % 300 AS DOUBLE)/10e0 AS t, 30e0 + CAST(c_custkey % 80 AS DOUBLE)/10e0 AS s, CAST(c_custkey % 100 AS DOUBLE)*100000e0 AS p FROM customer)"


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"))
    k = lambda n: (F.col("id") % n).cast("double")
    return c.select("id", (k(300) / 10.0).alias("t"), (30.0 + k(80) / 10.0).alias("s"), (k(100) * 100000.0).alias("p"))


SURFACE = (
    "(999.842594e0 + 6.793952e-2*t - 9.095290e-3*t*t + 1.001685e-4*t*t*t - 1.120083e-6*t*t*t*t + 6.536332e-9*t*t*t*t*t + (8.24493e-1 - 4.0899e-3*t + 7.6438e-5*t*t - 8.2467e-7*t*t*t + 5.3875e-9*t*t*t*t)*s"
    " + (-5.72466e-3 + 1.0227e-4*t - 1.6546e-6*t*t)*s*sqrt(s) + 4.8314e-4*s*s)"
)
BULK4 = "19652.21e0 + 148.4206e0*t - 2.327105e0*t*t + 1.360477e-2*t*t*t"


@query(
    f"WITH {STATE} SELECT id, {r(f'{SURFACE}/(1 - p/10000e0/({BULK4} - 5.155288e-5*t*t*t*t + s*(54.6746e0 - 0.603459e0*t + 1.09987e-2*t*t - 6.1670e-5*t*t*t) + s*sqrt(s)*(7.944e-2 + 1.6483e-2*t - 5.3009e-4*t*t)))')} AS density_a, "
    f"{r(f'{SURFACE}*(1 + p*1e-5/({BULK4} + s*(54.6746e0 - 0.603459e0*t + 1.09987e-2*t*t)))')} AS density_b FROM st"
)
def seawater_density(spark, sf_dir):
    t, s, p = F.col("t"), F.col("s"), F.col("p")
    return states(spark, sf_dir).select("id", rounded(ocean.density_a(t, s, p)).alias("density_a"), rounded(ocean.density_b(t, s, p)).alias("density_b"))


@query(f"SELECT id, {r('9.81e0*((lon - 120)*1e-5)/(2*7.2921159e-5*sin(radians(lat)))')} AS velocity FROM v_particle", "v_particle")
def geostrophic(spark, sf_dir):
    return points(spark, sf_dir).select("id", rounded(ocean.geostrophic((F.col("lon") - 120) * 1e-5, F.col("lat"))).alias("velocity"))


@query(
    f"d AS (SELECT id, abs(lon - 120)*2 AS x FROM v_particle) SELECT id, {r('CASE WHEN x <= 1 THEN -0.25e0*x*x*x*x*x + 0.5e0*x*x*x*x + 0.625e0*x*x*x - 5e0/3*x*x + 1 WHEN x <= 2 THEN x*x*x*x*x/12 - 0.5e0*x*x*x*x + 0.625e0*x*x*x + 5e0/3*x*x - 5*x + 4 - 2/(3*x) ELSE 0e0 END')} AS weight FROM d",
    "v_particle",
)
def gaspari_cohn(spark, sf_dir):
    return points(spark, sf_dir).select("id", rounded(ocean.gaspari_cohn(F.abs(F.col("lon") - 120) * 2)).alias("weight"))


@query(f"WITH {STATE} SELECT id, greatest(-2e0, least(35e0, t - 5)) AS temperature, t - 5 BETWEEN -2 AND 35 AND s BETWEEN 0 AND 45 AND (id % 7) <= 5 AS valid FROM st")
def physical_limits(spark, sf_dir):
    t = F.col("t") - 5
    zero = F.lit(0.0)
    return states(spark, sf_dir).select("id", ocean.constrained("temperature", t).alias("temperature"), ocean.physically_valid(t, F.col("s"), zero, zero, (F.col("id") % 7).cast("double")).alias("valid"))


# numerics


@query(
    f"x AS (SELECT id, (lon - 120)*1.5e0 AS r FROM v_particle) SELECT id, {r('greatest(0e0, least(1e0, r))')} AS minmod, {r('greatest(0e0, least(2*r, 1e0), least(r, 2e0))')} AS superbee, {r('CASE WHEN r <= 0 THEN 0e0 ELSE 2*r/(1 + r) END')} AS van_leer FROM x",
    "v_particle",
)
def flux_limiters(spark, sf_dir):
    x = (F.col("lon") - 120) * 1.5
    return points(spark, sf_dir).select("id", *(rounded(f(x)).alias(n) for n, f in mathx.LIMITERS.items()))


BETA = {
    "b0": "13e0/12*(a - 2*b + c)*(a - 2*b + c) + (a - 4*b + 3*c)*(a - 4*b + 3*c)/4",
    "b1": "13e0/12*(b - 2*c + d)*(b - 2*c + d) + (b - d)*(b - d)/4",
    "b2": "13e0/12*(c - 2*d + e)*(c - 2*d + e) + (3*c - 4*d + e)*(3*c - 4*d + e)/4",
}


@query(
    "v AS (SELECT id, lon - 120 AS a, lat - 23 AS b, (lon - 120)*(lat - 23) AS c, 0.5e0*(lat - 23) AS d, 0.25e0*(lon - 120) AS e FROM v_particle), "
    f"s AS (SELECT *, {', '.join(f'{q} AS {k}' for k, q in BETA.items())} FROM v), w AS (SELECT *, 0.1e0/((b0 + 1e-6)*(b0 + 1e-6)) AS w0, 0.6e0/((b1 + 1e-6)*(b1 + 1e-6)) AS w1, 0.3e0/((b2 + 1e-6)*(b2 + 1e-6)) AS w2 FROM s) "
    f"SELECT id, {r('(w0*(2*a - 7*b + 11*c)/6 + w1*(5*c - b + 2*d)/6 + w2*(2*c + 5*d - e)/6)/(w0 + w1 + w2)')} AS face FROM w",
    "v_particle",
)
def weno_face(spark, sf_dir):
    a, b = F.col("lon") - 120, F.col("lat") - 23
    return points(spark, sf_dir).select("id", rounded(mathx.weno5(a, b, a * b, 0.5 * b, 0.25 * a)).alias("face"))


@query(f"SELECT vec_id, {r('list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])', 5)} AS dot, {r('sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))', 5)} AS norm FROM embeddings")
def array_algebra(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    half = mathx.elementwise("subtract", mathx.scaled(v, 3.0), mathx.scaled(v, 2.0))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", rounded(mathx.dot(v, half), 5).alias("dot"), rounded(mathx.norm(v), 5).alias("norm"))


@query(f"SELECT id, {r('CASE WHEN abs(lon - 120) < 1e-15 THEN -1e0 ELSE lat/(lon - 120) END')} AS ratio, {r('sqrt(greatest(0e0, lon - 120))')} AS root, abs(lon - 120) < 0.5e0 AS near FROM v_particle", "v_particle")
def safe_arithmetic(spark, sf_dir):
    x = F.col("lon") - 120
    return points(spark, sf_dir).select("id", rounded(mathx.safe_divide(F.col("lat"), x, -1.0)).alias("ratio"), rounded(mathx.safe_sqrt(x)).alias("root"), mathx.nearly_equal(F.col("lon"), F.lit(120.0), 0.5).alias("near"))


@query("SELECT id, CAST(id % 500 // 24 AS VARCHAR) || ' days ' || CAST(id % 500 % 24 AS VARCHAR) || ' hours' AS duration, substr(md5('interp|' || CAST(id AS VARCHAR)), 1, 16) AS cache_key FROM v_particle", "v_particle")
def text_functions(spark, sf_dir):
    return points(spark, sf_dir).select("id", mathx.hours_text((F.col("id") % 500).cast("double")).alias("duration"), mathx.cache_key(F.lit("interp"), F.col("id").cast("string")).alias("cache_key"))


KINDS = [("water_temp", "", "temperature"), ("pres", "dbar", "pressure"), ("water_u", "m/s", "u_velocity"), ("ssh", "m", "ssh"), ("salinity", "", "salinity"), ("q1", "degrees_Celsius", "temperature"), ("q2", "m/s", "speed"), ("color", "", "unknown")]


@query(f"SELECT kind, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN (VALUES {', '.join(f'({k}, {chr(39)}{kind}{chr(39)})' for k, (_, _, kind) in enumerate(KINDS))}) t(k, kind) ON l_orderkey % {len(KINDS)} = k GROUP BY 1")
def variable_kinds(spark, sf_dir):
    """Lines by the kind of a variable whose name and units follow from their order."""
    pick = lambda m: F.element_at(F.array(*(F.lit(x[m]) for x in KINDS)), (F.col("l_orderkey") % len(KINDS) + 1).cast("int"))
    named = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(pick(0).alias("name"), pick(1).alias("units"), "l_quantity")
    return named.groupBy(qc.variable_kind(F.col("name"), F.col("units")).alias("kind")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


VARIABLES = "SELECT 'temperature' AS name, lat*3 - 20 AS value FROM v_field UNION ALL SELECT 'salinity', lon*0.5e0 - 9 FROM v_field UNION ALL SELECT 'water_u', water_u*4 FROM v_field UNION ALL SELECT 'w', water_v FROM v_field UNION ALL SELECT 'ssh', water_u*3.5e0 FROM v_field UNION ALL SELECT 'pres', lat*50 FROM v_field"


@query(
    f"d AS ({VARIABLES}), k AS (SELECT d.*, lo, hi FROM d JOIN (VALUES ('temperature', -5e0, 50e0), ('salinity', 0e0, 50e0), ('water_u', -3e0, 3e0), ('w', -0.5e0, 0.5e0), ('ssh', -3e0, 3e0), ('pres', 0e0, 1100e0)) t(name, lo, hi) ON t.name = d.name) "
    "SELECT name, CAST(CASE WHEN value IS NULL THEN 3 WHEN value < lo OR value > hi THEN 2 ELSE 0 END AS INT) AS flag, count(*) AS n FROM k GROUP BY 1, 2",
    "v_field",
)
def qc_limits(spark, sf_dir):
    d = views.field(spark, sf_dir)
    made = {"temperature": F.col("lat") * 3 - 20, "salinity": F.col("lon") * 0.5 - 9, "water_u": F.col("water_u") * 4, "w": F.col("water_v"), "ssh": F.col("water_u") * 3.5, "pres": F.col("lat") * 50}
    rows = d.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), c.alias("value")) for n, c in made.items()))).alias("x")).select("x.*")
    return qc.limit_flags(rows).groupBy("name", "flag").agg(F.count("*").alias("n"))


# text outputs


@query(
    "SELECT time_idx, j, string_agg(coalesce(printf('%.6f', water_u), ''), ',' ORDER BY i) AS value FROM v_field GROUP BY 1, 2",
    "v_field",
)
def matrix_lines(spark, sf_dir):
    return sinks.matrix_lines(views.field(spark, sf_dir), "water_u", ["time_idx"])


@query("SELECT printf('%.6f %.6f 0.000000', lon, lat) AS value FROM v_particle", "v_particle")
def vtk_points(spark, sf_dir):
    return sinks.vtk_points(points(spark, sf_dir))


@query()
def geojson_vectors(spark, sf_dir):
    return sinks.vector_lines(views.field(spark, sf_dir), 5)


@query()
def json_rows(spark, sf_dir):
    return sinks.json_rows(views.field(spark, sf_dir))
