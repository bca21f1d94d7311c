"""Queries on time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagia.operators import grid, series
from pelagia.plans.catalogue import query, r
from pelagia.schema import rounded
from pelagia.sources import readers, views

W7 = "(PARTITION BY key ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"


@query(
    f"SELECT key, idx, {r(f'avg(value) OVER {W7}')} AS running_mean, {r(f'stddev_pop(value) OVER {W7}')} AS running_std, min(value) OVER {W7} AS running_min, max(value) OVER {W7} AS running_max, {r(f'quantile_cont(value, 0.5) OVER {W7}')} AS running_median FROM v_series",
    "v_series",
)
def running_statistics(spark, sf_dir):
    d = series.running(views.series(spark, sf_dir), 7)
    return d.select("key", "idx", *(rounded(F.col(c)).alias(c) for c in ("running_mean", "running_std")), "running_min", "running_max", rounded(F.col("running_median")).alias("running_median"))


BEFORE, AFTER = "(PARTITION BY key ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "(PARTITION BY key ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query(
    f"w AS (SELECT *, last_value(value IGNORE NULLS) OVER {BEFORE} AS v0, last_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER {BEFORE} AS p0, first_value(value IGNORE NULLS) OVER {AFTER} AS v1, first_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER {AFTER} AS p1 FROM v_series) "
    f"SELECT key, idx, {r('CASE WHEN value IS NOT NULL THEN value WHEN p1 - p0 - 1 <= 3 THEN v0 + (v1 - v0)*CAST(idx - p0 AS DOUBLE)/(p1 - p0) END')} AS filled FROM w",
    "v_series",
)
def gap_fill_linear(spark, sf_dir):
    return series.fill_gaps(views.series(spark, sf_dir), 3).select("key", "idx", rounded(F.col("filled")).alias("filled"))


@query(f"SELECT key, idx, {r('avg(value) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)')} AS moving_average FROM v_series", "v_series")
def moving_average(spark, sf_dir):
    return series.moving_average(views.series(spark, sf_dir), 4).select("key", "idx", rounded(F.col("moving_average")).alias("moving_average"))


@query(
    "t AS (SELECT key, k*2.5e0 AS x FROM (SELECT key, max(idx) AS n FROM v_series GROUP BY 1), generate_series(0, CAST(floor(n/2.5e0) AS BIGINT)) t(k)), p AS (SELECT key, CAST(idx AS DOUBLE) AS x, value FROM v_series WHERE value IS NOT NULL), "
    "lo AS (SELECT t.key, t.x, p.x AS x0, p.value AS v0 FROM t ASOF LEFT JOIN p ON t.key = p.key AND t.x >= p.x), b AS (SELECT lo.*, p.x AS x1, p.value AS v1 FROM lo ASOF LEFT JOIN p ON lo.key = p.key AND lo.x <= p.x) "
    f"SELECT key, x, {r('CASE WHEN x0 = x1 THEN v0 ELSE v0 + (v1 - v0)*(x - x0)/(x1 - x0) END')} AS value FROM b",
    "v_series",
)
def resample_linear(spark, sf_dir):
    d = views.series(spark, sf_dir)
    ends = d.groupBy("key").agg(F.max("idx").alias("n"))
    targets = ends.select("key", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / 2.5))).alias("k")).select("key", (F.col("k") * 2.5).alias("x"))
    return series.resample(d.withColumn("x", F.col("idx").cast("double")), targets).select("key", "x", rounded(F.col("value")).alias("value"))


@query(f"SELECT key, idx, {r('(value - avg(value) OVER (PARTITION BY key))/stddev_pop(value) OVER (PARTITION BY key)')} AS anomaly FROM v_series", "v_series")
def anomaly_zscore(spark, sf_dir):
    return series.anomalies(views.series(spark, sf_dir), ["key"]).select("key", "idx", rounded(F.col("anomaly")).alias("anomaly"))


@query(
    f"c AS (SELECT *, max(idx) OVER (PARTITION BY key) + 1 AS n FROM v_series) SELECT key, CAST(CASE WHEN n < 30 THEN -1 ELSE idx % 30 END AS INT) AS phase, {r('avg(value)')} AS mean, count(value) AS n FROM c WHERE idx < (n // 30)*30 OR n < 30 GROUP BY 1, 2",
    "v_series",
)
def climatology(spark, sf_dir):
    return series.climatology(views.series(spark, sf_dir), 30).withColumn("mean", rounded(F.col("mean")))


@query(
    f"x AS (SELECT key, idx, coalesce(value, 0e0) AS v FROM v_series), p AS (SELECT key, sum(v*v) AS vv FROM x GROUP BY 1), s AS (SELECT a.key, CAST(a.idx - b.idx AS INT) AS lag, sum(a.v*b.v) AS xy FROM x a JOIN x b ON a.key = b.key AND a.idx - b.idx BETWEEN -5 AND 5 GROUP BY 1, 2) SELECT s.key, lag, {r('xy/sqrt(vv*vv)')} AS correlation FROM s JOIN p ON s.key = p.key",
    "v_series",
)
def cross_correlation(spark, sf_dir):
    d = views.series(spark, sf_dir)
    return series.cross_correlation(d, d, 5).withColumn("correlation", rounded(F.col("correlation")))


@query(
    f"x AS (SELECT key, idx, coalesce(value, 0e0) AS v, count(*) OVER (PARTITION BY key) AS n FROM v_series) SELECT key, CAST(k AS INT) AS k, {r('(sum(v*cos(2*pi()*((k*idx) % n)/n))*sum(v*cos(2*pi()*((k*idx) % n)/n)) + sum(v*sin(2*pi()*((k*idx) % n)/n))*sum(v*sin(2*pi()*((k*idx) % n)/n)))/max(n)', 3)} AS power FROM x, range(8) t(k) GROUP BY 1, 2",
    "v_series",
)
def dft_power(spark, sf_dir):
    return series.dft_power(views.series(spark, sf_dir), 8).withColumn("power", rounded(F.col("power"), 3))


@query(
    f"w AS (SELECT key, (idx - lag(idx) OVER o)*(coalesce(value, 0e0) + lag(coalesce(value, 0e0)) OVER o)/2 AS p FROM v_series WINDOW o AS (PARTITION BY key ORDER BY idx)) SELECT key, {r('coalesce(sum(p), 0e0)', 4)} AS integral FROM w GROUP BY 1",
    "v_series",
)
def trapezoid(spark, sf_dir):
    d = views.series(spark, sf_dir).withColumn("value", F.coalesce("value", F.lit(0.0)))
    return series.trapezoid(d, "idx", "value").withColumn("integral", rounded(F.col("integral"), 4))


@query(
    "x AS (SELECT key, idx, coalesce(value, 0e0) AS v, count(*) OVER (PARTITION BY key) AS n FROM v_series), e AS (SELECT *, n - 1 - (n - 1) % 2 AS last FROM x) "
    f"SELECT key, {r('sum(v*(CASE WHEN idx > last THEN 0e0 WHEN idx = 0 OR idx = last THEN 1e0 WHEN idx % 2 = 1 THEN 4e0 ELSE 2e0 END/3 + CASE WHEN n % 2 = 0 AND idx >= n - 2 THEN 0.5e0 ELSE 0e0 END))', 4)} AS integral FROM e GROUP BY 1",
    "v_series",
)
def simpson(spark, sf_dir):
    d = views.series(spark, sf_dir).withColumn("value", F.coalesce("value", F.lit(0.0)))
    return series.simpson(d, "value", 1.0).withColumn("integral", rounded(F.col("integral"), 4))


@query(
    f"SELECT key, idx, {r('(lead(value) OVER o - lag(value) OVER o)/CAST(lead(idx) OVER o - lag(idx) OVER o AS DOUBLE)')} AS rate FROM v_series WINDOW o AS (PARTITION BY key ORDER BY idx)",
    "v_series",
)
def time_derivative(spark, sf_dir):
    d = views.series(spark, sf_dir)
    return d.select("key", "idx", rounded(series.time_derivative(d, F.col("value"))).alias("rate"))


@query(f"SELECT key, count(value) AS n, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std, {r('median(value)')} AS median FROM v_series GROUP BY 1", "v_series")
def series_moments(spark, sf_dir):
    return views.series(spark, sf_dir).groupBy("key").agg(F.count("value").alias("n"), rounded(F.avg("value")).alias("mean"), rounded(F.stddev_samp("value")).alias("std"), rounded(F.median("value")).alias("median"))


@query(
    "u AS (SELECT key, idx, value, coalesce(value > lag(value) OVER o, false) AS up FROM v_series WINDOW o AS (PARTITION BY key ORDER BY idx)), g AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY idx) AS run FROM u), "
    "c AS (SELECT key, run, count(*) AS n FROM g WHERE up GROUP BY 1, 2) SELECT key, max(n) AS longest FROM c GROUP BY 1 HAVING max(n) >= 3",
    "v_series",
)
def rising_runs(spark, sf_dir):
    return grid.rising_runs(views.series(spark, sf_dir), "key", "idx", "value", 3)


@query("SELECT key, idx, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx DESC) AS k FROM v_series) WHERE k <= 10", "v_series")
def last_rows(spark, sf_dir):
    return grid.last_n(views.series(spark, sf_dir), ["key"], "idx", 10).select("key", "idx", "value")


@query("SELECT event_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 50")
def top_events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value").orderBy(F.desc("value"), "event_id").limit(50)


@query("SELECT strftime(t, '%Y%m%d%H') AS label FROM (SELECT unnest(generate_series(CAST(min(o_orderdate) AS TIMESTAMP), CAST(max(o_orderdate) AS TIMESTAMP), INTERVAL 3 HOUR)) AS t FROM orders)")
def stepped_times(spark, sf_dir):
    """Every third hour from the first order to the last."""
    ends = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(*(f("o_orderdate").cast("timestamp").cast("string").alias(k) for k, f in (("lo", F.min), ("hi", F.max)))).first()
    return readers.stepped_times(spark, ends["lo"], ends["hi"], 3).select("label")


@query()
def welch_spectrum(spark, sf_dir):
    return series.spectrum(views.series(spark, sf_dir), 1.0, "welch")


_PIVOT = "(s.b - s.a*f.ratio)"


@query(
    "k AS (SELECT key, CAST(idx AS DOUBLE) AS x, value AS v, row_number() OVER w AS n, count(*) OVER (PARTITION BY key) AS m, CAST(lead(idx) OVER w - idx AS DOUBLE) AS h, CAST(idx - lag(idx) OVER w AS DOUBLE) AS g, "
    "(lead(value) OVER w - value)/(lead(idx) OVER w - idx) AS d, (value - lag(value) OVER w)/(idx - lag(idx) OVER w) AS e FROM v_series WHERE value IS NOT NULL WINDOW w AS (PARTITION BY key ORDER BY idx)), "
    "y AS (SELECT key, n, m, x, v, CASE WHEN n = 1 OR n = m THEN 0e0 ELSE g END AS a, CASE WHEN n = 1 OR n = m THEN 1e0 ELSE 2*(g + h) END AS b, CASE WHEN n = 1 OR n = m THEN 0e0 ELSE h END AS c, CASE WHEN n = 1 OR n = m THEN 0e0 ELSE 6*(d - e) END AS z FROM k), "
    f"f AS (SELECT key, n, 0e0 AS ratio, 0e0 AS u FROM y WHERE n = 1 UNION ALL SELECT s.key, s.n, s.c/{_PIVOT}, (s.z - s.a*f.u)/{_PIVOT} FROM f JOIN y s ON s.key = f.key AND s.n = f.n + 1), "
    "b AS (SELECT f.key, f.n, f.u FROM f JOIN y ON y.key = f.key AND y.n = f.n AND y.m = y.n UNION ALL SELECT f.key, f.n, f.u - f.ratio*b.u FROM b JOIN f ON f.key = b.key AND f.n = b.n - 1), "
    "o AS (SELECT y.key, y.x, y.v, b.u AS curve FROM y JOIN b ON b.key = y.key AND b.n = y.n), t AS (SELECT key, CAST(idx AS DOUBLE) + 0.5e0 AS x FROM v_series WHERE idx % 7 = 3), "
    "lo AS (SELECT t.key, t.x, o.x AS x0, o.v AS v0, o.curve AS m0 FROM t ASOF LEFT JOIN o ON t.key = o.key AND t.x >= o.x), hi AS (SELECT lo.*, o.x AS x1, o.v AS v1, o.curve AS m1, o.x - x0 AS h FROM lo ASOF LEFT JOIN o ON lo.key = o.key AND lo.x <= o.x) "
    f"SELECT key, x, {r('(m0*(x1 - x)*(x1 - x)*(x1 - x) + m1*(x - x0)*(x - x0)*(x - x0))/(6*h) + (v0/h - m0*h/6)*(x1 - x) + (v1/h - m1*h/6)*(x - x0)')} AS value FROM hi",
    "v_series",
)
def spline_resample(spark, sf_dir):
    d = views.series(spark, sf_dir).withColumn("x", F.col("idx").cast("double"))
    targets = d.where("idx % 7 = 3").select("key", (F.col("x") + 0.5).alias("x"))
    return series.cubic_resample(d, targets).select("key", "x", rounded(F.col("value")).alias("value"))


@query(
    "k AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY idx) AS n FROM v_series WHERE value IS NOT NULL), m AS (SELECT key, max(n) AS last FROM k GROUP BY 1) "
    f"SELECT k.key, {r('sum(value*CASE WHEN n = 1 THEN pow(0.9e0, last - 1) ELSE 0.1e0*pow(0.9e0, last - n) END)')} AS ema FROM k JOIN m ON k.key = m.key GROUP BY 1",
    "v_series",
)
def exponential_average(spark, sf_dir):
    return series.exponential_average(views.series(spark, sf_dir)).select("key", rounded(F.col("ema")).alias("ema"))
