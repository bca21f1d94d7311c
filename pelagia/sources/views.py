"""The gridded tables that queries use, derived from the given star schema, for Spark and as SQL text for DuckDB.

Integers first and one division last, so that both engines hold the same bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Cells on each side of the field; the benchmark may use more.
SIDE = 32

FIELD = """
WITH axis AS (SELECT DISTINCT CAST(p_partkey % {n} AS INT) AS a FROM part),
steps AS (SELECT DISTINCT CAST(year(l_shipdate) - 1995 AS INT) AS t FROM lineitem WHERE year(l_shipdate) <= 1998),
cells AS (SELECT CAST(year(l_shipdate) - 1995 AS INT) AS t, CAST(l_orderkey % {n} AS INT) AS j, CAST(l_partkey % {n} AS INT) AS i,
                 SUM(CAST(l_quantity AS BIGINT)) AS sq, SUM(CAST(l_linenumber AS BIGINT)) AS sl
          FROM lineitem GROUP BY 1, 2, 3)
SELECT s.t AS time_idx, 0 AS depth_idx, y.a AS j, x.a AS i,
       21e0 + 0.125e0 * y.a AS lat, 118e0 + 0.125e0 * x.a AS lon,
       CASE WHEN (x.a * 13 + y.a * 7) % 17 = 0 THEN NULL
            ELSE CAST((COALESCE(c.sq, 0) * 7919 + x.a * 31 + y.a * 17) % 2001 - 1000 AS DOUBLE) / 1000e0 END AS water_u,
       CASE WHEN (x.a * 13 + y.a * 7) % 17 = 0 THEN NULL
            ELSE CAST((COALESCE(c.sl, 0) * 104729 + x.a * 11 + y.a * 41) % 2001 - 1000 AS DOUBLE) / 1000e0 END AS water_v
FROM steps s CROSS JOIN axis y CROSS JOIN axis x
LEFT JOIN cells c ON c.t = s.t AND c.j = y.a AND c.i = x.a"""

SERIES = """
SELECT event_type AS key, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, ts,
       CASE WHEN event_id % 11 = 0 OR event_id % 97 < 4 THEN NULL ELSE value END AS value
FROM events"""

PARTICLE = """
SELECT c_custkey AS id, 118.5e0 + CAST(c_custkey % 48 AS DOUBLE) * 0.0625e0 AS lon,
       21.5e0 + CAST(c_custkey * 7 % 48 AS DOUBLE) * 0.0625e0 AS lat
FROM customer"""

SOURCE = """
SELECT s_suppkey AS source_id, CAST(s_suppkey * 5 % 32 AS INT) AS i, CAST(s_suppkey * 11 % 32 AS INT) AS j,
       CAST(100 + s_suppkey % 10 * 50 AS DOUBLE) AS intensity,
       CAST(s_suppkey % 5 * 600 AS DOUBLE) AS t_start, CAST(s_suppkey % 5 * 600 + 1800 AS DOUBLE) AS t_end
FROM supplier"""

OBS = """
SELECT o_orderkey AS obs_id, CASE o_orderkey % 3 WHEN 0 THEN 'sla' WHEN 1 THEN 'sst' ELSE 'ice' END AS obs_type,
       CAST(o_orderkey % 32 AS INT) AS i, CAST(o_custkey % 32 AS INT) AS j,
       CAST((o_orderkey * 31 + o_custkey) % 4001 - 500 AS DOUBLE) / 100e0 AS value,
       CAST(1 + o_orderkey % 4 AS DOUBLE) * 0.25e0 AS err_var, o_orderdate AS ts
FROM orders"""

ENSEMBLE = """
SELECT CAST(vec_id % 20 AS INT) AS member, vec_id DIV 20 AS block, pos AS cell,
       CAST(CAST(round(CAST(e AS DOUBLE) * 1000) AS BIGINT) AS DOUBLE) / 1000e0 AS x
FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, e"""

ENSEMBLE_DUCK = """
SELECT CAST(vec_id % 20 AS INT) AS member, vec_id // 20 AS block, pos AS cell,
       CAST(CAST(round(CAST(e AS DOUBLE) * 1000) AS BIGINT) AS DOUBLE) / 1000e0 AS x
FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"""

DUCK = {"v_field": FIELD.format(n=SIDE), "v_series": SERIES, "v_particle": PARTICLE, "v_source": SOURCE, "v_obs": OBS, "v_ensemble": ENSEMBLE_DUCK}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def _made(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """A query over the named tables, which it mentions by their plain names."""
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}")
    return spark.sql(sql, **tables(spark, sf_dir, *names))


def field(spark: SparkSession, sf_dir: str, side: int = SIDE) -> DataFrame:
    return _made(spark, sf_dir, FIELD.format(n=side), "part", "lineitem")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, SERIES, "events")


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, PARTICLE, "customer")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, SOURCE, "supplier")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, OBS, "orders")


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, ENSEMBLE, "embeddings")
