"""Reading gridded tables: long-format Parquet, slabs, crops, extents, pairs of velocity files, encoded payloads."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.schema import KEYS, finite_columns


def read_field(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A long-format field table with non-finite numbers as NULL; only the named columns are read."""
    df = spark.read.parquet(path)
    return finite_columns(df.select(*columns) if columns else df)


def load(spark: SparkSession, path: str, variables: list[str], times: tuple[int, int] | None = None, lon: tuple[float, float] | None = None, lat: tuple[float, float] | None = None) -> DataFrame:
    """The variables of a field within a range of time steps and a box; all filters reach the scan."""
    df = read_field(spark, path, [*KEYS, "lat", "lon", *variables])
    df = df.where(F.col("time_idx").between(*times)) if times else df
    return crop(df, lon, lat)


def slab(df: DataFrame, time_idx: int, depth_idx: int | None = None) -> DataFrame:
    """One time step, of one layer or of all."""
    df = df.where(F.col("time_idx") == time_idx)
    return df if depth_idx is None else df.where(F.col("depth_idx") == depth_idx)


def crop(df: DataFrame, lon: tuple[float, float] | None = None, lat: tuple[float, float] | None = None) -> DataFrame:
    """An inclusive box; either side may be open."""
    df = df.where(F.col("lon").between(*lon)) if lon else df
    return df.where(F.col("lat").between(*lat)) if lat else df


def strided(df: DataFrame, n: int, axes: tuple[str, ...] = ("i", "j")) -> DataFrame:
    return reduce(lambda d, a: d.where(F.col(a) % n == 0), axes, df)


def extent(df: DataFrame) -> DataFrame:
    """One row: ranges, distinct counts, spans in km, wet cells and their share."""
    wet = F.expr("water_u IS NOT NULL AND water_v IS NOT NULL")
    span = lambda c: (F.max(c) - F.min(c)) * 111.32
    return df.agg(
        F.min("lat").alias("lat_min"),
        F.max("lat").alias("lat_max"),
        F.min("lon").alias("lon_min"),
        F.max("lon").alias("lon_max"),
        F.countDistinct("lat").alias("n_lat"),
        F.countDistinct("lon").alias("n_lon"),
        F.countDistinct("time_idx").alias("n_time"),
        span("lat").alias("span_lat_km"),
        (span("lon") * F.cos(F.radians(F.avg("lat")))).alias("span_lon_km"),
        F.count_if(wet).alias("valid"),
        F.avg(wet.cast("double")).alias("coverage"),
    )


def describe_columns(df: DataFrame) -> DataFrame:
    """name, type, n and n_null of every column."""
    row = df.agg(F.count("*").alias("_n"), *(F.count(c).alias(c) for c in df.columns))
    parts = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.col("_n").alias("n"), (F.col("_n") - F.col(n)).alias("n_null")) for n, t in df.dtypes))
    return row.select(F.explode(parts).alias("c")).select("c.*")


def times(df: DataFrame) -> DataFrame:
    """time_idx and its text for each step of a field with a `time` column."""
    return df.select("time_idx", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time")).distinct()


def merge_uv(u: DataFrame, v: DataFrame) -> DataFrame:
    """Cells that both components have."""
    return u.join(v, list(KEYS))


def concat_time(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def stepped_times(spark: SparkSession, start: str, end: str, hours: int = 3) -> DataFrame:
    """ts and its yyyyMMddHH text, both ends included."""
    made = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"INTERVAL {hours} HOURS"))).alias("ts"))
    return made.select("ts", F.date_format("ts", "yyyyMMddHH").alias("label"))


def date_range(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))


def decode_grid(df: DataFrame, payload: str, n_x: int) -> DataFrame:
    """Rows with a base64 column of little-endian doubles, unfolded to j, i, value."""
    keep = [c for c in df.columns if c != payload]

    @F.pandas_udf("array<double>")
    def values(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: np.frombuffer(b, dtype="<f8"))

    rows = df.select(*keep, F.posexplode(values(F.unbase64(payload))).alias("_p", "value"))
    return rows.select(*keep, F.expr(f"CAST(_p DIV {n_x} AS INT)").alias("j"), (F.col("_p") % n_x).alias("i"), F.when(~F.isnan("value"), F.col("value")).alias("value"))


def file_report(spark: SparkSession, path: str) -> DataFrame:
    """name and bytes of each file of a table."""
    return spark.read.format("parquet").load(path).select("_metadata.file_name", "_metadata.file_size").distinct()


def requests(df: DataFrame, column: str = "value") -> DataFrame:
    """action and parameters of JSON request texts; texts that are no request give nulls."""
    parsed = F.from_json(column, "action STRING, parameters MAP<STRING, STRING>")
    return df.select(parsed["action"].alias("action"), parsed["parameters"].alias("parameters"))


def required(parameters: Column, *names: str) -> Column:
    """The names that a request lacks."""
    return F.filter(F.array(*map(F.lit, names)), lambda n: ~F.coalesce(F.array_contains(F.map_keys(parameters), n), F.lit(False)))
