"""Analytic fields and profiles, as DataFrames built from spark.range."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.functions.mathx import normal


def cells(spark: SparkSession, n_x: int, n_y: int, n_t: int = 1, n_z: int = 1) -> DataFrame:
    """time_idx, depth_idx, j, i of every cell of a grid."""
    made = spark.range(n_x * n_y * n_z * n_t)
    part = lambda below, n: F.expr(f"CAST(id DIV {below} % {n} AS INT)")
    return made.select(part(n_x * n_y * n_z, n_t).alias("time_idx"), part(n_x * n_y, n_z).alias("depth_idx"), part(n_x, n_y).alias("j"), part(1, n_x).alias("i"))


def _axis(c: str, lo: float, hi: float, n: int):
    return F.lit(lo) + F.col(c) * ((hi - lo) / (n - 1))


def swirled(df: DataFrame, lon0: float = 121.0, lat0: float = 23.75, strength: float = 0.5, fade: float = 2.0) -> DataFrame:
    """df (lat, lon) with water_u and water_v of a vortex around a point, strength·exp(-fade·r), still at the centre."""
    dx, dy = F.col("lon") - lon0, F.col("lat") - lat0
    r = F.sqrt(dx * dx + dy * dy)
    s = F.when(r <= 0.01, 0.0).otherwise(F.try_divide(strength * F.exp(-fade * r), r))
    return df.withColumns({"water_u": -dy * s, "water_v": dx * s})


def gaussian_vortex(spark: SparkSession) -> DataFrame:
    """20 x 25 cells around (23.75, 121): strength 0.5·exp(-2r), still at the centre."""
    return swirled(cells(spark, 25, 20).withColumns({"lat": _axis("j", 21.0, 26.5, 20), "lon": _axis("i", 118.0, 124.0, 25)}))


def solid_rotation(spark: SparkSession, n: int = 50, omega: float = 2.0) -> DataFrame:
    """Rotation about the middle of the unit square."""
    d = cells(spark, n, n).withColumns({"x": _axis("i", 0.0, 1.0, n), "y": _axis("j", 0.0, 1.0, n)})
    return d.withColumns({"water_u": -omega * (F.col("y") - 0.5), "water_v": omega * (F.col("x") - 0.5)})


def tidal_demo(spark: SparkSession, n_t: int = 24, n_z: int = 4, n_y: int = 60, n_x: int = 80) -> DataFrame:
    """A vortex with two tides, weaker with depth; every 3 hours."""
    d = cells(spark, n_x, n_y, n_t, n_z).withColumns({"lat": _axis("j", 23.0, 25.5, n_y), "lon": _axis("i", 119.5, 122.0, n_x), "hours": F.col("time_idx") * 3.0})
    dx, dy = F.col("lon") - 120.75, F.col("lat") - 24.25
    swirl = F.exp(-(dx * dx + dy * dy))
    tide = 0.3 * F.sin(F.col("hours") * (2 * math.pi / 12.42)) + 0.1 * F.sin(F.col("hours") * (2 * math.pi / 12.0))
    fade = F.exp(-F.col("depth_idx") / 4.0)
    return d.withColumns({"water_u": (-0.5 * dy * swirl + tide) * fade, "water_v": (0.5 * dx * swirl + 0.5 * tide) * fade})


def sea_level_over(df: DataFrame, noise: float = 0.0, seed: int = 1) -> DataFrame:
    """df (time_idx in days, lat, lon) with a sea-level anomaly in centimetres, and noise hashed from the place and day."""
    wave = 10 * F.sin(F.radians(F.col("lon") * 18)) * F.cos(F.radians(F.col("lat") * 18))
    season = 5 * F.sin(F.col("time_idx") * (2 * math.pi / 365))
    made = wave + season
    return df.withColumn("sla", made + normal("time_idx", "lat", "lon", F.lit(seed)) * noise if noise else made)


def sea_level(spark: SparkSession, days: int = 7, noise: float = 0.0, seed: int = 1) -> DataFrame:
    """A 20 x 40 sea-level anomaly in centimetres for each day, with optional seeded noise."""
    return sea_level_over(cells(spark, 40, 20, days).withColumns({"lat": _axis("j", 65.0, 75.0, 20), "lon": _axis("i", 0.0, 20.0, 40)}), noise, seed)


def profiles(spark: SparkSession, n: int = 3) -> DataFrame:
    """Temperature and salinity at ten depths for each profile, inside physical ranges."""
    depths = [0.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1000.0, 1500.0, 2000.0]
    d = spark.range(n).select(F.col("id").cast("int").alias("profile_id"), F.posexplode(F.array(*map(F.lit, depths))).alias("level", "pres"))
    t = F.greatest(F.lit(-2.0), F.least(F.lit(30.0), 12.0 - F.col("pres") / 200.0 + F.col("profile_id")))
    s = F.greatest(F.lit(30.0), F.least(F.lit(40.0), 34.5 + F.col("pres") / 4000.0))
    return d.withColumns({"temp": t, "psal": s})
