"""A layered ocean: a stream with eddies that fades with depth, and temperature and salinity."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.functions.mathx import normal
from pelagia.operators.stencil import along_z, derivative, along_x, along_y
from pelagia.sources.generators import cells

#: Eddies as metres east and north of the middle, strength and radius in metres.
EDDIES = ((-20000.0, 15000.0, 0.8, 15000.0), (25000.0, -10000.0, -0.6, 12000.0), (-10000.0, -20000.0, 0.4, 8000.0))
#: The part of an eddy that turns like a solid body.
CORE = 0.3


def layered(d: DataFrame, width: float, depth: float, dz: float, noise: float = 0.0, seed: int = 1) -> DataFrame:
    """d (time_idx, depth_idx, j, i, x, y, z in metres) with u, v, w, temperature and salinity.

    w follows from continuity, summed downwards with horizontal differences by cell; optional noise on u, v and w is
    hashed from the cell and the seed."""
    columns, middle = d.columns, width / 2
    wave = F.sin(2 * math.pi * F.col("x") / width)
    u, v = F.lit(0.5), 0.1 * wave
    for east, north, strength, radius in EDDIES:
        dx, dy = F.col("x") - (middle + east), F.col("y") - (middle + north)
        r = F.sqrt(dx * dx + dy * dy)
        core = radius * CORE
        turn = F.when(r < core, F.lit(strength / core)).when(r < radius, F.try_divide(F.lit(strength * core), r * r)).otherwise(0.0)
        turn = turn * F.exp(-(r / radius) * (r / radius))
        u, v = u - turn * dy, v + turn * dx
    fade = F.exp(-F.col("z") / 50.0)
    d = d.withColumns({"u": u * fade, "v": v * fade})
    d = d.withColumn("_ux", derivative(F.col("u"), along_x(), 1.0)).withColumn("_vy", derivative(F.col("v"), along_y(), 1.0))
    below = F.when(F.col("depth_idx") > 0, -(F.col("_ux") + F.col("_vy")) * dz).otherwise(0.0)
    d = d.withColumn("w", F.sum(below).over(along_z().rowsBetween(-(1 << 30), 0)))
    d = d.withColumns({
        "temperature": 25.0 - 15.0 * (F.col("z") / depth) + 2.0 * wave * F.exp(-F.col("z") / 30.0),
        "salinity": 35.0 + (F.col("y") - middle) / width + 0.5 * (F.col("z") / depth),
    })
    if noise:
        d = d.withColumns({c: F.col(c) + normal("time_idx", "depth_idx", "j", "i", F.lit(seed + k)) * (noise * s) for k, (c, s) in enumerate((("u", 1.0), ("v", 1.0), ("w", 0.1)))})
    return d.select(*columns, "u", "v", "w", "temperature", "salinity")


def layered_ocean(spark: SparkSession, n_x: int = 40, n_y: int = 40, n_z: int = 5, width: float = 100_000.0, depth: float = 100.0, noise: float = 0.0, seed: int = 1) -> DataFrame:
    """layered() on a regular grid of `width` metres on each side and `depth` metres of layers."""
    dz = depth / (n_z - 1)
    d = cells(spark, n_x, n_y, 1, n_z).withColumns({"x": F.col("i") * (width / (n_x - 1)), "y": F.col("j") * (width / (n_y - 1)), "z": F.col("depth_idx") * dz})
    return layered(d, width, depth, dz, noise, seed)
