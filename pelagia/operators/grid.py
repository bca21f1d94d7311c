"""Grid arithmetic: cell ids, sigma levels, layers, refinement, point access, task and metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flat_index(i: Column, j: Column, k: Column, n_x: int, n_y: int) -> Column:
    return k * (n_x * n_y) + j * n_x + i


def from_flat(cell: Column, n_x: int, n_y: int) -> Column:
    plane = F.pmod(cell, F.lit(n_x * n_y))
    whole = lambda a, n: ((a - F.pmod(a, F.lit(n))) / n).cast("int")
    return F.struct(F.pmod(plane, F.lit(n_x)).cast("int").alias("i"), whole(plane, n_x).alias("j"), whole(cell, n_x * n_y).alias("k"))


def sigma_to_z(sigma: Column, depth: Column, eta: Column) -> Column:
    """Height of a sigma level: -depth at 0, eta at 1."""
    return -depth + sigma * (depth + eta)


def z_to_sigma(z: Column, depth: Column, eta: Column) -> Column:
    return F.try_divide(z + depth, depth + eta)


def layer_thickness(levels: DataFrame) -> DataFrame:
    """Levels (j, i, k, sigma, depth, eta; time_idx too if there are several) with the thickness of the layer above each; null for the top one."""
    above = F.lead("sigma").over(Window.partitionBy(*(c for c in ("time_idx", "j", "i") if c in levels.columns)).orderBy("k"))
    return levels.withColumn("thickness", (above - F.col("sigma")) * (F.col("depth") + F.col("eta")))


def refine_by_radius(cells: DataFrame, j0: float, i0: float, radius: float, by: int, most: int) -> DataFrame:
    """`level` raised within a radius of a cell, up to a highest level."""
    d = F.sqrt((F.col("j") - j0) * (F.col("j") - j0) + (F.col("i") - i0) * (F.col("i") - i0))
    return cells.withColumn("level", F.when(d <= radius, F.least(F.col("level") + by, F.lit(most))).otherwise(F.col("level")))


def refine_by_gradient(cells: DataFrame, gradient: str, threshold: float, most: int) -> DataFrame:
    return cells.withColumn("level", F.when(F.abs(F.col(gradient)) > threshold, F.least(F.col("level") + 1, F.lit(most))).otherwise(F.col("level")))


def coarsen(cells: DataFrame, gradient: str, threshold: float) -> DataFrame:
    return cells.withColumn("level", F.when(F.abs(F.col(gradient)) < threshold, F.greatest(F.col("level") - 1, F.lit(0))).otherwise(F.col("level")))


def set_value(df: DataFrame, name: str, at: dict[str, int], value: float) -> DataFrame:
    """A field with one cell's value replaced."""
    here = F.lit(True)
    for key, v in at.items():
        here = here & (F.col(key) == v)
    return df.withColumn(name, F.when(here, value).otherwise(F.col(name)))


def all_finite(df: DataFrame, name: str) -> DataFrame:
    c = F.col(name)
    return df.agg(F.every(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))).alias("all_finite"))


def last_n(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The newest n rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")


def rising_runs(df: DataFrame, by: str, order: str, value: str, least: int = 5) -> DataFrame:
    """Groups in which a value rose at least `least` times in a row, with the longest run."""
    w = Window.partitionBy(by).orderBy(order)
    up = df.withColumn("_up", F.coalesce((F.col(value) > F.lag(value).over(w)), F.lit(False)))
    runs = up.withColumn("_run", F.sum((~F.col("_up")).cast("int")).over(w)).where("_up").groupBy(by, "_run").agg(F.count("*").alias("n"))
    return runs.groupBy(by).agg(F.max("n").alias("longest")).where(F.col("longest") >= least)
