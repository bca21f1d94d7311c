"""Shallow-water flow steps: barotropic momentum and continuity, tracers of the flow, density, boundaries, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.functions import ocean
from pelagia.operators.stencil import along_x, along_y


def _central(c: str | Column, window, h: float) -> Column:
    return (F.lead(c).over(window) - F.lag(c).over(window)) / (2 * h)


def barotropic_step(df: DataFrame, dt: float, dx: float, dy: float, coriolis: float, depth: str | None = None, tau_x: str | None = None, tau_y: str | None = None) -> DataFrame:
    """u, v and eta after one explicit step with the depth at the cell, a constant Coriolis parameter and wind over density.

    Border cells keep their values. df: u, v, eta and, if named, depth and wind stress."""
    h = F.coalesce(F.col(depth), F.lit(1000.0)) if depth else F.lit(1000.0)
    wind = lambda t: F.coalesce(F.col(t), F.lit(0.0)) / ocean.RHO0 if t else F.lit(0.0)
    d = df.withColumns({"_ux": _central("u", along_x(), dx), "_ex": _central("eta", along_x(), dx)}).withColumns({"_vy": _central("v", along_y(), dy), "_ey": _central("eta", along_y(), dy)})
    eta = F.col("eta") - dt * h * (F.col("_ux") + F.col("_vy"))
    inner = F.col("_ux").isNotNull() & F.col("_vy").isNotNull()
    u = F.col("u") + dt * (coriolis * F.col("v") - ocean.GRAVITY * F.col("_ex") + wind(tau_x))
    v = F.col("v") + dt * (-coriolis * F.col("u") - ocean.GRAVITY * F.col("_ey") + wind(tau_y))
    new = {"_u": F.when(inner, u).otherwise(F.col("u")), "_v": F.when(inner, v).otherwise(F.col("v")), "_eta": F.when(inner, eta).otherwise(F.col("eta"))}
    return d.withColumns(new).withColumns({"u": F.col("_u"), "v": F.col("_v"), "eta": F.col("_eta")}).select(*df.columns)


def tracer_step(df: DataFrame, name: str, dt: float, dx: float, dy: float, diffusivity: float) -> DataFrame:
    """Temperature or salinity after central advection by u, v and horizontal diffusion; border cells keep their values."""
    c = F.col(name)
    second = lambda w, h: (F.lead(c).over(w) - 2 * c + F.lag(c).over(w)) / (h * h)
    d = df.withColumns({"_x": _central(c, along_x(), dx), "_xx": second(along_x(), dx)}).withColumns({"_y": _central(c, along_y(), dy), "_yy": second(along_y(), dy)})
    rate = diffusivity * (F.col("_xx") + F.col("_yy")) - F.col("u") * F.col("_x") - F.col("v") * F.col("_y")
    return d.withColumn(name, F.coalesce(c + dt * rate, c)).select(*df.columns)


def with_density(df: DataFrame) -> DataFrame:
    """density from temperature, salinity and pressure, then the hydrostatic pressure of the new density."""
    d = df.withColumn("density", ocean.density_b(F.col("temperature"), F.col("salinity"), F.col("pressure")))
    return d.withColumn("pressure", ocean.hydrostatic_pressure(F.col("density"), F.col("eta")))


def walls(df: DataFrame, n_x: int, n_y: int, level: tuple[str, ...] = ("eta",)) -> DataFrame:
    """No flow in border cells, and no gradient of the level columns across the border."""
    edge = (F.col("i") == 0) | (F.col("i") == n_x - 1) | (F.col("j") == 0) | (F.col("j") == n_y - 1)
    df = df.withColumns({"u": F.when(edge, 0.0).otherwise(F.col("u")), "v": F.when(edge, 0.0).otherwise(F.col("v"))})
    for c in level:
        x = F.when(F.col("i") == 0, F.lead(c).over(along_x())).when(F.col("i") == n_x - 1, F.lag(c).over(along_x())).otherwise(F.col(c))
        df = df.withColumn("_x", x)
        y = F.when(F.col("j") == 0, F.lead("_x").over(along_y())).when(F.col("j") == n_y - 1, F.lag("_x").over(along_y())).otherwise(F.col("_x"))
        df = df.withColumn("_y", y).withColumn(c, F.col("_y")).drop("_x", "_y")
    return df


def step(df: DataFrame, dt: float, dx: float, dy: float, coriolis: float, n_x: int, n_y: int, diffusivity: float = 100.0) -> DataFrame:
    """Barotropic, then temperature and salinity, then density and pressure, then walls."""
    d = barotropic_step(df, dt, dx, dy, coriolis)
    for name in ("temperature", "salinity"):
        if name in df.columns:
            d = tracer_step(d, name, dt, dx, dy, diffusivity)
    d = with_density(d) if {"temperature", "salinity", "pressure", "density"} <= set(df.columns) else d
    return walls(d, n_x, n_y)


def energy(df: DataFrame, dx: float, dy: float) -> DataFrame:
    """Kinetic plus potential energy of each slab."""
    ke = F.sum((F.col("u") * F.col("u") + F.col("v") * F.col("v")) / 2) * (dx * dy)
    pe = F.sum(F.col("eta") * F.col("eta")) * (0.5 * ocean.GRAVITY * dx * dy)
    return df.groupBy("time_idx", "depth_idx").agg(ke.alias("kinetic"), pe.alias("potential"), (ke + pe).alias("total"))


def mass_imbalance(df: DataFrame, n_x: int, n_y: int, dx: float, dy: float) -> DataFrame:
    """Flow in less flow out across the four sides of each slab."""
    side = lambda axis, at, c: F.sum(F.when(F.col(axis) == at, F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0))
    x = (side("i", 0, "u") - side("i", n_x - 1, "u")) * dy
    y = (side("j", 0, "v") - side("j", n_y - 1, "v")) * dx
    return df.groupBy("time_idx", "depth_idx").agg((x + y).alias("imbalance"))


def grid_spacing(df: DataFrame) -> DataFrame:
    """f at the middle latitude, and dx and dy in metres from the mean spacing of the axes."""
    from pelagia.functions.geo import EARTH_RADIUS

    s = df.agg(*(f(c).alias(f"{c}_{n}") for c in ("lat", "lon") for n, f in (("lo", F.min), ("hi", F.max))), F.countDistinct("lat").alias("n_lat"), F.countDistinct("lon").alias("n_lon"))
    mid = (F.col("lat_lo") + F.col("lat_hi")) / 2
    metres = lambda c: F.radians((F.col(f"{c}_hi") - F.col(f"{c}_lo")) / (F.col(f"n_{c}") - 1)) * EARTH_RADIUS
    return s.select(ocean.coriolis(mid).alias("coriolis"), (metres("lon") * F.cos(F.radians(mid))).alias("dx"), metres("lat").alias("dy"))
