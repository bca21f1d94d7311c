"""Quality control: flags in a fixed order of checks, later ones overwriting earlier ones; repair; report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.lineage import cut
from pelagia.operators.series import fill_gaps
from pelagia.operators.stats import quantiles
from pelagia.operators.stencil import along_t, derivative, along_x, along_y, median_filter

GOOD, SUSPECT, BAD, MISSING, INTERPOLATED = range(5)

#: Physical limits by kind of variable (degrees C, PSU, m/s, m, dbar).
LIMITS = {
    "temperature": (-5.0, 50.0),
    "salinity": (0.0, 50.0),
    "speed": (0.0, 5.0),
    "u_velocity": (-3.0, 3.0),
    "v_velocity": (-3.0, 3.0),
    "w_velocity": (-0.5, 0.5),
    "ssh": (-3.0, 3.0),
    "pressure": (0.0, 1100.0),
}

#: What a variable's name holds for each kind, the first that fits counts; then what its units hold.
KIND_NAMES = (("temperature", "temp sst"), ("salinity", "sal"), ("speed", "speed velocity_magnitude"), ("u_velocity", "u"), ("v_velocity", "v"), ("w_velocity", "w"), ("ssh", "ssh sea_surface_height sla"), ("pressure", "pres"))
KIND_UNITS = (("temperature", "celsius °c"), ("salinity", "psu|practical salinity"), ("speed", "m/s"), ("pressure", "dbar decibar"))


def variable_kind(name: Column, units: Column | None = None) -> Column:
    """The kind of a variable by its name, else by its units, else `unknown`."""
    out = F.lit("unknown")
    holds = lambda c, words: reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(w)) for w in words.split("|" if "|" in words else " ")))
    for kind, words in reversed(KIND_UNITS if units is not None else ()):
        out = F.when(holds(units, words), kind).otherwise(out)
    for kind, words in reversed(KIND_NAMES):
        out = F.when(holds(name, words), kind).otherwise(out)
    return out


def limit_flags(df: DataFrame, name: str = "name", value: str = "value", units: str | None = None, limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Rows (name, value, units) of several variables with their kind and flag: bad outside the kind's limits, missing if null."""
    known = LIMITS | (limits or {})
    kind, c = variable_kind(F.col(name), F.col(units) if units else None), F.col(value)
    outside = reduce(lambda a, k: a.when(F.col("kind") == k, (c < known[k][0]) | (c > known[k][1])), known, F)
    return df.withColumn("kind", kind).withColumn("flag", F.when(c.isNull(), MISSING).when(F.coalesce(outside, F.lit(False)), BAD).otherwise(GOOD))


def robust_bounds(df: DataFrame, name: str) -> DataFrame:
    """One row: mean, std, quartiles, median and the median absolute deviation of a column."""
    c = F.col(name)
    df = cut(df.select(c), "values")
    q = quantiles(df, c, [0.25, 0.5, 0.75])
    (mad,) = quantiles(df, F.abs(c - F.lit(q[1])), [0.5])
    fixed = [F.first(F.array(*(F.lit(x).cast("double") for x in q))).alias("q"), F.first(F.lit(mad).cast("double")).alias("mad")]
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), *fixed)


def flag(df: DataFrame, name: str, limits: tuple[float, float], dx: float = 1.0, dy: float = 1.0, z: float = 3.0, steepest: float = 5.0, jump: float = 2.0) -> DataFrame:
    """df with `flag`: limits, consensus outliers, spatial gradients, temporal jumps, missing values, in this order."""
    c = F.col(name)
    b = robust_bounds(df, name)
    d = df.join(F.broadcast(b))
    spread = F.col("q")[2] - F.col("q")[0]
    by_std = F.abs(F.try_divide(c - F.col("mean"), F.col("std"))) > z
    by_box = (c < F.col("q")[0] - 1.5 * spread) | (c > F.col("q")[2] + 1.5 * spread)
    by_mad = F.abs(F.try_divide(0.6745 * (c - F.col("q")[1]), F.col("mad"))) > z
    yes = lambda x: F.coalesce(x, F.lit(False))
    d = d.withColumn("_gx", derivative(c, along_x(), dx)).withColumn("_gy", derivative(c, along_y(), dy)).withColumn("_g", F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy")))
    d = d.withColumn("_dt", F.abs((c - F.lag(c).over(along_t())) / (F.col("time_idx") - F.lag("time_idx").over(along_t()))))
    (p95,) = quantiles(d, "_g", [0.95])
    edge = steepest if p95 is None else min(2 * p95, steepest)
    f = F.when(yes((c < limits[0]) | (c > limits[1])), BAD).otherwise(GOOD)
    f = F.when((F.col("n") >= 10) & yes(by_std) & yes(by_box) & yes(by_mad), SUSPECT).otherwise(f)
    f = F.when(yes(F.col("_g") > edge), SUSPECT).otherwise(f)
    f = F.when(yes(F.col("_dt") > jump * F.col("std")), SUSPECT).otherwise(f)
    f = F.when(c.isNull(), MISSING).otherwise(f)
    return d.withColumn("flag", f.cast("int")).select(*df.columns, "flag")


def report(flagged: DataFrame) -> DataFrame:
    """flag, n and share of all rows."""
    counts = flagged.groupBy("flag").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.join(F.broadcast(total)).select("flag", "n", (F.col("n") / F.col("_total")).alias("share"))


def repair_in_time(flagged: DataFrame, name: str) -> DataFrame:
    """Bad and missing values filled linearly along time; what was filled is flagged as interpolated."""
    return _filled(flagged, name, "time_idx", ("depth_idx", "j", "i"))


def repair_in_space(flagged: DataFrame, name: str) -> DataFrame:
    """Bad and missing values filled linearly along x and along y, averaged where both are known."""
    open_ = F.col("flag").isin(BAD, MISSING)
    d = flagged.withColumn("_known", F.when(~open_, F.col(name)))
    d = fill_gaps(d, None, "i", "_known", ("time_idx", "depth_idx", "j"), "_fx")
    d = fill_gaps(d, None, "j", "_known", ("time_idx", "depth_idx", "i"), "_fy")
    made = F.coalesce((F.col("_fx") + F.col("_fy")) / 2, F.col("_fx"), F.col("_fy"))
    return _settled(d, name, open_, made).drop("_known", "_fx", "_fy")


def _filled(flagged: DataFrame, name: str, order: str, by: tuple[str, ...]) -> DataFrame:
    open_ = F.col("flag").isin(BAD, MISSING)
    d = fill_gaps(flagged.withColumn("_known", F.when(~open_, F.col(name))), None, order, "_known", by, "_made")
    return _settled(d, name, open_, F.col("_made")).drop("_known", "_made")


def _settled(d: DataFrame, name: str, open_: Column, made: Column) -> DataFrame:
    new = F.when(open_ & made.isNotNull(), made).otherwise(F.when(~open_, F.col(name)))
    return d.withColumn("_new", new).withColumn("flag", F.when(open_ & made.isNotNull(), INTERPOLATED).otherwise(F.col("flag"))).withColumn(name, F.col("_new")).drop("_new")


def repair_by_median(flagged: DataFrame, name: str, n_x: int, n_y: int) -> DataFrame:
    """Interpolated values replaced by the median of the 3x3 square around them."""
    med = median_filter(flagged, name, n_x, n_y)
    d = flagged.join(med, ["time_idx", "depth_idx", "j", "i"])
    return d.withColumn(name, F.when(F.col("flag") == INTERPOLATED, F.coalesce("median", F.col(name))).otherwise(F.col(name))).drop("median")


def process(df: DataFrame, name: str, limits: tuple[float, float], n_x: int, n_y: int) -> DataFrame:
    """All checks, then repair in space, in time and by the median."""
    return repair_by_median(repair_in_time(repair_in_space(flag(df, name, limits), name), name), name, n_x, n_y)


def quality_mask(df: DataFrame, name: str, good: tuple[int, ...] = (GOOD,)) -> DataFrame:
    return df.withColumn(name, F.when(F.col("flag").isin(*good), F.col(name)))
