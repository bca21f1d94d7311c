"""Schemas of the long-format tables, and the rule that a missing or non-finite number is NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("time_idx", "depth_idx", "j", "i")

FIELD = "time_idx int, depth_idx int, j int, i int, lat double, lon double, water_u double, water_v double"
SERIES = "key string, idx long, ts timestamp, value double"
PARTICLE = "id long, lon double, lat double"
OBS = "obs_id long, obs_type string, i int, j int, value double, err_var double, ts timestamp"
ENSEMBLE = "member int, block long, cell int, x double"


def finite(c: Column) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def finite_columns(df: DataFrame) -> DataFrame:
    """df with every float and double column passed through finite()."""
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: finite(F.col(c)) for c in wide}) if wide else df


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, with minus zero as zero, so that two engines' results can be compared."""
    return F.round(c, digits) + F.lit(0.0)
