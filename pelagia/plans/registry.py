"""Actions by name, for callers that send requests: each takes a session, a table folder and parameters, and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.operators import particles, stats, stencil
from pelagia.operators.interp import Axes
from pelagia.sources import readers, sinks

Action = Callable[[DataFrame, dict[str, Any]], DataFrame]


def _axes(p: dict[str, Any]) -> Axes:
    return Axes(p["lon0"], p["lat0"], p["step"], p["n_x"], p["n_y"])


def _cropped(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    return readers.crop(df, p.get("lon_range"), p.get("lat_range"))


def _curl(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    d = stencil.with_velocity_gradients(_cropped(df, p), p["dx"], p["dy"])
    return d.withColumns({"vorticity": stencil.vorticity(), "divergence": stencil.divergence()}).select("time_idx", "depth_idx", "j", "i", "vorticity", "divergence")


def _tracked(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    starts = df.sparkSession.createDataFrame([(k, float(lon), float(lat)) for k, (lon, lat) in enumerate(p["positions"])], "id long, lon double, lat double")
    return particles.drift(df, starts, _axes(p), p["steps"], p.get("hours", 3.0), p.get("depth_idx", 0), p.get("time_idx"))


#: What each action needs besides the field: its required parameters and what it does.
ACTIONS: dict[str, tuple[tuple[str, ...], Action]] = {
    "load_field": ((), lambda df, p: readers.extent(_cropped(df, p))),
    "get_time_range": ((), lambda df, p: df.agg(F.countDistinct("time_idx").alias("steps"), F.min("time_idx").alias("first"), F.max("time_idx").alias("last"))),
    "get_statistics": ((), lambda df, p: stats.field_statistics(_cropped(df, p))),
    "calculate_flow_statistics": ((), lambda df, p: stats.flow_statistics(_cropped(df, p))),
    "calculate_vorticity_divergence": (("dx", "dy"), _curl),
    "vector_field": ((), lambda df, p: stats.with_speed(readers.strided(_cropped(df, p), p.get("skip", 1)))),
    "export_vectors": ((), lambda df, p: sinks.vector_lines(_cropped(df, p), p.get("skip", 5))),
    "animation_frames": ((), lambda df, p: stats.with_speed(df.where(F.col("time_idx") % p.get("stride", 1) == 0))),
    "track_particles": (("positions", "steps", "lon0", "lat0", "step", "n_x", "n_y"), _tracked),
    "track_statistics": (("positions", "steps", "lon0", "lat0", "step", "n_x", "n_y"), lambda df, p: stats.trajectory_statistics(_tracked(df, p))),
    "analyze_for_dispersion": ((), lambda df, p: readers.extent(df).withColumn("resolution", F.least(F.col("lat_max") - F.col("lat_min"), F.col("lon_max") - F.col("lon_min")) / 100)),
}


def run(spark: SparkSession, action: str, path: str, parameters: dict[str, Any] | None = None) -> DataFrame:
    """The result of an action on the field table at a path; unknown actions and missing parameters raise ValueError."""
    if action not in ACTIONS:
        raise ValueError(f"{action} is not one of {', '.join(ACTIONS)}")
    needed, f = ACTIONS[action]
    given = parameters or {}
    if missing := [n for n in needed if n not in given]:
        raise ValueError(f"{action} needs {', '.join(missing)}")
    return f(readers.read_field(spark, path), given)
