"""Writing results: CSV, JSON, GeoJSON, VTK text and Parquet, and the texts behind them."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pelagia.functions.mathx import speed
from pelagia.schema import finite_columns


def fixed(c: Column, digits: int = 6) -> Column:
    """A number as text with a fixed number of decimals; null stays null."""
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c))


def vector_lines(df: DataFrame, skip: int = 5) -> DataFrame:
    """GeoJSON text of every skip-th wet cell: a line along the current, with speed and direction."""
    d = df.where((F.col("i") % skip == 0) & (F.col("j") % skip == 0) & F.expr("water_u IS NOT NULL AND water_v IS NOT NULL"))
    point = lambda x, y: F.array(F.round(x, 6), F.round(y, 6))
    line = F.array(point(F.col("lon"), F.col("lat")), point(F.col("lon") + F.col("water_u"), F.col("lat") + F.col("water_v")))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry"),
        F.struct(F.round(speed(F.col("water_u"), F.col("water_v")), 6).alias("speed"), F.round(F.degrees(F.atan2("water_v", "water_u")), 6).alias("direction")).alias("properties"),
    )
    return d.select("time_idx", "j", "i", F.to_json(feature).alias("value"))


def track_lines(track: DataFrame) -> DataFrame:
    """CSV text of trajectories: id, step, lon, lat with six decimals."""
    return track.select("id", "step", F.concat_ws(",", F.col("id").cast("string"), F.col("step").cast("string"), fixed(F.col("lon")), fixed(F.col("lat"))).alias("value"))


def track_paths(track: DataFrame) -> DataFrame:
    """JSON text of each particle's path in the order of its steps."""
    path = F.transform(F.array_sort(F.collect_list(F.struct("step", "lon", "lat"))), lambda s: F.array(F.round(s["lon"], 6), F.round(s["lat"], 6)))
    return track.groupBy("id").agg(F.to_json(F.struct(F.first("id").alias("id"), path.alias("path"))).alias("value"))


def matrix_lines(df: DataFrame, name: str, by: list[str]) -> DataFrame:
    """One text line for each j: the row's values in the order of i, an empty field for null."""
    row = F.array_sort(F.collect_list(F.struct("i", F.coalesce(fixed(F.col(name)), F.lit("")).alias("v"))))
    return df.groupBy(*by, "j").agg(F.array_join(F.transform(row, lambda r: r["v"]), ",").alias("value"))


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON with nulls kept and NaN as null."""
    clean = finite_columns(df)
    return clean.select(F.to_json(F.struct(*clean.columns), {"ignoreNullFields": "false"}).alias("value"))


def vtk_points(track: DataFrame) -> DataFrame:
    """The point lines of a VTK polydata text."""
    return track.select(F.concat_ws(" ", fixed(F.col("lon")), fixed(F.col("lat")), F.lit("0.000000")).alias("value"))


def vtk_grid_header(n_x: int, n_y: int, n_z: int, name: str, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> list[str]:
    return ["# vtk DataFile Version 3.0", name, "ASCII", "DATASET STRUCTURED_POINTS", f"DIMENSIONS {n_x} {n_y} {n_z}", "ORIGIN 0 0 0", "SPACING {} {} {}".format(*spacing), f"POINT_DATA {n_x * n_y * n_z}", f"SCALARS {name} double 1", "LOOKUP_TABLE default"]


#: How each format is written; Parquet also stands for the binary and array formats.
WRITERS = {
    "parquet": lambda w, path: w.parquet(path),
    "csv": lambda w, path: w.option("header", True).csv(path),
    "json": lambda w, path: w.json(path),
    "text": lambda w, path: w.text(path),
    "orc": lambda w, path: w.orc(path),
}


def write(df: DataFrame, path: str, fmt: str = "parquet", variables: list[str] | None = None, partition_by: list[str] | None = None) -> None:
    """A table, or some of its columns, in one of the formats of WRITERS; existing files are an error."""
    if fmt not in WRITERS:
        raise ValueError(f"{fmt} is not one of {', '.join(WRITERS)}")
    w = (df.select(*variables) if variables else df).write
    WRITERS[fmt](w.partitionBy(*partition_by) if partition_by else w, path)


def file_name(base: str, fmt: str, prefix: str = "export") -> Column:
    """prefix_base_timestamp.ext"""
    return F.concat(F.lit(f"{prefix}_{base}_"), F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss_SSS"), F.lit(f".{fmt}"))


class Export:
    """A folder of exported fields, snapshots and series, with metadata for all of it and counts of what was written.

    Every table goes out in one job, whose rows are counted on the way; metadata is a file of its own beside the tables
    and goes into the columns' own metadata where the format keeps it (Parquet)."""

    #: The coordinate systems by name, with their codes and the units of their axes.
    SYSTEMS = {"geographic": ("EPSG:4326", "degrees"), "mercator": ("EPSG:3857", "metres"), "cartesian": ("", "metres")}

    def __init__(self, spark: SparkSession, folder: str, fmt: str = "parquet") -> None:
        if fmt not in WRITERS:
            raise ValueError(f"{fmt} is not one of {', '.join(WRITERS)}")
        self.spark, self.folder, self.fmt = spark, folder.rstrip("/"), fmt
        self.metadata: dict[str, str] = {}
        self.written: list[dict] = []

    def add_metadata(self, **given: str) -> Export:
        self.metadata |= {k: str(v) for k, v in given.items()}
        return self

    def set_coordinate_system(self, name: str) -> Export:
        """Name the coordinate system of all tables; one that is not in SYSTEMS is an error."""
        code, units = self.SYSTEMS[name]
        return self.add_metadata(coordinate_system=name, coordinate_code=code, coordinate_units=units)

    def _write(self, df: DataFrame, name: str, kind: str, partition_by: list[str] | None = None, units: dict[str, str] | None = None) -> str:
        for c, unit in (units or {}).items():
            df = df.withMetadata(c, {"units": unit, **self.metadata})
        seen, path = Observation(), f"{self.folder}/{name}"
        write(df.observe(seen, F.count("*").alias("rows")), path, self.fmt, partition_by=partition_by)
        self.written.append({"name": name, "kind": kind, "format": self.fmt, "rows": seen.get["rows"]})
        return path

    def scalar_field_3d(self, df: DataFrame, name: str, units: str = "") -> str:
        """A column on all cells, depths and times, one folder a time; returns the path."""
        return self._write(df.select("time_idx", "depth_idx", "j", "i", name), name, "scalar field", ["time_idx"], {name: units})

    def vector_field_3d(self, df: DataFrame, name: str, parts: tuple[str, ...] = ("u", "v", "w"), units: str = "m/s") -> str:
        """Several columns of a vector on all cells with its length, one folder a time; nulls have no length."""
        length = F.sqrt(sum((F.col(c) * F.col(c) for c in parts), F.lit(0.0)))
        made = df.select("time_idx", "depth_idx", "j", "i", *parts, length.alias("magnitude"))
        return self._write(made, name, "vector field", ["time_idx"], dict.fromkeys((*parts, "magnitude"), units))

    def particle_snapshot(self, particles: DataFrame, name: str, time: float) -> str:
        """All particles at one time, with that time as a column."""
        return self._write(particles.withColumn("time", F.lit(float(time))), f"{name}-{time:g}", "particles")

    def time_series(self, steps: Iterable[tuple[int, DataFrame]], name: str) -> str:
        """The tables of a run's steps, each in its own folder of one table; each step is written as it comes."""
        for k, df in steps:
            self._write(df, f"{name}/step={k}", "step")
        return f"{self.folder}/{name}"

    def batch(self, tables: dict[str, DataFrame]) -> list[str]:
        """Several tables under their names."""
        return [self._write(df, name, "table") for name, df in tables.items()]

    def stats(self) -> dict[str, int]:
        """Tables and rows written since the start or the last reset()."""
        return {"tables": len(self.written), "rows": sum(w["rows"] for w in self.written)}

    def reset(self) -> None:
        self.written = []

    def close(self) -> str:
        """Write the metadata and what was written as one JSON text beside the tables."""
        text = json.dumps({"metadata": self.metadata, "tables": self.written}, sort_keys=True)
        path = f"{self.folder}/_metadata.json"
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
        return path
