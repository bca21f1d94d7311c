"""Exports of fields, snapshots and series with metadata and counts; settings from files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pelagia.operators.assimilation import Settings
from pelagia.sources import generators, sinks


def test_exports_are_read_again_with_counts_and_metadata(spark, tmp_path):
    out = sinks.Export(spark, str(tmp_path / "out")).add_metadata(title="a run").set_coordinate_system("geographic")
    d = generators.cells(spark, 3, 2, 2, 2).withColumns({"u": F.lit(3.0), "v": F.when(F.col("i") > 0, F.lit(4.0)), "w": F.lit(0.0)})
    vectors = spark.read.parquet(out.vector_field_3d(d, "current"))
    assert vectors.count() == 24 and vectors.where("magnitude = 5").count() == 16 and vectors.where("magnitude IS NULL").count() == 8
    assert vectors.schema["magnitude"].metadata["units"] == "m/s" and vectors.schema["u"].metadata["coordinate_code"] == "EPSG:4326"
    assert spark.read.parquet(out.scalar_field_3d(d, "u", "m/s")).agg(F.sum("u")).first()[0] == 72.0
    p = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id long, lon double")
    assert spark.read.parquet(out.particle_snapshot(p, "cloud", 1.5)).where("time = 1.5").count() == 2
    series = spark.read.parquet(out.time_series(((k, p.withColumn("lon", F.col("lon") + k)) for k in (0, 2)), "run"))
    assert sorted((r.step, r.lon) for r in series.collect()) == [(0, 2.0), (0, 3.0), (2, 4.0), (2, 5.0)]
    assert len(out.batch({"one": p, "none": p.limit(0)})) == 2
    assert out.stats() == {"tables": 7, "rows": 24 + 24 + 2 + 4 + 2}
    held = json.loads(spark.read.text(out.close()).first().value)
    assert held["metadata"]["title"] == "a run" and [t["rows"] for t in held["tables"]] == [24, 24, 2, 2, 2, 2, 0]
    out.reset()
    assert out.stats() == {"tables": 0, "rows": 0}


def test_unknown_formats_and_systems_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.Export(spark, str(tmp_path), "netcdf")
    with pytest.raises(KeyError):
        sinks.Export(spark, str(tmp_path)).set_coordinate_system("flat")


def test_settings_come_from_yaml_and_json_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("filter:\n  ensemble_size: 20\n  inflation: 1.05\n  other: x\nempty:\n")
    (tmp_path / "b.json").write_text('{"ensemble_size": 30, "localization_radius": null}')
    (tmp_path / "c.json").write_text("[1, 2]")
    assert Settings.from_file(spark, str(tmp_path / "a.yaml"), "filter") == Settings(ensemble_size=20, inflation=1.05)
    assert Settings.from_file(spark, str(tmp_path / "a.yaml"), "empty") == Settings.from_file(spark, str(tmp_path / "a.yaml"), "absent") == Settings()
    assert Settings.from_file(spark, str(tmp_path / "b.json")) == Settings(ensemble_size=30)
    with pytest.raises(ValueError):
        Settings.from_file(spark, str(tmp_path / "c.json"))
