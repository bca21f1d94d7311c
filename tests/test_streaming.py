"""Streams over files give the batch's numbers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pelagia.sources import views
from pelagia.streaming import events


@pytest.fixture
def stream(spark, sf, tmp_path):
    views.series(spark, sf).select("key", "ts", "value").repartition(3).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema("key string, ts timestamp, value double").parquet(f"{tmp_path}/in")


def drained(spark, df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_windows_equal_the_batch(spark, sf, stream, tmp_path):
    got = drained(spark, events.windowed_statistics(stream, width="1 day"), "windows", "complete", tmp_path)
    want = views.series(spark, sf).groupBy(F.window("ts", "1 day")["start"].alias("start"), "key").agg(F.count("value").alias("n"))
    assert {(r["start"], r["key"]): r["n"] for r in got.collect()} == {(r["start"], r["key"]): r["n"] for r in want.collect()}


def test_flags_and_filter_state(spark, sf, stream, tmp_path):
    flags = drained(spark, events.flagged(stream, (0.0, 1e9)), "flags", "append", tmp_path)
    assert flags.where("flag = 3").count() == views.series(spark, sf).where("value IS NULL").count()
    kept = drained(spark, events.assimilated(stream, 100.0, 0.0, 1.0), "kept", "update", tmp_path)
    last = kept.groupBy("key").agg(F.max("n").alias("n"))
    assert {r["key"]: r["n"] for r in last.collect()} == {r["key"]: r["n"] for r in views.series(spark, sf).groupBy("key").agg(F.count("value").alias("n")).collect()}
