"""Streams of forecasts and observations with late and missing batches equal the batch run; the multitaper spectrum."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.operators import particles, series
from pelagia.streaming import cycles

T0 = dt.datetime(2024, 1, 1)
FORECAST, OBS = "key string, ts timestamp, drift double, noise double", "key string, ts timestamp, y double, r double"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_streamed_cycles_equal_the_batch_run(spark, tmp_path):
    rng = np.random.default_rng(1)
    forecasts = [[(k, at(10 * c), float(c) * 0.1, 0.2) for k in "ab"] for c in range(12)]
    # key b has no observations in cycles 3 to 5; two observations of cycle 2 come a batch later; one comes far too late
    seen = [[(k, at(10 * c + m), float(rng.normal()), 0.5) for k in "ab" for m in (1, 6) if not (k == "b" and 3 <= c <= 5)] for c in range(12)]
    delayed, seen[2] = seen[2][:2], seen[2][2:]
    seen[3] = seen[3] + delayed
    dropped = [("a", at(5), 100.0, 0.5)]
    for name, batches, schema in (("f", forecasts, FORECAST), ("o", [*seen[:9], seen[9] + dropped, *seen[10:]], OBS)):
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / f"part={n:02d}"))
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "*"))
    stream = cycles.cycled(cycles.joined(read("f", FORECAST), read("o", OBS), "10 MINUTES", "15 minutes"), (0.0, 1.0))
    query = stream.writeStream.format("memory").queryName("analysed").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = {(r.key, r.cycle): (r.forecast, r.analysis, r.variance, r.n_obs) for r in spark.table("analysed").collect()}
    flat = lambda b, s: spark.createDataFrame([r for rows in b for r in rows], s)
    f, o = flat(forecasts, FORECAST), flat(seen, OBS)
    batch = cycles.in_batch(cycles.joined(f, o, "10 MINUTES", "15 minutes"), (0.0, 1.0))
    want = {(r.key, r.cycle): (r.forecast, r.analysis, r.variance, r.n_obs) for r in batch.collect()}
    assert len(want) == 24
    # the last cycles may still get observations when the streams end, so they are open; no closed one is missing
    closed = {k for k in want if k[1] <= at(70)}
    assert closed <= set(got) <= set(want)
    for k, v in got.items():
        assert got[k][3] == want[k][3] and np.allclose(v, want[k]), k
    assert want["b", at(40)][3] == 0 and want["a", at(20)][3] == 2


def test_prolate_tapers_equal_a_dense_eigenproblem():
    for n in (50, 300, 1200):
        place = np.arange(n)
        t = np.diag(((n - 1 - 2 * place) / 2.0) ** 2 * np.cos(2 * np.pi * 4 / n))
        side = place[1:] * (n - place[1:]) / 2.0
        _, vectors = np.linalg.eigh(t + np.diag(side, 1) + np.diag(side, -1))
        got = series.prolate_tapers(n)
        assert np.allclose(got @ got.T, np.eye(7), atol=1e-10)
        assert np.allclose(np.abs((got * vectors[:, ::-1][:, :7].T).sum(axis=1)), 1, atol=1e-9)


def test_multitaper_spectrum_keeps_power_and_finds_a_sine(spark):
    n = 512
    d = spark.range(n).selectExpr("'s' AS key", "id AS idx", "3 * sin(2 * pi() * id * 40 / 512) + 1 AS value")
    rows = series.spectrum(d, 1.0, "multitaper").orderBy("frequency").collect()
    power = np.array([r.power for r in rows])
    assert abs(power.sum() / n - 4.5) < 0.05
    assert abs(rows[int(np.argmax(power))].frequency - 40 / n) <= 4 / n
    assert power[np.abs(np.arange(n // 2 + 1) - 40) > 12].max() < power.max() * 1e-3
    with pytest.raises(ValueError):
        series.spectrum(d, 1.0, "other")


def test_random_walks_are_normal_and_do_not_depend_on_partitions(spark):
    p = spark.range(20_000).selectExpr("id", "0D AS x", "0D AS y")
    walk = lambda d, step=0: particles.random_walk(d, ["x", "y"], 0.5, 4.0, step=step)
    m = walk(p).agg(F.avg("x"), F.stddev("x"), F.stddev("y"), F.corr("x", "y"), F.kurtosis("x")).first()
    assert abs(m[0]) < 0.06 and abs(m[1] - 2) < 0.04 and abs(m[2] - 2) < 0.04 and abs(m[3]) < 0.03 and abs(m[4]) < 0.15
    assert sorted(walk(p).limit(20_000).collect()) == sorted(walk(p.repartition(7)).collect())
    assert walk(p).first().x != walk(p, 1).first().x
