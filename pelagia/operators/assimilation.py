"""Setting up and watching an ensemble filter: settings, the first ensemble, consistency, saved states."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.operators.ensemble import mean_and_spread, spread

#: The ranges that settings must lie in (above the first, up to the second), and the spreads of a sound
#: ensemble and of one that has not diverged.
RANGES = {"ensemble_size": (0, 1000), "localization_radius": (0.0, 1_000_000.0), "regularization": (0.0, 1e-6)}
INFLATION = (1.0, 3.0)
SOUND_SPREAD = (1e-10, 100.0)
STEADY_SPREAD = (1e-8, 1000.0)


@dataclass(frozen=True)
class Settings:
    """Settings of a filter with their defaults; any mapping's known keys can be read into them."""

    ensemble_size: int = 50
    localization_radius: float = 100_000.0
    inflation: float = 1.02
    regularization: float = 1e-8

    @classmethod
    def read(cls, given: dict) -> Settings:
        """The defaults with what is given; unknown keys are left out, null means the default."""
        return cls(**{k: v for k, v in given.items() if k in cls.__dataclass_fields__ and v is not None})

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, section: str | None = None) -> Settings:
        """read() of a YAML or JSON file, or of one of its sections, from wherever Spark can read; a missing section is empty.

        JSON is YAML, so one reader serves both; without a YAML library only JSON is read."""
        text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
        try:
            from yaml import safe_load as parsed
        except ImportError:
            from json import loads as parsed
        held = parsed(text) or {}
        if not isinstance(held, dict):
            raise ValueError(f"{path} holds no settings by name")
        return cls.read((held.get(section) or {}) if section else held)

    def faults(self) -> list[str]:
        """The names of the settings that are out of range."""
        out = [k for k, (lo, hi) in RANGES.items() if not lo < getattr(self, k) <= hi]
        return out if INFLATION[0] <= self.inflation <= INFLATION[1] else [*out, "inflation"]


def initial_ensemble(mean: DataFrame, covariance: DataFrame, members: int, seed: int = 7) -> DataFrame:
    """member, block, cell, x: normal draws around mean (block, cell, mean) with each block's covariance (block, r, c, covariance).

    The covariance holds r <= c and is symmetric; pairs that it leaves out are zero. One task factors one block's matrix,
    whose cells must fit a task; a block whose matrix is not positive definite is an error. Reruns agree."""

    def drawn(key: tuple, m: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        m = m.sort_values("cell")
        at = {c: k for k, c in enumerate(m["cell"])}
        full = np.zeros((len(m), len(m)))
        for a, b, v in zip(p["r"], p["c"], p["covariance"], strict=True):
            if a in at and b in at:
                full[at[a], at[b]] = full[at[b], at[a]] = v
        noise = np.random.default_rng([seed, int(key[0])]).standard_normal((len(m), members))
        x = m["mean"].to_numpy()[:, None] + np.linalg.cholesky(full) @ noise
        return pd.DataFrame({"member": np.tile(np.arange(members, dtype=np.int32), len(m)), "block": key[0], "cell": np.repeat(m["cell"].to_numpy(), members), "x": x.reshape(-1)})

    p = covariance.select(*(F.col(c).alias(c) for c in ("block", "r", "c", "covariance")))  # both may come from one table
    grouped = mean.select("block", "cell", "mean").groupBy("block").cogroup(p.groupBy("block"))
    return grouped.applyInPandas(drawn, "member int, block long, cell int, x double")


def consistency(ens: DataFrame, limits: tuple[float, float]) -> DataFrame:
    """By block: n_invalid values (outside the limits or null), spread, consistent and diverged."""
    bad = ens.groupBy("block").agg(F.count_if(~F.coalesce(F.col("x").between(*limits), F.lit(False))).alias("n_invalid"))
    d = bad.join(spread(ens).select("block", "spread"), "block")
    sound = (F.col("n_invalid") == 0) & F.col("spread").between(*SOUND_SPREAD)
    return d.select("block", "n_invalid", "spread", sound.alias("consistent"), (~F.col("spread").between(*STEADY_SPREAD)).alias("diverged"))


def increment_norms(before: DataFrame, after: DataFrame) -> DataFrame:
    """By block: the Euclidean norm of the change of the ensemble's mean."""
    a, b = (mean_and_spread(d).select("block", "cell", F.col("mean").alias(n)) for d, n in ((after, "_a"), (before, "_b")))
    change = F.col("_a") - F.col("_b")
    return a.join(b, ["block", "cell"]).groupBy("block").agg(F.sqrt(F.sum(change * change)).alias("norm"))


def positive_definite(covariance: DataFrame) -> DataFrame:
    """block, smallest eigenvalue and whether all are positive, of matrices given as (block, r, c, covariance), r <= c."""

    def judged(p: pd.DataFrame) -> pd.DataFrame:
        cells = np.unique(np.concatenate([p["r"], p["c"]]))
        full = np.zeros((len(cells), len(cells)))
        a, b = np.searchsorted(cells, p["r"]), np.searchsorted(cells, p["c"])
        full[a, b] = full[b, a] = p["covariance"]
        least = float(np.linalg.eigvalsh(full)[0])
        return pd.DataFrame({"block": [p["block"].iloc[0]], "least": [least], "positive": [least > 0]})

    return covariance.select("block", "r", "c", "covariance").groupBy("block").applyInPandas(judged, "block long, least double, positive boolean")


def save_state(ens: DataFrame, settings: Settings, cycle: int, path: str) -> None:
    """The ensemble with the settings and the number of cycles, as Parquet by cycle; a cycle that is saved again is replaced."""
    kept = ens.withColumns({k: F.lit(v) for k, v in vars(settings).items()})
    kept.write.mode("overwrite").parquet(f"{path.rstrip('/')}/cycle={cycle}")


def load_state(spark: SparkSession, path: str) -> tuple[DataFrame, Settings, int]:
    """The ensemble, settings and number of the last cycle under path."""
    d = spark.read.parquet(path)
    cycle = d.agg(F.max("cycle")).first()[0]
    last = d.where(F.col("cycle") == cycle)
    names = list(Settings.__dataclass_fields__)
    settings = Settings(**last.select(*names).first().asDict())
    return last.drop("cycle", *names), settings, int(cycle)
