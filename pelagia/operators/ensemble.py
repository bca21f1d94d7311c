"""Ensembles and their assimilation: moments, localised covariance, inflation, forecast, analysis.

An ensemble has member, block (an independent region), cell and x. Regions are independent, so analyses run as one task
for each region; covariances over many cells use the cell-binned range join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.functions import ocean


@dataclass(frozen=True)
class Operator:
    """An observation operator: what a state would show, and whether an observation can be true."""

    apply: Callable[[str], Column]
    valid: Callable[[Column], Column]


#: Observed quantities with their valid ranges.
OPERATORS = {
    "sla": Operator(lambda c: F.col(c), lambda y: F.abs(y) <= 2.0),
    "sst": Operator(lambda c: F.col(c), lambda y: y.between(-2.0, 35.0)),
    "ice": Operator(lambda c: F.col(c), lambda y: y.between(0.0, 1.0)),
}


def observation_validity(obs: DataFrame) -> DataFrame:
    """By obs_type: n, valid ones and whether all are."""
    ok = F.lit(False)
    for kind, op in OPERATORS.items():
        ok = ok | ((F.col("obs_type") == kind) & op.valid(F.col("value")))
    return obs.groupBy("obs_type").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_valid"), F.every(ok).alias("all_valid"))


def mean_and_spread(ens: DataFrame) -> DataFrame:
    """By block and cell: mean, sample variance, and sample standard deviation over the members."""
    return ens.groupBy("block", "cell").agg(F.avg("x").alias("mean"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("variance"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std"))


def spread(ens: DataFrame) -> DataFrame:
    """By block: the root of the mean squared deviation from the cells' means, and the root mean square of the means."""
    w = Window.partitionBy("block", "cell")
    d = ens.withColumn("m", F.avg("x").over(w))
    return d.groupBy("block").agg(F.sqrt(F.avg((F.col("x") - F.col("m")) * (F.col("x") - F.col("m")))).alias("spread"), F.sqrt(F.avg(F.col("m") * F.col("m"))).alias("mean_norm"))


def deviations(ens: DataFrame) -> DataFrame:
    return ens.withColumn("d", F.col("x") - F.avg("x").over(Window.partitionBy("block", "cell")))


def covariance(ens: DataFrame, radius: float, spacing: float = 1.0) -> DataFrame:
    """block, r, c, covariance times the Gaspari-Cohn weight, for cells up to twice the radius apart.

    Cells meet by bins of that width and the next bin, so far pairs are never formed."""
    reach = 2 * radius
    d = deviations(ens).select("block", "member", "cell", "d")
    bin_ = F.floor(F.col("cell") * spacing / reach)
    left = d.select("block", "member", F.col("cell").alias("r"), F.col("d").alias("dr"), F.explode(F.array(bin_, bin_ + 1)).alias("b"))
    right = d.select("block", "member", F.col("cell").alias("c"), F.col("d").alias("dc"), bin_.alias("b"))
    n = ens.select("member").distinct().agg(F.count("*").alias("n"))
    far = (F.col("c") - F.col("r")) * spacing
    sums = left.join(right, ["block", "member", "b"]).where((far >= 0) & (far <= reach)).groupBy("block", "r", "c").agg(F.sum(F.col("dr") * F.col("dc")).alias("s"))
    weight = ocean.gaspari_cohn((F.col("c") - F.col("r")) * spacing / radius)
    return sums.join(F.broadcast(n)).select("block", "r", "c", (F.col("s") / (F.col("n") - 1) * weight).alias("covariance"))


def inflate(ens: DataFrame, factor: float) -> DataFrame:
    """Deviations from the mean times a factor."""
    m = F.avg("x").over(Window.partitionBy("block", "cell"))
    return ens.withColumn("_m", m).withColumn("x", F.col("_m") + factor * (F.col("x") - F.col("_m"))).drop("_m")


def relax(before: DataFrame, after: DataFrame, share: float) -> DataFrame:
    """Analysis deviations pulled back towards the forecast's by a share."""
    b, a = deviations(before).select("block", "cell", "member", F.col("d").alias("_b")), deviations(after).withColumn("_m", F.col("x") - F.col("d"))
    return a.join(b, ["block", "cell", "member"]).withColumn("x", F.col("_m") + (1 - share) * F.col("d") + share * F.col("_b")).select(*after.columns)


def adaptive_factor(innovation_variance: Column, spread_variance: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(2.0), F.coalesce(F.try_divide(innovation_variance, spread_variance), F.lit(1.0))))


def forecast(states: DataFrame, dt: float) -> DataFrame:
    """A step of the simple model: temperature, salinity, u, v, eta; values are kept physical.

    Temperature and salinity relax to 15 and 35 and fade with the speed; eta drives the velocity and fades with it."""
    s = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    d = states.withColumn("_s", s)
    new = {
        "temperature": F.col("temperature") + dt * (0.001 * (15.0 - F.col("temperature")) - 0.01 * F.col("_s") * F.col("temperature")),
        "salinity": F.col("salinity") + dt * (0.0005 * (35.0 - F.col("salinity")) - 0.005 * F.col("_s") * F.col("salinity")),
        "u": F.col("u") - dt * ocean.GRAVITY * 1e-4 * F.col("eta"),
        "v": F.col("v") + dt * ocean.GRAVITY * 1e-4 * F.col("eta"),
    }
    d = d.withColumns(new)
    d = d.withColumn("eta", F.col("eta") - dt * 0.01 * F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")))
    uv = ocean.constrained_velocity(F.col("u"), F.col("v"))
    return d.withColumns({"temperature": ocean.constrained("temperature", F.col("temperature")), "salinity": ocean.constrained("salinity", F.col("salinity")), "_uv": uv}).withColumns({"u": F.col("_uv.u"), "v": F.col("_uv.v")}).select(*states.columns)


def scalar_analysis(ens: DataFrame, obs: DataFrame) -> DataFrame:
    """Each observed cell updated by its own observation, without perturbations: x + K·(y - x), K = P / (P + R).

    obs: block, cell, y, r (error variance); cells without one stay as they are."""
    p = F.coalesce(F.var_samp("x").over(Window.partitionBy("block", "cell")), F.lit(0.0))
    d = ens.withColumn("_p", p).join(obs.select("block", "cell", "y", "r"), ["block", "cell"], "left")
    gain = F.try_divide(F.col("_p"), F.col("_p") + F.col("r"))
    return d.withColumn("x", F.coalesce(F.col("x") + gain * (F.col("y") - F.col("x")), F.col("x"))).select(*ens.columns)


def analysis(ens: DataFrame, obs: DataFrame, radius: float, seed: int = 7, ridge: float = 1e-8) -> DataFrame:
    """The stochastic analysis of each block with localised covariance and perturbed observations, one task for a block.

    The gain uses the forecast's covariance; a block holds one region's cells, whose dense matrices must fit a task."""

    def one_block(key: tuple, e: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        x = e.pivot(index="cell", columns="member", values="x")
        if not len(o) or not len(x):
            return e
        cells, m = x.index.to_numpy(), x.to_numpy()
        dev = m - m.mean(axis=1, keepdims=True)
        p = dev @ dev.T / max(1, m.shape[1] - 1) * _gaspari_cohn(np.abs(cells[:, None] - cells[None, :]) / radius)
        at = np.searchsorted(cells, o["cell"].to_numpy())
        r = np.diag(o["r"].to_numpy())
        gain = p[:, at] @ np.linalg.pinv(p[np.ix_(at, at)] + r + ridge * np.eye(len(at)), rcond=1e-10)
        rng = np.random.default_rng([seed, int(key[0])])
        noise = rng.standard_normal((len(at), m.shape[1])) * np.sqrt(o["r"].to_numpy())[:, None]
        noise -= noise.mean(axis=1, keepdims=True)
        new = pd.DataFrame(m + gain @ (o["y"].to_numpy()[:, None] + noise - m[at]), index=x.index, columns=x.columns)
        return new.stack().rename("x").reset_index().assign(block=key[0])[["member", "block", "cell", "x"]]

    grouped = ens.select("member", "block", "cell", "x").groupBy("block").cogroup(obs.select("block", "cell", "y", "r").groupBy("block"))
    return grouped.applyInPandas(one_block, "member int, block long, cell int, x double")


def _gaspari_cohn(r: np.ndarray) -> np.ndarray:
    near = (((-0.25 * r + 0.5) * r + 0.625) * r - 5 / 3) * r * r + 1
    with np.errstate(divide="ignore"):
        far = ((((r / 12 - 0.5) * r + 0.625) * r + 5 / 3) * r - 5) * r + 4 - 2 / (3 * r)
    return np.where(r <= 1, near, np.where(r <= 2, far, 0.0))


def quality(mean: DataFrame, truth: DataFrame) -> DataFrame:
    """RMSE, correlation and bias of a mean (block, cell, mean) against the truth (block, cell, y)."""
    d = mean.join(truth, ["block", "cell"])
    e = F.col("mean") - F.col("y")
    return d.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.corr("mean", "y").alias("correlation"), F.avg(e).alias("bias"), F.count("*").alias("n"))


def merged_observations(obs: DataFrame) -> DataFrame:
    """One observation for each block and cell: all of a cell weighed by their precision, which is exact for one state."""
    known = obs.where("y IS NOT NULL AND r > 0")
    total = F.sum(1 / F.col("r"))
    return known.groupBy("block", "cell").agg((F.sum(F.col("y") / F.col("r")) / total).alias("y"), (1 / total).alias("r"))


def local_analysis(ens: DataFrame, obs: DataFrame, radius: float, spacing: float = 1.0, cells_per_task: int = 4096) -> DataFrame:
    """The deterministic analysis of each cell from the observations around it, in the space of the members.

    An observation's precision fades with distance by the Gaspari-Cohn weight, to nothing at twice the radius. Cells are
    cut into bins; an observation goes to every bin that it reaches, so a task holds a bin's cells and the observations
    in reach of it, and solves a members-by-members system for each cell: no matrix of cells by cells exists. Several
    observations of a cell are merged first, so a bin has no more of them than it reaches cells. ens: member, block,
    cell, x, every cell with all members; obs: block, cell, y, r. Cells without an observation in reach stay."""
    reach = 2 * radius / spacing
    width = max(1, int(min(cells_per_task, max(reach, 64))))
    states = ens.groupBy("block", "cell").agg(F.array_sort(F.collect_list(F.struct("member", "x"))).alias("m"))
    states = states.select("block", "cell", F.transform("m", lambda s: s["member"]).alias("members"), F.transform("m", lambda s: s["x"]).alias("xs"))
    seen = merged_observations(obs).join(states.select("block", "cell", F.col("xs").alias("hx")), ["block", "cell"])
    bins = F.sequence(F.floor((F.col("cell") - reach) / width), F.floor((F.col("cell") + reach) / width))
    spread_obs = seen.withColumn("bin", F.explode(bins)).select("block", "bin", F.col("cell").alias("at"), "y", "r", "hx")
    dealt = states.withColumn("bin", F.floor(F.col("cell") / width))

    def one_bin(cells: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(cells):  # observations reach past the cells
            return cells[["block", "cell", "members", "xs"]]
        x = np.array(cells["xs"].tolist(), dtype=float)
        if len(near) and x.shape[1] > 1:
            at, y, r = (near[c].to_numpy(float) for c in ("at", "y", "r"))
            hx = np.array(near["hx"].tolist(), dtype=float)
            place = cells["cell"].to_numpy(float)
            for k in range(0, len(x), 256):
                weights = _gaspari_cohn(np.abs(place[k : k + 256, None] - at[None, :]) * spacing / radius) / r
                x[k : k + 256] = _in_member_space(x[k : k + 256], hx, y, weights)
        return cells[["block", "cell", "members"]].assign(xs=list(x))

    kinds = dict(ens.dtypes)
    made = dealt.groupBy("block", "bin").cogroup(spread_obs.groupBy("block", "bin")).applyInPandas(
        one_bin, f"block {kinds['block']}, cell {kinds['cell']}, members array<{kinds['member']}>, xs array<double>"
    )
    rows = made.select("block", "cell", F.explode(F.arrays_zip("members", "xs")).alias("z"))
    return rows.select(F.col("z.members").alias("member"), "block", "cell", F.col("z.xs").alias("x")).select(*(c for c in ens.columns if c in ("member", "block", "cell", "x")))


def _in_member_space(x: np.ndarray, hx: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Members (cells, k) after the analysis with observations y, whose members are hx (observations, k).

    weights: each cell's precision of each observation. The square root is the symmetric one, which keeps the mean."""
    k = x.shape[1]
    dx, dy, innovation = x - x.mean(axis=1, keepdims=True), hx - hx.mean(axis=1, keepdims=True), y - hx.mean(axis=1)
    pairs = (dy[:, :, None] * dy[:, None, :]).reshape(len(dy), -1)
    precision = (weights @ pairs).reshape(-1, k, k) + (k - 1) * np.eye(k)
    values, vectors = np.linalg.eigh(precision)
    pull = np.einsum("cp,pk->ck", weights * innovation, dy)
    turned = np.einsum("ckm,ck->cm", vectors, pull) / values
    mean = np.einsum("ckm,cm->ck", vectors, turned)
    root = np.einsum("ckm,cm,clm->ckl", vectors, np.sqrt((k - 1) / values), vectors)
    new = x.mean(axis=1, keepdims=True) + np.einsum("ck,ckl->cl", dx, root + mean[:, :, None])
    return np.where((weights > 0).any(axis=1)[:, None], new, x)
