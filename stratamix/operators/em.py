"""Weighted EM on representatives: each step is one job that reduces partitions to sums for each component, and may be kept in a journal."""

from __future__ import annotations

import json
import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normal import log_normal

log = logging.getLogger(__name__)
RIDGE = 0.01
#: Representatives in a partition of a step, so that few rows of sums reach the driver.
REPRESENTATIVES = 10_000


@dataclass
class Mixture:
    params: list[str]
    pro: np.ndarray  # (K,)
    mean: np.ndarray  # (K, d)
    cov: np.ndarray  # (K, d, d)

    def log_weighted(self, x: np.ndarray) -> np.ndarray:
        """ln pro + ln density: rows of x by component."""
        return np.stack([np.log(max(p, 1e-300)) + log_normal(x, m, c) for p, m, c in zip(self.pro, self.mean, self.cov, strict=True)], axis=1)

    @classmethod
    def collect(cls, table: DataFrame, params: list[str]) -> Mixture:
        """From (component, pro, mean, cov) with flat covariances; shares are normalised."""
        rows = table.orderBy("component").collect()  # K rows
        d = len(params)
        pro = np.array([r.pro for r in rows], float)
        return cls(list(params), pro / pro.sum(), np.array([r.mean for r in rows], float).reshape(-1, d), np.array([r["cov"] for r in rows], float).reshape(-1, d, d))

    def table(self, spark) -> DataFrame:
        rows = [(k + 1, float(p), m.tolist(), c.tolist()) for k, (p, m, c) in enumerate(zip(self.pro, self.mean, self.cov, strict=True))]
        return spark.createDataFrame(rows, "component int, pro double, mean array<double>, cov array<array<double>>")


@dataclass
class Sums:
    """Sufficient statistics of one pass, K rows each."""

    s0: np.ndarray
    s1: np.ndarray
    s2: np.ndarray
    t1: np.ndarray  # sums of sqrt(w r) x, which the covariance update needs
    v: np.ndarray  # sums of w r times the representatives' own covariances
    loglik: float
    rows: int

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.s0 + other.s0, self.s1 + other.s1, self.s2 + other.s2, self.t1 + other.t1, self.v + other.v, self.loglik + other.loglik, self.rows + other.rows)


def responsibilities(x: np.ndarray, model: Mixture) -> tuple[np.ndarray, np.ndarray]:
    """Row-normalised responsibilities and the log density of each row."""
    z = model.log_weighted(x)
    top = z.max(axis=1)
    total = top + np.log(np.exp(z - top[:, None]).sum(axis=1))
    return np.exp(z - total[:, None]), total


def sums(x: np.ndarray, own: np.ndarray, w: np.ndarray, model: Mixture) -> Sums:
    r, total = responsibilities(x, model)
    wr = w[:, None] * r
    return Sums(wr.sum(axis=0), wr.T @ x, np.einsum("nk,ni,nj->kij", wr, x, x), np.sqrt(wr).T @ x, np.einsum("nk,nij->kij", wr, own), float(w @ total), len(x))


def updated(s: Sums, params: list[str], ridge: float = RIDGE) -> Mixture:
    """The M-step. The covariance is that of sqrt(w r) x over all rows, brought back to the weighted mean."""
    live = s.s0 > 1e-12
    if not live.all():
        log.warning("%d empty components dropped", int((~live).sum()))
    s0, m = s.s0[live], s.rows
    mean = s.s1[live] / s0[:, None]
    centre = s.t1[live] / m
    outer = lambda a: np.einsum("ki,kj->kij", a, a)
    scatter = (s.s2[live] - m * outer(centre)) / max(m - 1, 1)
    cov = (m / s0)[:, None, None] * (scatter + outer(centre)) - outer(mean) + ridge * np.eye(len(params))
    return Mixture(params, s0, mean, cov)


def _distributed(core: DataFrame, model: Mixture, total: float) -> Sums:
    k, d = model.mean.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = None
        for b in batches:
            if len(b):
                s = sums(np.stack(b["mean"]), np.stack(b["cov"]).reshape(-1, d, d), b["weight"].to_numpy(float) / total, model)
                acc = s if acc is None else acc + s
        if acc is not None:
            flat = np.concatenate([acc.s0, acc.s1.ravel(), acc.s2.ravel(), acc.t1.ravel(), acc.v.ravel(), [acc.loglik, acc.rows]])
            yield pd.DataFrame({"part": [float(acc.s1.sum())], "flat": [flat.tolist()]})

    rows = sorted(core.mapInPandas(run, "part double, flat array<double>").collect(), key=lambda r: r.part)  # a row a partition
    flat = np.sum([r.flat for r in rows], axis=0)
    cuts = np.cumsum([k, k * d, k * d * d, k * d, k * d * d])
    s0, s1, s2, t1, v, rest = np.split(flat, cuts)
    return Sums(s0, s1.reshape(k, d), s2.reshape(k, d, d), t1.reshape(k, d), v.reshape(k, d, d), float(rest[0]), int(rest[1]))


@dataclass
class Journal:
    """The mixtures of a run's steps, in a folder that a later run can read: a row a step."""

    spark: SparkSession
    folder: str

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder.rstrip('/')}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def write(self, step: int, model: Mixture) -> None:
        text = json.dumps({"step": step, "params": model.params, "pro": model.pro.tolist(), "mean": model.mean.tolist(), "cov": model.cov.tolist()})
        self.spark.createDataFrame([(text,)], "model string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder.rstrip('/')}/step={step}")

    def last(self) -> tuple[int, Mixture] | None:
        """The last step that was written whole."""
        fs, path = self._path()
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        for step in sorted((int(n.removeprefix("step=")) for n in names if n.startswith("step=")), reverse=True):
            fs, done = self._path(f"step={step}/_SUCCESS")
            if fs.exists(done):
                x = json.loads(self.spark.read.parquet(f"{self.folder.rstrip('/')}/step={step}").first().model)
                return step, Mixture(x["params"], *(np.array(x[c]) for c in ("pro", "mean", "cov")))
        return None


def weighted_em(core: DataFrame, initial: Mixture, *, ridge: float = RIDGE, steps: int = 10, threshold: float = 5e-3, correct: bool = True, always_correct: bool = False, journal: str | None = None) -> Mixture:
    """The fitted mixture of representatives (weight, mean, cov).

    From the second step on, a relative change of the log-likelihood below ten times ``threshold`` ends the loop
    with the mixture before the last step, its covariances widened by the representatives' own. After ``steps``
    steps the last mixture is returned, unwidened unless ``always_correct``.

    ``journal`` names a folder that all machines share: each step is written there, and a run over the same
    representatives goes on after the last one that it finds. A new run needs a new folder.
    """
    n, total = core.agg(F.count(F.lit(1)), F.sum("weight").cast("double")).first()
    core = core.coalesce(max(1, math.ceil(n / REPRESENTATIVES)))
    log_ = Journal(core.sparkSession, journal) if journal else None
    first, now = (log_ and log_.last()) or (0, Mixture(initial.params, initial.pro / initial.pro.sum(), initial.mean, initial.cov))
    s = _distributed(core, now, total)
    widened = lambda m, x: Mixture(m.params, m.pro, m.mean, m.cov + x.v / m.pro[:, None, None])
    for step in range(first + 1, steps + 1):
        before, before_sums = now, s
        now = updated(s, now.params, ridge)
        s = _distributed(core, now, total)
        change = abs((s.loglik - before_sums.loglik) / before_sums.loglik) if before_sums.loglik else 0.0
        log.info("step %d: log-likelihood %.6g, relative change %.3g", step, s.loglik, change)
        if step > 1 and change < 10 * threshold:
            return widened(before, before_sums) if correct else before
        if log_:
            log_.write(step, now)
    return widened(now, s) if correct and always_correct else now


def random_mixture(core: DataFrame, params: list[str], k: int, seed: int = 0) -> Mixture:
    """k rows drawn by a seeded hash as means, identity covariances, equal shares."""
    rows = core.orderBy(F.xxhash64(F.lit(seed), "mean"), "mean").limit(k).select("mean").collect()
    mean = np.array([r.mean for r in rows], float)
    return Mixture(params, np.full(len(rows), 1 / len(rows)), mean, np.repeat(np.eye(len(params))[None], len(rows), axis=0))
