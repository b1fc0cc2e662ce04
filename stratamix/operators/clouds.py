"""K-means of bins that are larger than a task may hold: parallel seeding and Lloyd's steps, all bins in the same passes.

A pass sends the centres of all bins to the tasks and adds up a few numbers for each centre, so no task holds a bin. There are at most as
many centres as representatives (see ``coreset``), and the seeding draws a few times as many rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds of drawing, and rows drawn in each for every centre wanted, on average.
ROUNDS, DRAWN = 4, 2.0
#: Distances held at once.
CHUNK = 1 << 22


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre, the first of equal ones, and the squared distance."""
    own = (centers * centers).sum(axis=1)
    label, far = np.empty(len(x), np.int64), np.empty(len(x))
    step = max(1, CHUNK // len(centers))
    for i in range(0, len(x), step):
        part = x[i : i + step]
        d = own - 2 * part @ centers.T
        label[i : i + step] = d.argmin(axis=1)
        far[i : i + step] = ((part - centers[label[i : i + step]]) ** 2).sum(axis=1)
    return label, far


def _by_bin(batches: Iterator[pa.RecordBatch], centers: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each batch and bin the rows with their nearest centres and distances; values are rounded to three decimals."""
    for b in batches:
        if b.num_rows:
            bins = b.column(0).to_numpy(zero_copy_only=False)
            x = np.round(np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[1:]], axis=1), 3)
            for k in np.unique(bins):
                own = x[bins == k]
                yield int(k), own, *nearest(own, centers[int(k)])


def _draws(x: np.ndarray, seed: int) -> np.ndarray:
    """Even draws from [0, 1) by the rows' values: equal rows are drawn together, as one candidate."""
    h = np.full(len(x), seed, np.uint64)
    for j in range(x.shape[1]):
        h = (h ^ (x[:, j] + 0.0).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(11)).astype(float) / float(1 << 53)


def _summed(rows: DataFrame, params: Sequence[str], centers) -> pd.DataFrame:
    """(bin_id, center, n, far, sums) of the rows nearest to each centre: a row a centre."""
    d = len(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for k, x, label, far in _by_bin(batches, centers.value):
            size = len(centers.value[k])
            new = np.stack([np.bincount(label, w, size) for w in (np.ones(len(x)), far, *x.T)], axis=1)
            held[k] = held[k] + new if k in held else new
        for k, s in held.items():
            at = np.flatnonzero(s[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), *[pa.array(s[at, j]) for j in range(d + 2)]], names=["bin_id", "center", "n", "far", *[f"s{j}" for j in range(d)]])

    sums = ["n", "far", *[f"s{j}" for j in range(d)]]
    parts = rows.select("bin_id", *params).mapInArrow(run, ", ".join(["bin_id long, center long", *[f"{c} double" for c in sums]]))
    return parts.groupBy("bin_id", "center").agg(*[F.sum(c).alias(c) for c in sums]).orderBy("bin_id", "center").toPandas()


def _drawn(rows: DataFrame, params: Sequence[str], centers, share: dict[int, float], seed: int) -> pd.DataFrame:
    """Different rows, each drawn with a chance in proportion to its squared distance from the centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, x, _, far in _by_bin(batches, centers.value):
            got = np.unique(x[_draws(x, seed) < far * share[k]], axis=0)
            if len(got):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), k)), *[pa.array(got[:, j]) for j in range(len(params))]], names=["bin_id", *params])

    return rows.select("bin_id", *params).mapInArrow(run, ", ".join(["bin_id long", *[f"`{p}` double" for p in params]])).distinct().toPandas()


def seeds_of(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the weighted points, each chosen in proportion to weight and squared distance from those before."""
    r = np.random.default_rng(seed)
    if len(points) <= k:
        return points
    chosen = [int(r.choice(len(points), p=weights / weights.sum()))]
    far = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k and (far * weights).sum() > 0:
        chosen.append(int(r.choice(len(points), p=far * weights / (far * weights).sum())))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def seeded(rows: DataFrame, params: Sequence[str], wanted: dict[int, int], seed: int) -> dict[int, np.ndarray]:
    """Centres to begin with, at most ``wanted`` for each bin.

    One row a bin comes first. Then each round draws about DRAWN rows for every centre wanted; all that were drawn are weighted by the rows
    nearest to them, and of those the centres are chosen one after the other.
    """
    sc = rows.sparkSession.sparkContext
    first = rows.groupBy("bin_id").agg(F.min_by(F.struct(*params), F.struct(F.xxhash64(F.lit(seed), *params), *params)).alias("x")).collect()  # a row a bin
    found = {int(r.bin_id): np.round(np.array([[r.x[p] for p in params]], float), 3) for r in first}
    for i in range(ROUNDS):
        sent = sc.broadcast(found)
        far = _summed(rows, params, sent).groupby("bin_id").far.sum()
        share = {int(k): DRAWN * wanted[int(k)] / f if f > 0 else 0.0 for k, f in far.items()}
        new = _drawn(rows, params, sent, share, seed * ROUNDS + i + 1)
        sent.destroy()
        found = {k: np.unique(np.concatenate([c, new[new.bin_id == k][list(params)].to_numpy(float)]), axis=0) for k, c in found.items()}
    sent = sc.broadcast(found)
    near = _summed(rows, params, sent)
    sent.destroy()
    out = {}
    for k, points in found.items():
        weights = np.zeros(len(points))
        own = near[near.bin_id == k]
        weights[own.center.to_numpy()] = own.n.to_numpy()
        out[k] = seeds_of(points, weights, wanted[k], seed + k)
    return out


def kmeans_centers(rows: DataFrame, params: Sequence[str], wanted: dict[int, int], *, steps: int = 3, seed: int = 0) -> dict[int, np.ndarray]:
    """The centres of each bin after some of Lloyd's steps on values rounded to three decimals; a centre that no row is nearest to goes.

    ``rows``: bin_id and the columns, without nulls.
    """
    centers = seeded(rows, params, wanted, seed)
    for _ in range(steps):
        sent = rows.sparkSession.sparkContext.broadcast(centers)
        near = _summed(rows, params, sent)
        sent.destroy()
        means = near[[f"s{j}" for j in range(len(params))]].to_numpy() / near[["n"]].to_numpy()
        centers = {k: means[(near.bin_id == k).to_numpy()] for k in centers}
    return centers


def with_centers(rows: DataFrame, params: Sequence[str], centers: dict[int, np.ndarray]) -> DataFrame:
    """(bin_id, piece, params): the number, from 1, of the centre that is nearest to each row's rounded values."""
    sent = rows.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bins = b.column(0).to_numpy(zero_copy_only=False)
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[1:]], axis=1)
                piece = np.empty(len(x), np.int64)
                for k in np.unique(bins):
                    piece[bins == k] = nearest(np.round(x[bins == k], 3), sent.value[int(k)])[0] + 1
                yield pa.RecordBatch.from_arrays([pa.array(bins.astype(np.int32)), pa.array(piece), *[pa.array(x[:, j]) for j in range(len(params))]], names=["bin_id", "piece", *params])

    return rows.select("bin_id", *params).mapInArrow(run, ", ".join(["bin_id int, piece long", *[f"`{p}` double" for p in params]]))
