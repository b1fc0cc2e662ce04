"""Weighted representatives of bins, and the initial mixture from the largest bins."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.frame import holding
from .clouds import kmeans_centers, nearest, with_centers
from .medians import TIMES, halves, median_tree, repeated, with_pieces

SCHEMA = "bin_id int, piece long, weight long, mean array<double>, cov array<double>"
#: Rows of a bin that one task may hold; larger bins are split by passes over all rows.
MOST_ROWS = 100_000
RIDGE = 0.01


def min_bin_size(n: int) -> int:
    return max(5, math.ceil(n / 1e5))


def max_bin_size(n: int) -> int:
    return max(50, math.ceil(n / 1e4))


def moments(rows: DataFrame, keys: Sequence[str], params: Sequence[str], digits: int | None = None) -> DataFrame:
    """Keys, weight, mean array and row-major sample covariance array (zeros for a single row) in one aggregation.

    With ``digits`` the means are those of values rounded to so many decimals.
    """
    d = len(params)
    names = {(i, j): f"_c{i}_{j}" for i in range(d) for j in range(i, d)}
    shown = lambda c: c if digits is None else F.round(c, digits)
    means = [F.avg(shown(F.col(f"`{p}`"))).alias(f"_m{i}") for i, p in enumerate(params)]
    covs = [F.covar_samp(F.col(f"`{params[i]}`"), F.col(f"`{params[j]}`")).alias(name) for (i, j), name in names.items()]
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("weight"), *means, *covs)
    cov = [F.coalesce(F.col(names[min(i, j), max(i, j)]), F.lit(0.0)) for i in range(d) for j in range(d)]
    return out.select(*keys, "weight", F.array(*[F.col(f"_m{i}") for i in range(d)]).alias("mean"), F.array(*cov).alias("cov"))


def piece_count(n: Column, largest: int) -> Column:
    """Representatives of a bin of ``n`` rows, if none may stand for more than ``largest``."""
    return F.ceil(n / largest).cast("long")


def kmeans(x: np.ndarray, k: int, seed: int, most: int) -> np.ndarray:
    """Lloyd's algorithm from seeded rows; returns each row's piece."""
    unique = np.unique(x, axis=0)
    k = min(k, len(unique))
    centers = unique[np.random.default_rng(seed).choice(len(unique), k, replace=False)]
    for _ in range(most):
        label, _ = nearest(x, centers)
        size = np.bincount(label, minlength=k)
        new = np.stack([np.bincount(label, x[:, j], k) for j in range(x.shape[1])], axis=1) / np.maximum(size, 1)[:, None]
        new = np.where(size[:, None] > 0, new, centers)
        if np.allclose(new, centers):
            break
        centers = new
    return np.unique(label, return_inverse=True)[1]


def halving_depth(n: int, largest: int) -> int:
    """How often a bin of n rows is halved so that ceil(n / largest) pieces are there at least."""
    return (math.ceil(n / largest) - 1).bit_length()


def _stats(x: np.ndarray, times: np.ndarray | None = None) -> tuple[int, list[float], np.ndarray]:
    """Weight, mean and sample covariance of rows, of which each may count several times."""
    times = np.ones(len(x), np.int64) if times is None else times
    n = int(times.sum())
    cov = np.cov(x.T, ddof=1, fweights=times).reshape(-1) if n > 1 else np.zeros(x.shape[1] ** 2)
    return n, (times @ x / n).tolist(), cov


def median_pieces(rows: DataFrame, params: Sequence[str], largest: int) -> DataFrame:
    """(bin_id, piece, weight, mean, cov) of rows of bins, of any size, halved at the exact medians of the widest columns.

    ``rows``: bin_id, bin_n above ``largest``, and the columns. Equal rows are taken together first, so that the passes go over
    the different ones. Bins and pieces of up to MOST_ROWS different rows are halved by the task that holds them, larger ones
    by ``medians.median_tree``; the cuts are the same. Pieces without rows don't count.
    """
    points = rows.groupBy("bin_id", "bin_n", *params).agg(F.count(F.lit(1)).alias(TIMES)).persist()
    sizes = {r.bin_id: (r.bin_n, r.points) for r in points.groupBy("bin_id", "bin_n").agg(F.count(F.lit(1)).alias("points")).collect()}  # a row a bin
    huge = [b for b, (_, n) in sizes.items() if n > MOST_ROWS]
    todo = F.length(F.bin(F.ceil(F.col("bin_n") / largest) - 1)).cast("int")
    ready = points.filter(~F.col("bin_id").isin(huge)).select(F.col("bin_id").cast("int").alias("bin_id"), F.lit(0).cast("long").alias("path"), todo.alias("todo"), *params, TIMES)
    done, held = None, [points]
    if huge:
        far = points.filter(F.col("bin_id").isin(huge)).select("bin_id", *params, TIMES)
        cut = with_pieces(far, params, median_tree(far, params, {b: halving_depth(sizes[b][0], largest) for b in huge}, MOST_ROWS)).persist()
        held.append(cut)
        ready = ready.unionByName(cut.filter("todo > 0"))
        done = moments(repeated(cut.filter("todo = 0")), ["bin_id", "path"], params).withColumn("weight", F.col("weight").cast("long"))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        x, times, first = pdf[list(params)].to_numpy(float), pdf[TIMES].to_numpy(), pdf.iloc[0]
        label = halves(x, int(first.todo), times)
        order = np.argsort(label, kind="stable")
        pieces, begin = np.unique(label[order], return_index=True)
        rows = [(int(first.bin_id), (int(first.path) << int(first.todo)) + int(k), *_stats(x[at], times[at])) for k, at in zip(pieces, np.split(order, begin[1:]), strict=True)]
        return pd.DataFrame(rows, columns=["bin_id", "path", "weight", "mean", "cov"])

    out = ready.groupBy("bin_id", "path", "todo").applyInPandas(split, "bin_id int, path long, weight long, mean array<double>, cov array<double>")
    out = out if done is None else out.unionByName(done)
    # as many rows as pieces
    piece = F.row_number().over(W.partitionBy("bin_id").orderBy("path")).cast("long")
    return holding(out.select("bin_id", piece.alias("piece"), "weight", "mean", "cov"), *held)


def kmeans_pieces(rows: DataFrame, params: Sequence[str], largest: int, seed: int = 0) -> DataFrame:
    """(bin_id, piece, weight, mean, cov) of rows of bins of more than MOST_ROWS rows, by ``clouds``: at most ceil(n / largest) pieces a bin."""
    wanted = {int(r.bin_id): math.ceil(r.bin_n / largest) for r in rows.select("bin_id", "bin_n").distinct().collect()}  # bins above MOST_ROWS rows
    if not wanted:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    rows = rows.select("bin_id", *params).persist()
    out = moments(with_centers(rows, params, kmeans_centers(rows, params, wanted, seed=seed)), ["bin_id", "piece"], params, digits=3)
    return holding(out.select("bin_id", "piece", F.col("weight").cast("long").alias("weight"), "mean", "cov"), rows)


def coreset(binned: DataFrame, params: Sequence[str], *, smallest: int, largest: int, splitter: str = "kmeans", seed: int = 0) -> DataFrame:
    """Representatives (bin_id, piece, weight, mean, cov) of rows with ``bin_id`` and ``bin_n``.

    Bins of fewer than ``smallest`` rows go. A bin is cut into ceil(n / largest) pieces by k-means on values rounded
    to three decimals (the means are those of the rounded values, the covariances of the plain ones), or by halves
    at medians. Bins of up to MOST_ROWS rows are split in a task each. What larger ones leave in Spark's storage goes with
    ``release``.
    """
    kept = binned.filter(F.col("bin_n") >= smallest)
    whole = moments(kept.filter(F.col("bin_n") <= largest), ["bin_id"], params)
    whole = whole.select("bin_id", F.lit(1).cast("long").alias("piece"), F.col("weight").cast("long").alias("weight"), "mean", "cov")
    large = kept.filter(F.col("bin_n") > largest).select("bin_id", "bin_n", *params)
    if splitter == "median":
        pieces = median_pieces(large, params, largest)
        return holding(whole.unionByName(pieces), *getattr(pieces, "_held", []))
    huge = kmeans_pieces(large.filter(F.col("bin_n") > MOST_ROWS), params, largest, seed)

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        x, b = pdf[list(params)].to_numpy(float), int(pdf.bin_id.iloc[0])
        rounded = np.round(x, 3)
        label = kmeans(rounded, math.ceil(len(x) / largest), seed + b, 10)
        rows = []
        for piece in range(label.max() + 1):
            weight, _, cov = _stats(x[label == piece])
            rows.append((b, piece + 1, weight, rounded[label == piece].mean(axis=0).tolist(), cov.tolist()))
        return pd.DataFrame(rows, columns=["bin_id", "piece", "weight", "mean", "cov"])

    middle = large.filter(F.col("bin_n") <= MOST_ROWS).select("bin_id", *params)
    out = whole.unionByName(middle.groupBy("bin_id").applyInPandas(split, SCHEMA)).unionByName(huge)
    return holding(out, *getattr(huge, "_held", []))


def initial_bins(summary: DataFrame, components: int, smallest: int) -> DataFrame:
    """The ``components`` largest bins, of which only those of more than ``smallest`` rows stay."""
    return summary.filter(F.col("n") >= smallest).orderBy("size_rank").limit(components).filter(F.col("n") > smallest)


def initial_mixture(binned: DataFrame, summary: DataFrame, params: Sequence[str], *, components: int, smallest: int, ridge: float = RIDGE) -> DataFrame:
    """(component, pro, mean, cov) of the largest bins: pro is the count, the covariance has ``ridge`` on its diagonal."""
    chosen = initial_bins(summary, components, smallest).select("bin_id", F.col("size_rank").alias("component"))
    out = moments(binned.join(F.broadcast(chosen), "bin_id"), ["component"], params)
    d = len(params)
    cov = F.transform("cov", lambda x, i: x + F.when(i % (d + 1) == 0, ridge).otherwise(0.0))
    return out.select("component", F.col("weight").cast("double").alias("pro"), "mean", cov.alias("cov"))
