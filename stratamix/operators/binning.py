"""Discretisation of rows by cutoffs, and the table of bins."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.frame import numbered


def level(column: Column, cuts: Sequence[float]) -> Column:
    """1 plus the number of cutoffs that the value exceeds; null and NaN have level 1."""
    out = F.lit(1)
    known = column.isNotNull() & ~F.isnan(column)
    for c in cuts:
        out = out + F.when(known & (column > F.lit(float(c))), 1).otherwise(0)
    return out.cast("int")


def with_bins(df: DataFrame, cuts: Mapping[str, Sequence[float]]) -> DataFrame:
    """Adds ``levels`` (by marker, in the mapping's order) and ``bin_key``, their digits; no markers: one bin, key empty."""
    levels = [level(F.col(f"`{m}`").cast("double"), c) for m, c in cuts.items()]
    if not levels:
        return df.withColumns({"levels": F.array().cast("array<int>"), "bin_key": F.lit("")})
    return df.withColumns({"levels": F.array(*levels), "bin_key": F.concat(*[x.cast("string") for x in levels])})


#: Bins, rows of a few numbers each, that may be sent to all tasks or ordered in one.
MOST_SENT = 100_000


def _cells(cuts: Mapping[str, Sequence[float]] | None) -> float:
    """The most bins there can be."""
    return math.inf if cuts is None else math.prod(len(c) + 1 for c in cuts.values())


def bin_summary(binned: DataFrame, cuts: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """(bin_id, bin_key, levels, n, size_rank): ids by ascending levels, ranks by falling size, ties by falling id.

    Where ``cuts`` make at most MOST_SENT cells, one task orders the bins; else they are numbered by ranges.
    """
    bins = binned.groupBy("levels").agg(F.first("bin_key").alias("bin_key"), F.count(F.lit(1)).alias("n"))
    if _cells(cuts) <= MOST_SENT:
        bins = bins.withColumn("bin_id", F.row_number().over(W.orderBy("levels")))
        bins = bins.withColumn("size_rank", F.row_number().over(W.orderBy(F.desc("n"), F.desc("bin_id"))))
    else:
        bins = numbered(numbered(bins, "bin_id", F.col("levels")), "size_rank", F.desc("n"), F.desc("bin_id"))
        bins = bins.withColumns({"bin_id": F.col("bin_id").cast("int"), "size_rank": F.col("size_rank").cast("int")})
    return bins.select("bin_id", "bin_key", "levels", "n", "size_rank")


def with_bin_ids(binned: DataFrame, summary: DataFrame, cuts: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """``binned`` with ``bin_id``, ``bin_n`` and ``size_rank``.

    The summary is sent to all tasks if it has at most MOST_SENT bins: by the number of cells that ``cuts`` make, or,
    where these are more or not given, by count. Otherwise it is joined by key.
    """
    bins = summary.select("levels", "bin_id", F.col("n").alias("bin_n"), "size_rank")
    if _cells(cuts) <= MOST_SENT or bins.limit(MOST_SENT + 1).count() <= MOST_SENT:
        bins = F.broadcast(bins)
    return binned.join(bins, "levels")
