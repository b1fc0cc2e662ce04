"""The data behind the usual plots, as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tsne import tsne
from ..sources.frame import features

GRID = 401


def _points(df: DataFrame, params: Sequence[str], weight: str | None) -> DataFrame:
    rows = features(df, params, *([weight] if weight else []))
    return rows.unpivot([weight] if weight else [], list(params), "marker", "x").filter(F.col("x").isNotNull() & ~F.isnan("x"))


def kde_ranges(df: DataFrame, params: Sequence[str], weight: str | None = None) -> DataFrame:
    """(marker, n, sd, h, low, high): bandwidth and range of each marker's density estimate."""
    stats = _points(df, params, weight).groupBy("marker").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"), F.min("x").alias("min"), F.max("x").alias("max"))
    h = F.pow(F.lit(1 / (4 * np.pi)), F.lit(0.1)) * F.pow(F.lit(243.0) / (F.lit(35.0) * F.col("n")), F.lit(0.2)) * F.col("sd")
    return stats.withColumn("h", h).select("marker", "n", "sd", "h", (F.col("min") - 4 * F.col("h")).alias("low"), (F.col("max") + 4 * F.col("h")).alias("high"))


def kde_bins(df: DataFrame, params: Sequence[str], weight: str | None = None) -> DataFrame:
    """(marker, grid_idx from 0, mass): linear binning; a row's weight goes to its two neighbours on the grid."""
    ranges = kde_ranges(df, params, weight).filter(F.col("high") > F.col("low"))
    w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    at = (F.col("x") - F.col("low")) * (GRID - 1) / (F.col("high") - F.col("low"))
    placed = _points(df, params, weight).join(F.broadcast(ranges), "marker").select("marker", at.alias("at"), w.alias("w"))
    cell = F.floor("at").cast("int")
    both = F.array(F.struct(cell.alias("grid_idx"), (F.col("w") * (1 - (F.col("at") - F.floor("at")))).alias("m")), F.struct((cell + 1).alias("grid_idx"), (F.col("w") * (F.col("at") - F.floor("at"))).alias("m")))
    return placed.select("marker", F.explode(both).alias("c")).select("marker", "c.*").groupBy("marker", "grid_idx").agg(F.sum("m").alias("mass")).filter((F.col("mass") > 0) & (F.col("grid_idx") < GRID))


def kde_table(df: DataFrame, params: Sequence[str], weight: str | None = None) -> DataFrame:
    """(marker, grid_idx, x, y): Gaussian kernel over the binned masses; grid-sized once the rows are binned."""
    bins, ranges = kde_bins(df, params, weight), kde_ranges(df, params, weight).filter(F.col("high") > F.col("low"))
    total = bins.groupBy("marker").agg(F.sum("mass").alias("total"))
    grid = ranges.join(total, "marker").select("*", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("grid_idx"))
    step = (F.col("high") - F.col("low")) / (GRID - 1)
    z = (F.col("g.grid_idx") - F.col("b.grid_idx")) * F.col("step") / F.col("h")
    g = grid.select("marker", "grid_idx", "h", "total", step.alias("step"), (F.col("low") + F.col("grid_idx") * step).alias("x")).alias("g")
    near = g.join(bins.alias("b"), F.col("g.marker") == F.col("b.marker"))
    y = F.sum(F.col("b.mass") * F.exp(F.lit(-0.5) * z * z)) / (F.first("total") * F.first("h") * F.sqrt(F.lit(2 * np.pi)))
    return near.groupBy("g.marker", "g.grid_idx").agg(F.first("x").alias("x"), y.alias("y"))


def kde(df: DataFrame, params: Sequence[str], overlay: DataFrame | None = None) -> DataFrame:
    """(series, marker, grid_idx, x, y) of one table or two."""
    out = kde_table(df, params).select(F.lit("data").alias("series"), "*")
    return out if overlay is None else out.unionByName(kde_table(overlay, params).select(F.lit("overlay").alias("series"), "*"))


def mixture_curves(df: DataFrame, mixtures: DataFrame, params: Sequence[str], points: int = 500) -> DataFrame:
    """(marker, component, x, y): weighted component densities (component 0: their sum) at equal steps between the data's extremes."""
    ends = _points(df, params, None).groupBy("marker").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    grid = ends.select("marker", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("low") + (F.col("high") - F.col("low")) * i / (points - 1))).alias("idx", "x"))
    sd = F.sqrt("var")
    y = F.col("pro") * F.exp(F.lit(-0.5) * F.pow((F.col("x") - F.col("mean")) / sd, F.lit(2.0))) / (sd * F.sqrt(F.lit(2 * np.pi)))
    each = grid.join(F.broadcast(mixtures), "marker").select("marker", F.col("comp").alias("component"), "idx", "x", y.alias("y"))
    total = each.groupBy("marker", "idx").agg(F.first("x").alias("x"), F.sum("y").alias("y")).select("marker", F.lit(0).alias("component"), "idx", "x", "y")
    return each.unionByName(total)


def univariate_curves(df: DataFrame, mixtures: DataFrame, params: Sequence[str]) -> DataFrame:
    """(marker, panel, component, x, y): the density estimate, the mixture and its components beside each other."""
    curves = mixture_curves(df, mixtures, params)
    panel = F.when(F.col("component") == 0, "mixture").otherwise("components")
    return kde_table(df, params).select("marker", F.lit("kde").alias("panel"), F.lit(0).alias("component"), "x", "y").unionByName(curves.select("marker", panel.alias("panel"), "component", "x", "y"))


def kde_with_cutoffs(df: DataFrame, cuts: Mapping[str, Sequence[float]], params: Sequence[str]) -> DataFrame:
    """The density estimates with each marker's cutoffs."""
    out = kde_table(df, params)
    at = F.lit(None).cast("array<double>")
    for m, c in cuts.items():
        at = F.when(F.col("marker") == m, F.array(*[F.lit(float(x)) for x in c]).cast("array<double>")).otherwise(at)
    return out.withColumn("cutoffs", at)


def cluster_against_all(df: DataFrame, clusters: Sequence[int], params: Sequence[str], weight: str | None = None) -> DataFrame:
    """(series, marker, grid_idx, x, y, scaled): densities of rows in clusters and of all rows, scaled to 0.8 of their peaks."""
    parts = [("all", df), *[(f"cluster {c}", df.filter(F.col("cluster") == c)) for c in clusters]]
    out = None
    for name, rows in parts:
        t = kde_table(rows, params, weight if name != "all" else None).select(F.lit(name).alias("series"), "*")
        out = t if out is None else out.unionByName(t)
    peak = out.groupBy("series", "marker").agg(F.max("y").alias("peak"))
    return out.join(peak, ["series", "marker"]).withColumn("scaled", F.lit(0.8) * F.col("y") / F.col("peak")).drop("peak")


def log_sizes(components: DataFrame, mapping: DataFrame, scale: float) -> DataFrame:
    """(cluster, share, logsize): ln of the cluster's share, times ``scale`` over the mean of those."""
    share = components.join(mapping, "component").groupBy("cluster").agg(F.sum("pro").alias("share")).withColumn("ln", F.log("share"))
    mean = share.agg(F.avg("ln").alias("mean"))
    return share.join(F.broadcast(mean)).select("cluster", "share", (F.col("ln") * scale / F.col("mean")).alias("logsize"))


def legend_marker(centers: DataFrame) -> DataFrame:
    """(marker, amplitude): the marker whose centers lie farthest apart; the first by name at a tie."""
    amplitude = centers.groupBy("marker").agg((F.max("center") - F.min("center")).alias("amplitude"))
    return amplitude.orderBy(F.desc("amplitude"), "marker").limit(1)


def bars(stats: DataFrame, cuts: DataFrame, markers: Sequence[str], cluster_ids: Sequence[int], names: Sequence[str] | None = None) -> DataFrame:
    """(cluster, name, marker, mfi, sd, lo, hi, midpt, ymin, ymax): one bar for each cluster and polymorphic marker.

    The midpoint is the marker's median cutoff; the axis spans all bars and zero.
    """
    named = dict(zip(cluster_ids, names or [str(c) for c in cluster_ids], strict=True))
    chosen = stats.filter(F.col("cluster").isin(list(cluster_ids)) & F.col("marker").isin(list(markers)))
    mid = cuts.groupBy("marker").agg(F.expr("percentile(cutoff, 0.5)").alias("midpt"))
    name = F.create_map(*[F.lit(x) for kv in named.items() for x in kv])[F.col("cluster")]
    rows = chosen.join(F.broadcast(mid), "marker", "left").select("cluster", name.alias("name"), "marker", F.col("center").alias("mfi"), "sd", (F.col("center") - F.col("sd")).alias("lo"), (F.col("center") + F.col("sd")).alias("hi"), "midpt")
    axis = rows.agg(F.least(F.lit(0.0), F.min("lo")).alias("ymin"), F.max("hi").alias("ymax"))
    return rows.join(F.broadcast(axis))


def center_distances(centers: DataFrame) -> DataFrame:
    """(a, b, distance): Euclidean distances between cluster centers, each pair once; clusters are few."""
    a, b = centers.alias("a"), centers.alias("b")
    both = a.join(b, (F.col("a.marker") == F.col("b.marker")) & (F.col("a.cluster") < F.col("b.cluster")))
    return both.groupBy(F.col("a.cluster").alias("a"), F.col("b.cluster").alias("b")).agg(F.sqrt(F.sum(F.pow(F.col("a.center") - F.col("b.center"), F.lit(2.0)))).alias("distance"))


def embedding(centers: DataFrame, seed: int = 0) -> DataFrame:
    """(cluster, tsne_1, tsne_2) of cluster centers, made on the driver: there are as many as clusters."""
    wide = centers.groupBy("cluster").pivot("marker").agg(F.first("center")).orderBy("cluster").toPandas()
    y = tsne(wide.drop(columns="cluster").to_numpy(float), seed=seed)
    return centers.sparkSession.createDataFrame(pd.DataFrame({"cluster": wide.cluster.astype("int32"), "tsne_1": y[:, 0], "tsne_2": y[:, 1]}))


def row_embedding(scored: DataFrame, params: Sequence[str], size: int = 500, seed: int = 0) -> DataFrame:
    """(cluster, tsne_1, tsne_2) of a sample of at most ``size`` scored rows."""
    rows = features(scored, params, "cluster").orderBy(F.xxhash64(F.lit(seed), *params)).limit(size).toPandas()
    y = tsne(rows[list(params)].to_numpy(float), seed=seed)
    return scored.sparkSession.createDataFrame(pd.DataFrame({"cluster": rows.cluster.astype("int32"), "tsne_1": y[:, 0], "tsne_2": y[:, 1]}))
