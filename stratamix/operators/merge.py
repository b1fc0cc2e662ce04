"""Components that fall between the same cutoffs become one cluster. All tables here have a row a component or less."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .binning import level


def component_clusters(components: DataFrame, params: Sequence[str], cuts: Mapping[str, Sequence[float]]) -> DataFrame:
    """(component, levels, cluster): cluster ids in the order in which levels first appear by component."""
    levels = [level(F.col("mean")[i], cuts.get(p, ())) for i, p in enumerate(params)]
    keyed = components.select("component", F.array(*levels).alias("levels"))
    first = F.min("component").over(W.partitionBy("levels"))
    keyed = keyed.withColumn("_first", first)
    return keyed.select("component", "levels", F.dense_rank().over(W.orderBy("_first")).alias("cluster"))


def cluster_centers(components: DataFrame, mapping: DataFrame, params: Sequence[str]) -> DataFrame:
    """(cluster, marker, center): means weighted by share."""
    long = _long(components, mapping, params)
    return long.groupBy("cluster", "marker").agg((F.sum(F.col("pro") * F.col("mean")) / F.sum("pro")).alias("center"))


def cluster_sds(components: DataFrame, mapping: DataFrame, params: Sequence[str]) -> DataFrame:
    """(cluster, marker, center, sd): the law of total variance on the diagonals."""
    centers = cluster_centers(components, mapping, params)
    both = _long(components, mapping, params).join(centers, ["cluster", "marker"])
    spread = F.sum(F.col("pro") * (F.col("var") + (F.col("mean") - F.col("center")) ** 2)) / F.sum("pro")
    return both.groupBy("cluster", "marker").agg(F.first("center").alias("center"), F.sqrt(spread).alias("sd"))


def _long(components: DataFrame, mapping: DataFrame, params: Sequence[str]) -> DataFrame:
    d = len(params)
    cells = F.array(*[F.struct(F.lit(p).alias("marker"), F.col("mean")[i].alias("mean"), F.flatten("cov")[i * d + i].alias("var")) for i, p in enumerate(params)])
    return components.join(mapping, "component").select("cluster", "pro", F.explode(cells).alias("c")).select("cluster", "pro", "c.*")


def polymorphic(mapping: DataFrame, params: Sequence[str]) -> list[str]:
    """Markers on which clusters have more than one level."""
    row = mapping.agg(*[F.countDistinct(F.col("levels")[i]).alias(str(i)) for i in range(len(params))]).first()
    return [p for i, p in enumerate(params) if row[i] > 1]


def phenotypes(mapping: DataFrame, params: Sequence[str]) -> DataFrame:
    """(cluster, one level column for each polymorphic marker)."""
    many = polymorphic(mapping, params)
    one = mapping.select("cluster", "levels").distinct()
    return one.select("cluster", *[F.col("levels")[i].alias(p) for i, p in enumerate(params) if p in many])
