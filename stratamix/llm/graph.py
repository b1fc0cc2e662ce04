"""Connected components by alternating large-star and small-star steps, with lineage cut in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shuffled, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b); a component's id is its smallest node.

    Each step gives every node's neighbours to the smallest of them, so stars form in a logarithmic number of
    steps; the tables never outgrow the edges. Self-loops and nulls don't count; no edges give no rows.
    """

    def distinct(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()

    def stars(e: DataFrame) -> bool:
        """Whether each node hangs on one other alone, on which nothing but such nodes hang."""
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        ends = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
        return ends.filter("hangs > 1 or hangs = 1 and holds = 1").isEmpty()

    now = written(distinct(edges.dropna().select(F.col("a").alias("u"), F.col("b").alias("v"))), "links", small=True)
    while not stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = distinct(both.join(shuffled(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(shuffled(least), "u")
        small = hung.select("u", F.col("m").alias("v")).unionByName(hung.select(F.col("v").alias("u"), F.col("m").alias("v")))
        last, now = now, written(distinct(small), "links", small=True)
        discard(last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
