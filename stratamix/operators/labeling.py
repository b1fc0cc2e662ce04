"""Labels for clusters from ordered hi / lo / don't-care rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "UNK"


def first_match(clusters: DataFrame, rules: DataFrame, markers: Sequence[str]) -> DataFrame:
    """(cluster, func): the first rule that the cluster's levels don't violate, else UNK.

    hi is violated by level 1, lo by any higher level; other cells never are. Rules and clusters are model-sized,
    so their theta join is a broadcast.
    """
    missing = [m for m in markers if m not in clusters.columns]
    if missing:
        raise ValueError(f"rules on markers on which no two clusters differ: {', '.join(missing)}")
    fits = F.lit(True)
    for m in markers:
        level, want = F.col(f"c.`{m}`"), F.col(f"r.`{m}`")
        fits = fits & ~F.coalesce(((want == "hi") & (level == 1)) | ((want == "lo") & (level > 1)), F.lit(False))
    c, r = clusters.alias("c"), F.broadcast(rules).alias("r")
    best = c.join(r, fits, "left").groupBy(F.col("c.cluster").alias("cluster")).agg(F.min_by("r.label", "r.rule_order").alias("func"))
    return best.select("cluster", F.coalesce("func", F.lit(UNKNOWN)).alias("func"))


def label_strings(clusters: DataFrame, funcs: DataFrame, rules: DataFrame, markers: Sequence[str], *, ignore: Sequence[str] = (), fixed: bool = False) -> DataFrame:
    """(cluster, func, label): func and the markers that the matched rule leaves open: ``m++`` at level 3, ``m+`` at level 2.

    If any marker is at level 2, only those at level 2 are listed, unless ``fixed``. No rule leaves the rules'
    markers open for UNK.
    """
    own = [c for c in clusters.columns if c != "cluster" and c not in ignore]
    rule = rules.select("label", *[F.col(f"`{m}`").alias(f"_rule_{i}") for i, m in enumerate(markers)])
    # a label may stand in several rules; the first one counts
    rule = rules.select("label", "rule_order").groupBy("label").agg(F.min("rule_order").alias("rule_order")).join(rules.select("rule_order", *[F.col(f"`{m}`").alias(f"_rule_{i}") for i, m in enumerate(markers)]), "rule_order").drop("rule_order")
    row = clusters.join(funcs, "cluster").join(F.broadcast(rule), F.col("func") == F.col("label"), "left")
    cells = []
    for m in own:
        open_ = F.lit(True)
        if m in markers:
            want = F.col(f"_rule_{list(markers).index(m)}")
            open_ = F.when(F.col("func") == UNKNOWN, False).otherwise(~F.coalesce(want.isin("hi", "lo"), F.lit(False)))
        cells.append(F.struct(F.lit(m).alias("marker"), F.col(f"`{m}`").alias("level"), open_.alias("open")))
    all_cells = F.array(*cells) if cells else F.array().cast("array<struct<marker:string,level:int,open:boolean>>")
    named = lambda level, mark: F.transform(F.filter("_cells", lambda x: x["open"] & (x["level"] == level)), lambda x: F.concat(x["marker"], F.lit(mark)))
    high, middle = named(3, "++"), named(2, "+")
    rest = F.concat(high, middle) if fixed else F.when(F.size(middle) > 0, middle).otherwise(high)
    out = row.withColumn("_cells", all_cells)
    return out.select("cluster", "func", F.array_join(F.concat(F.array("func"), rest), " ").alias("label"))
