"""The clustering estimator and its model."""

from __future__ import annotations

import json
import logging
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import binning, coreset, em, labeling, merge, predict, summaries, univariate
from ..sources.frame import features, numeric_columns, release, require

log = logging.getLogger(__name__)


@dataclass
class MixtureClusterer:
    """Discretises by one-dimensional cutoffs, condenses bins, fits a weighted mixture and merges its components.

    ``univariate``: a table of one-dimensional mixtures; its markers are then the features. ``min_cutoff`` and
    ``ridge`` suit intensities of about -2 to 5; other scales need their own.
    """

    params: Sequence[str] | None = None
    components: int = 100
    min_bin_size: int | None = None
    max_bin_size: int | None = None
    min_cluster_fraction: float = 1e-3
    univariate: DataFrame | None = None
    splitter: str = "kmeans"
    min_cutoff: float = 0.5
    #: Nats that pooling two one-dimensional components below ``min_cutoff`` may cost (see ``univariate.reduce_low``); None pools none.
    pooling: float | None = None
    ridge: float = 0.01
    seed: int = 0
    #: A shared folder from which the mixture's loop goes on if its run was cut off; see ``em.weighted_em``.
    journal: str | None = None

    def fit(self, df: DataFrame) -> MixtureModel:
        params = list(self.params or numeric_columns(df))
        if self.univariate is not None:
            own = sorted({r.marker for r in self.univariate.select("marker").distinct().collect()})
            if set(own) != set(params):
                log.warning("the markers of the given mixtures are the features")
            params = [p for p in params if p in own] + [o for o in own if o not in params]
        require(df, params)
        if not params:
            raise ValueError("at least one feature is needed")
        rows = features(df, params).persist()
        try:
            n = rows.count()
            if not n:
                raise ValueError("no rows")
            mixtures = self.univariate if self.univariate is not None else univariate.fit_univariate_default(rows, params, self.seed)
            if self.pooling is not None:
                mixtures = univariate.reduce_low(mixtures, self.min_cutoff, self.pooling)
            table = [tuple(r) for r in mixtures.select("marker", "comp", "pro", "mean", "var").orderBy("marker", "comp").collect()]  # a few rows a column
            mixtures = df.sparkSession.createDataFrame(table, univariate.SCHEMA)
            cuts = univariate.cutoffs_of(mixtures, params, self.min_cutoff)
            binned = binning.with_bins(rows, cuts)
            levels = {p: cuts.get(p, []) for p in params}
            summary = binning.bin_summary(binned, levels).persist()
            placed = binning.with_bin_ids(binned, summary, levels)
            smallest = int(np.ceil(self.min_cluster_fraction * n))
            start = coreset.initial_mixture(placed, summary, params, components=self.components, smallest=smallest, ridge=self.ridge)
            initial = em.Mixture.collect(start, params)
            log.info("%d initial components of %d wanted", len(initial.pro), self.components)
            core = coreset.coreset(placed, params, smallest=self.min_bin_size or coreset.min_bin_size(n), largest=self.max_bin_size or coreset.max_bin_size(n), splitter=self.splitter, seed=self.seed).persist()
            fitted = em.weighted_em(core, initial, ridge=self.ridge, journal=self.journal)
            core.unpersist()
            release(core)
            summary.unpersist()
            return MixtureModel.of(df.sparkSession, fitted, table, cuts)
        finally:
            rows.unpersist()


@dataclass
class MixtureModel:
    """Model-sized tables, kept on the driver and given out as DataFrames."""

    spark: SparkSession
    mixture: em.Mixture
    univariate_rows: list[tuple]
    cuts: dict[str, list[float]]
    cluster_of: list[int]
    funcs: dict[int, str] = field(default_factory=dict)
    labels: dict[int, str] = field(default_factory=dict)

    @classmethod
    def of(cls, spark: SparkSession, mixture: em.Mixture, univariate_rows: list[tuple], cuts: dict[str, list[float]]) -> MixtureModel:
        mapping = merge.component_clusters(mixture.table(spark), mixture.params, cuts).orderBy("component").collect()
        return cls(spark, mixture, univariate_rows, cuts, [r.cluster for r in mapping])

    @property
    def params(self) -> list[str]:
        return self.mixture.params

    def components(self) -> DataFrame:
        return self.mixture.table(self.spark)

    def univariate(self) -> DataFrame:
        return self.spark.createDataFrame(self.univariate_rows, univariate.SCHEMA)

    def cutoff_table(self) -> DataFrame:
        rows = [(m, i + 1, float(c)) for m, cs in self.cuts.items() for i, c in enumerate(cs)]
        return self.spark.createDataFrame(rows, "marker string, cut_idx int, cutoff double")

    def mapping(self) -> DataFrame:
        """(component, levels, cluster)."""
        return merge.component_clusters(self.components(), self.params, self.cuts)

    def phenotypes(self) -> DataFrame:
        return merge.phenotypes(self.mapping(), self.params)

    def cluster_stats(self) -> DataFrame:
        """(cluster, marker, center, sd)."""
        return merge.cluster_sds(self.components(), self.mapping(), self.params)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``component`` and ``cluster``; works on streams too."""
        require(df, self.params)
        return predict.with_cluster(predict.with_component(df, self.mixture), self.cluster_of)

    def label(self, rules: DataFrame, ignore_markers: Sequence[str] = (), fixed_labels: bool = False) -> MixtureModel:
        """The model with ``func`` and ``label`` for each cluster."""
        markers = [c for c in rules.columns if c not in ("rule_order", "label")]
        clusters = self.phenotypes()
        funcs = labeling.first_match(clusters, rules, markers)
        rows = labeling.label_strings(clusters, funcs, rules, markers, ignore=ignore_markers, fixed=fixed_labels).collect()
        return MixtureModel(self.spark, self.mixture, self.univariate_rows, self.cuts, self.cluster_of, {r.cluster: r.func for r in rows}, {r.cluster: r.label for r in rows})

    def label_table(self) -> DataFrame:
        rows = [(c, self.funcs.get(c), self.labels.get(c)) for c in sorted(set(self.cluster_of))]
        return self.spark.createDataFrame(rows, "cluster int, func string, label string")

    def embedding(self, scale: float = 9, seed: int = 0) -> DataFrame:
        """(cluster, tsne_1, tsne_2, func, logsize)."""
        places = summaries.embedding(self.cluster_stats().select("cluster", "marker", "center"), seed)
        sizes = summaries.log_sizes(self.components(), self.mapping(), scale).select("cluster", "logsize")
        return places.join(self.label_table().select("cluster", "func"), "cluster").join(sizes, "cluster")

    def intensity_panels(self, midpoint: float = 1.5, scale: float = 7, seed: int = 0) -> DataFrame:
        """(marker, cluster, tsne_1, tsne_2, logsize, center, offset, is_legend_marker)."""
        stats = self.cluster_stats()
        best = summaries.legend_marker(stats).first().marker
        out = stats.join(self.embedding(scale, seed).drop("func"), "cluster")
        return out.select("marker", "cluster", "tsne_1", "tsne_2", "logsize", "center", (F.col("center") - midpoint).alias("offset"), (F.col("marker") == best).alias("is_legend_marker"))

    def bars(self, cluster_ids: Sequence[int], cluster_names: Sequence[str] | None = None) -> DataFrame:
        return summaries.bars(self.cluster_stats(), self.cutoff_table(), merge.polymorphic(self.mapping(), self.params), cluster_ids, cluster_names)

    def save(self, path: str) -> None:
        """Writes the model's tables as Parquet under ``path``."""
        self.components().write.mode("overwrite").parquet(f"{path}/components")
        self.univariate().write.mode("overwrite").parquet(f"{path}/univariate")
        rest = json.dumps({"params": self.params, "cuts": self.cuts, "cluster_of": self.cluster_of, "funcs": self.funcs, "labels": self.labels})
        self.spark.createDataFrame([(rest,)], "model string").write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> MixtureModel:
        rest = json.loads(spark.read.parquet(f"{path}/model").first().model)
        rows = spark.read.parquet(f"{path}/components").orderBy("component").collect()
        mixture = em.Mixture(rest["params"], np.array([r.pro for r in rows]), np.array([r.mean for r in rows]), np.array([r["cov"] for r in rows]))
        uni = [tuple(r) for r in spark.read.parquet(f"{path}/univariate").orderBy("marker", "comp").collect()]
        ints = lambda d: {int(k): v for k, v in d.items()}
        return cls(spark, mixture, uni, rest["cuts"], rest["cluster_of"], ints(rest["funcs"]), ints(rest["labels"]))
