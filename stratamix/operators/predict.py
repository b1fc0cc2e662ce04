"""Assignment of rows to components and clusters: row-local, no shuffle, usable on streams."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.balls import BallTree
from .em import Mixture

#: Up to this many products for a row the densities are plain expressions; beyond, a ball tree on Arrow batches. The result is the same.
NATIVE_PRODUCTS = 500


def _log_density(params: Sequence[str], pro: float, mean: np.ndarray, cov: np.ndarray) -> Column:
    precision = np.linalg.inv(cov)
    d = len(params)
    x = [F.col(f"`{p}`").cast("double") - F.lit(float(m)) for p, m in zip(params, mean, strict=True)]
    quadratic = None
    for i in range(d):
        for j in range(i, d):
            term = x[i] * x[j] * F.lit(float(precision[i, j] * (1 if i == j else 2)))
            quadratic = term if quadratic is None else quadratic + term
    constant = math.log(pro) - 0.5 * (d * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1]) if pro > 0 else -math.inf
    return F.lit(float(constant)) - F.lit(0.5) * quadratic


def with_component(df: DataFrame, model: Mixture) -> DataFrame:
    """Adds ``component`` (from 1): the first of the highest log densities; null where a feature is null or NaN."""
    k, d = model.mean.shape
    if k * d * d <= NATIVE_PRODUCTS:
        z = F.array(*[_log_density(model.params, p, m, c) for p, m, c in zip(model.pro, model.mean, model.cov, strict=True)])
        whole = None
        for p in model.params:
            c = F.col(f"`{p}`").cast("double")
            ok = c.isNotNull() & ~F.isnan(c)
            whole = ok if whole is None else whole & ok
        return df.withColumn("_z", F.when(whole, z)).withColumn("component", F.array_position("_z", F.array_max("_z")).cast("int")).drop("_z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = BallTree(model.pro, model.mean, model.cov)
        for b in batches:
            x = np.stack([b.column(f"_x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(d)], axis=1)
            ok = ~np.isnan(x).any(axis=1)
            best = np.zeros(len(x), np.int32)
            if ok.any():
                best[ok] = tree.best(x[ok])[0] + 1
            keep = [i for i, n in enumerate(b.schema.names) if n not in names]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(best, pa.int32(), mask=~ok)], names=[*[b.schema.names[i] for i in keep], "component"])

    names = {f"_x{i}" for i in range(d)}
    rows = df.withColumns({f"_x{i}": F.col(f"`{p}`").cast("double") for i, p in enumerate(model.params)})
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "component"], "component int"])
    return rows.drop("component").mapInArrow(run, schema)


def with_cluster(df: DataFrame, cluster_of: Sequence[int]) -> DataFrame:
    """Adds ``cluster`` by the component's number; null for a null component."""
    table = F.array(*[F.lit(int(c)) for c in cluster_of])
    return df.withColumn("cluster", F.when(F.col("component").isNotNull(), F.element_at(table, F.col("component"))))
