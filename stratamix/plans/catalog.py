"""Queries of the clustering engine by name, and the SQL they are compared with.

Every query reads tables. Cutoffs of bins, rules and one mixture for scoring are given here; mixtures of columns, components
and clusters are made from the tables. K-means, t-SNE and fits of samples have no SQL.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normal import complexity_bias
from ..operators import binning, coreset, em, labeling, merge, predict, summaries, univariate
from ..sources import frame
from .model import MixtureClusterer

DIMS = ["x0", "x1", "x2", "x3"]
CUTS = {"x0": [-0.05, 0.08], "x1": [0.0], "x2": [0.02]}
LINE = ["qty", "price", "disc"]
LINE_CUTS = {"qty": [1.5, 3.0], "price": [2.0, 5.0], "disc": [0.5]}
LARGEST = 400

#: Mixtures of columns: marker, table, expression, components for values above zero (None: up to three by BIC).
COLUMNS = [("amount", "events", "CAST(value AS DOUBLE) / 100", None), ("balance", "customer", "CAST(c_acctbal AS DOUBLE) / 1000", 2), ("total", "orders", "CAST(o_totalprice AS DOUBLE) / 100000", None)]
#: Components of the largest bins of lineitem fall into clusters between these.
MERGE_CUTS, MERGED = {"qty": [1.5, 3.0], "price": [2.0], "disc": [0.5]}, 12
RULES = [(1, "alpha", "hi", "hi"), (2, "beta", "hi", "lo"), (3, "gamma", "lo", "hi")]
OTHER = [("a", 1, 0.5, 0.0, 1.0), ("a", 2, 0.5, 2.0, 1.0), ("b", 1, 0.7, 0.0, 0.25), ("b", 2, 0.2, 0.3, 0.04), ("b", 3, 0.1, 3.0, 0.64), ("c", 1, 1.0, 1.0, 0.5)]

MODEL = em.Mixture(["x0", "x1"], np.array([0.5, 0.3, 0.2]), np.array([[0.0, 0.05], [0.1, -0.1], [-0.1, 0.1]]), np.array([[[0.02, 0.004], [0.004, 0.015]], [[0.012, 0.0], [0.0, 0.018]], [[0.016, -0.003], [-0.003, 0.02]]]))
CLUSTER_OF = [2, 1, 2]


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _vectors(spark, sf) -> DataFrame:
    return _read(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(d) for i, d in enumerate(DIMS)])


def _lines(spark, sf) -> DataFrame:
    return _read(spark, sf, "lineitem").select((F.col("l_quantity") / 10).alias("qty"), (F.col("l_extendedprice") / 10000).alias("price"), (F.col("l_discount") * 20).alias("disc"))


VECTORS = "v AS (SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {d}" for i, d in enumerate(DIMS)) + " FROM embeddings)"
LINES = "v AS (SELECT l_quantity / 10 AS qty, l_extendedprice / 10000 AS price, l_discount * 20 AS disc FROM lineitem)"


def _level_sql(column: str, cuts: Sequence[float]) -> str:
    return "(1" + "".join(f" + CASE WHEN {column} > {c!r} AND NOT isnan({column}) THEN 1 ELSE 0 END" for c in cuts) + ")"


def _binned_sql(cuts: dict) -> str:
    key = " || ".join(f"CAST({_level_sql(m, c)} AS VARCHAR)" for m, c in cuts.items())
    return f"b AS (SELECT *, {key} AS bin_key FROM v)"


_BINS = "s AS (SELECT bin_key, count(*) AS n, row_number() OVER (ORDER BY bin_key) AS bin_id FROM b GROUP BY bin_key), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, bin_id DESC) AS size_rank FROM s)"
_SUMMARY = f"{_BINS} SELECT CAST(bin_id AS INTEGER) AS bin_id, bin_key, n, CAST(size_rank AS INTEGER) AS size_rank FROM r"
_LINE_BINS = f"WITH {LINES}, {_binned_sql(LINE_CUTS)}, {_BINS}"
_MOMENTS = ", ".join([*[f"round(avg({p}), 6) AS mean_{p}" for p in LINE], *[f"round(coalesce(covar_samp({LINE[i]}, {LINE[j]}), 0), 6) AS cov_{LINE[i]}_{LINE[j]}" for i in range(3) for j in range(i, 3)]])


def _placed(spark, sf, vectors: bool = False) -> tuple[DataFrame, DataFrame]:
    rows, cuts = (_vectors(spark, sf), CUTS) if vectors else (_lines(spark, sf), LINE_CUTS)
    binned = binning.with_bins(rows, cuts)
    summary = binning.bin_summary(binned, cuts)
    return binning.with_bin_ids(binned, summary, cuts), summary


def _flat(t: DataFrame, *keys: str, params: Sequence[str] = tuple(LINE)) -> DataFrame:
    d = len(params)
    cols = [F.round(F.col("mean")[i], 6).alias(f"mean_{p}") for i, p in enumerate(params)]
    cols += [F.round(F.col("cov")[i * d + j], 6).alias(f"cov_{params[i]}_{params[j]}") for i in range(d) for j in range(i, d)]
    return t.select(*keys, *cols)


def _summary_query(vectors: bool):
    return lambda spark, sf: _placed(spark, sf, vectors)[1].drop("levels")


def _literal(spark, rows, schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _mixtures(spark, sf) -> DataFrame:
    """One-dimensional mixtures of columns of three tables, fitted to all their values."""
    out = _literal(spark, [], univariate.SCHEMA)
    for marker, table, expression, k in COLUMNS:
        rows = _read(spark, sf, table).select(F.expr(expression).alias(marker))
        out = univariate.refit_univariate(rows, {marker: k}, out, 1.0, True) if k else out.unionByName(univariate.fit_univariate(rows, [marker], 3, sample_fraction=1.0))
    return out


def _components(spark, sf) -> DataFrame:
    placed, summary = _placed(spark, sf)
    start = coreset.initial_mixture(placed, summary, LINE, components=MERGED, smallest=50)
    return em.Mixture.collect(start, LINE).table(spark)


def _merged(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Components, and which cluster each belongs to."""
    components = _components(spark, sf)
    return components, merge.component_clusters(components, LINE, MERGE_CUTS)


def _mapping(spark, sf) -> DataFrame:
    return _merged(spark, sf)[1]


def _rules(spark) -> DataFrame:
    return _literal(spark, RULES, "rule_order int, label string, qty string, price string")


def _values(rows, names: str) -> str:
    cell = lambda x: f"'{x}'" if isinstance(x, str) else f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else repr(x)
    return f"(VALUES {', '.join('(' + ', '.join(cell(x) for x in r) + ')' for r in rows)}) AS t({names})"


_COMPONENT_SQL = (
    f"{LINES}, {_binned_sql(LINE_CUTS)}, {_BINS}, q AS (SELECT * FROM r WHERE size_rank <= {MERGED} AND n > 50), u AS (SELECT size_rank AS component, count(*) AS n, "
    + ", ".join(f"avg({p}) AS a{i + 1}, coalesce(var_samp({p}), 0) + 0.01 AS v{i + 1}" for i, p in enumerate(LINE))
    + " FROM b JOIN q ON b.bin_key = q.bin_key GROUP BY 1), c AS (SELECT *, n / sum(n) OVER () AS pro FROM u)"
)
_KEY = ", ".join(_level_sql(f"a{i + 1}", MERGE_CUTS.get(m, [])) for i, m in enumerate(LINE))
_MAP_SQL = f"{_COMPONENT_SQL}, k AS (SELECT *, [{_KEY}] AS levels FROM c), f AS (SELECT *, min(component) OVER (PARTITION BY levels) AS first FROM k), g AS (SELECT *, dense_rank() OVER (ORDER BY first) AS cluster FROM f)"
_CLUSTER_SQL = f"{_MAP_SQL}, cl AS (SELECT DISTINCT cluster, levels[1] AS m1, levels[2] AS m2, levels[3] AS m3 FROM g)"
_LONG_SQL = f"{_MAP_SQL}, l AS (" + " UNION ALL ".join(f"SELECT cluster, pro, '{m}' AS marker, a{i + 1} AS mean, v{i + 1} AS var FROM g" for i, m in enumerate(LINE)) + "), ctr AS (SELECT cluster, marker, sum(pro * mean) / sum(pro) AS center FROM l GROUP BY 1, 2)"
_SD_SQL = f"{_LONG_SQL}, sd AS (SELECT l.cluster, l.marker, any_value(center) AS center, sqrt(sum(pro * (var + (mean - center) * (mean - center))) / sum(pro)) AS sd FROM l JOIN ctr ON l.cluster = ctr.cluster AND l.marker = ctr.marker GROUP BY 1, 2)"


def _density_sql(k: int) -> str:
    p = np.linalg.inv(MODEL.cov[k])
    const = float(math.log(MODEL.pro[k]) - 0.5 * (2 * math.log(2 * math.pi) + np.linalg.slogdet(MODEL.cov[k])[1]))
    a, b = (f"(x{i} - ({float(MODEL.mean[k, i])!r}))" for i in range(2))
    return f"({const!r} - 0.5 * ({float(p[0, 0])!r} * {a} * {a} + 2 * ({float(p[0, 1])!r}) * {a} * {b} + {float(p[1, 1])!r} * {b} * {b}))"


_Z = f"WITH {VECTORS}, z AS (SELECT vec_id, x0, x1, " + ", ".join(f"{_density_sql(k)} AS z{k + 1}" for k in range(3)) + " FROM v)"
_TOTAL = "t AS (SELECT *, greatest(z1, z2, z3) + ln(exp(z1 - greatest(z1, z2, z3)) + exp(z2 - greatest(z1, z2, z3)) + exp(z3 - greatest(z1, z2, z3))) AS total FROM z)"
_R = f"{_Z}, {_TOTAL}, r AS (" + " UNION ALL ".join(f"SELECT vec_id, x0, x1, {k} AS component, exp(z{k} - total) AS r, 1.0 + vec_id % 3 AS w FROM t" for k in (1, 2, 3)) + ")"
_WHICH = "CASE WHEN z1 >= z2 AND z1 >= z3 THEN 1 WHEN z2 >= z3 THEN 2 ELSE 3 END"


def _by_batch(df: DataFrame, work, schema: str) -> DataFrame:
    def run(batches):
        for b in batches:
            if len(b):
                yield work(b)

    return df.mapInPandas(run, schema)


def e_step(spark, sf):
    def work(b: pd.DataFrame) -> pd.DataFrame:
        r, _ = em.responsibilities(b[["x0", "x1"]].to_numpy(float), MODEL)
        return pd.DataFrame({"vec_id": np.repeat(b.vec_id.to_numpy(), 3), "component": np.tile([1, 2, 3], len(b)), "r": r.ravel()})

    return _by_batch(_vectors(spark, sf).select("vec_id", "x0", "x1"), work, "vec_id long, component int, r double").select("vec_id", "component", F.round("r", 6).alias("r"))


def weighted_loglik(spark, sf):
    def work(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"l": em.responsibilities(b[["x0", "x1"]].to_numpy(float), MODEL)[1] * (1 + b.vec_id.to_numpy() % 3)})

    return _by_batch(_vectors(spark, sf).select("vec_id", "x0", "x1"), work, "l double").agg(F.round(F.sum("l"), 5).alias("loglik"))


def _core(spark, sf) -> DataFrame:
    """The vectors as single representatives with weights and a small covariance of their own."""
    own = F.array(F.lit(0.001), F.lit(0.0), F.lit(0.0), F.lit(0.002))
    return _vectors(spark, sf).select((F.lit(1.0) + F.col("vec_id") % 3).alias("weight"), F.array("x0", "x1").alias("mean"), own.alias("cov"))


def _model_rows(spark, model: em.Mixture) -> DataFrame:
    rows = [(k + 1, *(round(float(x), 6) for x in (model.pro[k], *model.mean[k], model.cov[k, 0, 0], model.cov[k, 0, 1], model.cov[k, 1, 1]))) for k in range(len(model.pro))]
    return spark.createDataFrame(rows, "component int, pro double, mean_0 double, mean_1 double, cov_00 double, cov_01 double, cov_11 double")


def m_step(spark, sf):
    core = _core(spark, sf)
    total = core.agg(F.sum("weight")).first()[0]
    return _model_rows(spark, em.updated(em._distributed(core, MODEL, total), MODEL.params))


def variance_correction(spark, sf):
    core = _core(spark, sf)
    total = core.agg(F.sum("weight")).first()[0]
    s = em._distributed(core, MODEL, total)
    return _model_rows(spark, em.Mixture(MODEL.params, MODEL.pro, MODEL.mean, MODEL.cov + s.v / MODEL.pro[:, None, None]))


def em_fit(spark, sf):
    return _model_rows(spark, em.weighted_em(_core(spark, sf), MODEL))


def fit_predict_flagship(spark, sf):
    scaled = _vectors(spark, sf).select("vec_id", *[(F.col(d) * 10).alias(d) for d in DIMS])
    none = spark.createDataFrame([], univariate.SCHEMA)
    two = univariate.refit_univariate(scaled, dict.fromkeys(DIMS, 2), none, sample_fraction=1.0)
    model = MixtureClusterer(params=DIMS, components=12, min_cluster_fraction=0.005, univariate=two, min_cutoff=-10.0).fit(scaled)
    scored = model.transform(scaled)
    return scored.groupBy("component", "cluster").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(d), 6).alias(f"mean_{d}") for d in DIMS])


PLANE = ["x0", "x1"]


def fit_predict_whole(spark, sf):
    """Fit and predict end to end, deterministic: two components a column, halves at medians, all rows."""
    rows = _vectors(spark, sf).select("vec_id", *[(F.col(d) * 10).alias(d) for d in PLANE])
    two = univariate.refit_univariate(rows, dict.fromkeys(PLANE, 2), spark.createDataFrame([], univariate.SCHEMA), sample_fraction=1.0)
    model = MixtureClusterer(params=PLANE, components=12, min_cluster_fraction=0.005, min_bin_size=5, max_bin_size=50, univariate=two, splitter="median", min_cutoff=-10.0).fit(rows)
    found = model.components().select("component", F.round("pro", 4).alias("pro"), *[F.round(F.col("mean")[i], 4).alias(f"mean_{d}") for i, d in enumerate(PLANE)])
    return model.transform(rows).groupBy("component", "cluster").agg(F.count(F.lit(1)).alias("n")).join(found, "component", "right").select("component", "cluster", "n", "pro", "mean_x0", "mean_x1")


#: Cutoffs that make some hundreds of bins of lineitem, so that many components start.
FINE_CUTS = {"qty": [1.0, 2.0, 3.0, 4.0], "price": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0], "disc": [0.5, 1.0, 1.5]}


def predict_many(spark, sf):
    """Rows of lineitem by the densest of up to a hundred components."""
    binned = binning.with_bins(_lines(spark, sf), FINE_CUTS)
    summary = binning.bin_summary(binned, FINE_CUTS)
    placed = binning.with_bin_ids(binned, summary, FINE_CUTS)
    model = em.Mixture.collect(coreset.initial_mixture(placed, summary, LINE, components=100, smallest=50), LINE)
    return predict.with_component(_lines(spark, sf), model).groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("qty"), 4).alias("total_qty"))


def _events(spark, sf) -> DataFrame:
    return _read(spark, sf, "events").select("event_id", "event_type", F.col("value").cast("double").alias("value"))


def _gmm1d(spark, sf):
    lines = _lines(spark, sf).select("qty", "price")
    return univariate.fit_univariate_default(_events(spark, sf).select("value"), ["value"]).unionByName(univariate.fit_univariate_default(lines, ["qty", "price"]))


_KDE = "e AS (SELECT 'value' AS marker, CAST(value AS DOUBLE) AS x, event_type FROM events WHERE value IS NOT NULL AND NOT isnan(value))"


def _kde_sql(name: str, where: str = "TRUE") -> str:
    """CTEs {name}_r (range), {name}_b (bins) and {name} (curve)."""
    return f"""{name}_p AS (SELECT * FROM e WHERE {where}),
{name}_q AS (SELECT marker, count(*) AS n, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx FROM {name}_p GROUP BY marker),
{name}_h AS (SELECT *, pow(1 / (4 * pi()), 0.1) * pow(243.0 / (35.0 * n), 0.2) * sd AS h FROM {name}_q),
{name}_r AS (SELECT *, mn - 4 * h AS low, mx + 4 * h AS high FROM {name}_h),
{name}_a AS (SELECT p.marker, (p.x - r.low) * 400 / (r.high - r.low) AS pos FROM {name}_p p JOIN {name}_r r ON p.marker = r.marker),
{name}_c AS (SELECT marker, CAST(floor(pos) AS INTEGER) AS grid_idx, 1 - (pos - floor(pos)) AS m FROM {name}_a UNION ALL SELECT marker, CAST(floor(pos) AS INTEGER) + 1, pos - floor(pos) FROM {name}_a),
{name}_b AS (SELECT marker, grid_idx, sum(m) AS mass FROM {name}_c GROUP BY 1, 2 HAVING sum(m) > 0),
{name}_g AS (SELECT r.*, CAST(i AS INTEGER) AS gi, (high - low) / 400 AS step FROM {name}_r r, range(401) AS t(i)),
{name} AS (SELECT g.marker, g.gi AS grid_idx, any_value(low + gi * step) AS x, sum(b.mass * exp(-0.5 * pow((g.gi - b.grid_idx) * step / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS y FROM {name}_g g JOIN {name}_b b ON g.marker = b.marker GROUP BY 1, 2)"""


_ROUND_XY = "round(x, 5) AS x, round(y, 8) AS y"


def _xy() -> tuple:
    return F.round("x", 5).alias("x"), F.round("y", 8).alias("y")


VALUE_MIX = [("value", 1, 0.7, 30.0, 400.0), ("value", 2, 0.3, 120.0, 2500.0)]
_CURVES = (
    "WITH e AS (SELECT min(value) AS low, max(value) AS high FROM events WHERE NOT isnan(value)), g AS (SELECT i AS idx, low + (high - low) * i / 499 AS x FROM e, range(500) AS t(i)), m AS (SELECT * FROM "
    + _values(VALUE_MIX, "marker, component, pro, mean, var")
    + "), d AS (SELECT marker, component, CAST(idx AS INTEGER) AS idx, x, pro * exp(-0.5 * pow((x - mean) / sqrt(var), 2)) / (sqrt(var) * sqrt(2 * pi())) AS y FROM g, m)"
)


def _value_curves(spark, sf) -> DataFrame:
    return summaries.mixture_curves(_events(spark, sf).select("value"), _literal(spark, VALUE_MIX, univariate.SCHEMA), ["value"])


def _cut_table(spark) -> DataFrame:
    return _literal(spark, [(m, i + 1, c) for m, cs in MERGE_CUTS.items() for i, c in enumerate(cs)], "marker string, cut_idx int, cutoff double")


def _embedding_centers(spark, sf) -> DataFrame:
    long = _read(spark, sf, "embeddings").select((F.col("label") + 1).cast("int").alias("cluster"), F.posexplode(F.slice("embedding", 1, 4)).alias("i", "x"))
    return long.groupBy("cluster", F.concat(F.lit("x"), F.col("i")).alias("marker")).agg(F.avg(F.col("x").cast("double")).alias("center"))


def median_split(spark, sf):
    """The weighted set of lineitem's bins, large ones halved at medians down to the default size."""
    placed, summary = _placed(spark, sf)
    n = int(summary.agg(F.sum("n")).first()[0])
    pieces = coreset.coreset(placed, LINE, smallest=1, largest=coreset.max_bin_size(n), splitter="median")
    return pieces.select("bin_id", "piece", "weight", *[F.round(F.col("mean")[i] * F.col("weight"), 6).alias(f"total_{p}") for i, p in enumerate(LINE)])


def _median_sql(levels: int = 12) -> str:
    """Level by level, as deep as each bin's size asks for."""
    depth = "CASE " + " ".join(f"WHEN k <= {1 << i} THEN {i}" for i in range(levels)) + f" ELSE {levels} END"
    out = [
        f"{_LINE_BINS}, t AS (SELECT greatest(50, ceil(count(*) / 10000.0)) AS largest FROM b)",
        f"p0 AS MATERIALIZED (SELECT CAST(bin_id AS INTEGER) AS bin_id, qty, price, disc, 0 AS path, {depth} AS depth FROM (SELECT b.*, bin_id, ceil(n / largest) AS k FROM b JOIN s ON b.bin_key = s.bin_key, t))",
    ]
    for i in range(levels):
        out += [
            f"w{i} AS MATERIALIZED (SELECT bin_id, path, count(*) AS m, stddev_pop(qty) AS a, stddev_pop(price) AS c, stddev_pop(disc) AS d, median(qty) AS ma, median(price) AS mc, median(disc) AS md FROM p{i} WHERE depth > {i} GROUP BY 1, 2)",
            f"p{i + 1} AS MATERIALIZED (SELECT p.bin_id, qty, price, disc, CASE WHEN m IS NULL THEN p.path WHEN m = 1 THEN 2 * p.path ELSE 2 * p.path + CAST(CASE WHEN a >= c AND a >= d THEN qty >= ma WHEN c >= d THEN price >= mc ELSE disc >= md END AS INTEGER) END AS path, depth FROM p{i} AS p LEFT JOIN w{i} AS w ON p.bin_id = w.bin_id AND p.path = w.path AND depth > {i})",
        ]
    last = f"SELECT bin_id, path, count(*) AS weight, round(sum(qty), 6) AS total_qty, round(sum(price), 6) AS total_price, round(sum(disc), 6) AS total_disc FROM p{levels} GROUP BY 1, 2"
    return ",\n".join(out) + f"\nSELECT bin_id, row_number() OVER (PARTITION BY bin_id ORDER BY path) AS piece, weight, total_qty, total_price, total_disc FROM ({last})"


def kmeans_coreset(spark, sf):
    placed, summary = _placed(spark, sf, vectors=True)
    return coreset.coreset(placed, DIMS, smallest=5, largest=50).select("bin_id", "piece", "weight", *[F.col("mean")[i].alias(f"mean_{d}") for i, d in enumerate(DIMS)])


def _fx(at: str) -> str:
    one = lambda p, m, s: f"{p} * exp(-0.5 * pow(({at} - {m}) / {s}, 2)) / ({s} * sqrt(2 * pi()))"
    return f"({one('p1', 'm1', 's1')} - {one('p2', 'm2', 's2')})"


def bic_bias(spark, sf):
    counts = _events(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each of a few kinds
    return _literal(spark, [(r.event_type, r.n, k, round(complexity_bias(r.n, k), 6)) for r in counts for k in (1, 2, 3)], "event_type string, n long, k int, bias double")


def neg_split(spark, sf):
    rows = _read(spark, sf, "customer").select("c_acctbal")
    fits = univariate.refit_univariate(rows, {"c_acctbal": 1}, _literal(spark, [], univariate.SCHEMA), sample_fraction=1.0, separate_negative=True)
    return fits.select("comp", F.round("pro", 8).alias("pro"), F.round("mean", 5).alias("mean"), F.round("var", 2).alias("var"))


def _em_tables(core: str, start: str, steps: int = 10, threshold: float = 0.05, ridge: float = 0.01) -> list[str]:
    """The whole weighted EM in two dimensions: all steps are written out, and the one that ends the loop is chosen. The last table, ``fitted``, is the result.

    ``core``: a query of id, w, x0, x1 and the representatives' own covariances o00, o01, o11; ``start``: one of component,
    pro, a, b, c00, c01, c11.
    """
    out = [f"p AS MATERIALIZED ({core})", "n AS MATERIALIZED (SELECT count(*) AS m, sum(w) AS total FROM p)", f"m0 AS MATERIALIZED ({start})"]
    scatter = lambda u, v: f"m / s0 * (({u}{v} - t{u} * t{v} / m) / (m - 1) + t{u} * t{v} / (m * m)) - s{u} * s{v} / (s0 * s0)"
    for i in range(steps + 1):
        out += [
            f"z{i} AS MATERIALIZED (SELECT p.*, component, ln(pro) - ln(2 * pi()) - 0.5 * ln(c00 * c11 - c01 * c01) - 0.5 * (c11 * pow(x0 - a, 2) - 2 * c01 * (x0 - a) * (x1 - b) + c00 * pow(x1 - b, 2)) / (c00 * c11 - c01 * c01) AS z FROM p, m{i})",
            f"t{i} AS MATERIALIZED (SELECT id, any_value(w) AS w, any_value(top) + ln(sum(exp(z - top))) AS whole FROM (SELECT *, max(z) OVER (PARTITION BY id) AS top FROM z{i}) GROUP BY id)",
            f"l{i} AS MATERIALIZED (SELECT sum(w * whole) / any_value(total) AS l FROM t{i}, n)",
            f"q{i} AS (SELECT component, x0, x1, o00, o01, o11, m, z.w * exp(z - whole) / total AS wr FROM z{i} AS z JOIN t{i} AS t ON z.id = t.id, n)",
            f"s{i} AS MATERIALIZED (SELECT component, any_value(m) AS m, sum(wr) AS s0, sum(wr * x0) AS sa, sum(wr * x1) AS sb, sum(wr * x0 * x0) AS aa, sum(wr * x0 * x1) AS ab, sum(wr * x1 * x1) AS bb, sum(sqrt(wr) * x0) AS ta, sum(sqrt(wr) * x1) AS tb, sum(wr * o00) AS v00, sum(wr * o01) AS v01, sum(wr * o11) AS v11 FROM q{i} GROUP BY 1)",
            f"m{i + 1} AS MATERIALIZED (SELECT component, s0 AS pro, sa / s0 AS a, sb / s0 AS b, {scatter('a', 'a')} + {ridge} AS c00, {scatter('a', 'b')} AS c01, {scatter('b', 'b')} + {ridge} AS c11 FROM s{i})",
        ]
    ends = " UNION ALL ".join(f"SELECT {t} AS t, abs((y.l - x.l) / x.l) < {threshold} AS over FROM l{t - 1} AS x, l{t} AS y" for t in range(2, steps + 1))
    out.append(f"e AS MATERIALIZED (SELECT min(t) AS t FROM ({ends}) WHERE over)")
    chosen = [f"SELECT m.component, pro, a, b, c00 + v00 / pro AS c00, c01 + v01 / pro AS c01, c11 + v11 / pro AS c11 FROM m{t - 1} AS m JOIN s{t - 1} AS s ON m.component = s.component, e WHERE e.t = {t}" for t in range(2, steps + 1)]
    chosen.append(f"SELECT m.* FROM m{steps} AS m, e WHERE e.t IS NULL")
    out.append(f"fitted AS MATERIALIZED ({' UNION ALL '.join(chosen)})")
    return out


def _em_sql() -> str:
    start = _values([(k + 1, float(MODEL.pro[k] / MODEL.pro.sum()), *map(float, MODEL.mean[k]), *map(float, (MODEL.cov[k, 0, 0], MODEL.cov[k, 0, 1], MODEL.cov[k, 1, 1]))) for k in range(len(MODEL.pro))], "component, pro, a, b, c00, c01, c11")
    tables = _em_tables("SELECT vec_id AS id, 1.0 + vec_id % 3 AS w, x0, x1, 0.001 AS o00, 0.0 AS o01, 0.002 AS o11 FROM v", f"SELECT * FROM {start}")
    shown = ", ".join(f"round({c}, 6) AS {name}" for c, name in (("pro", "pro"), ("a", "mean_0"), ("b", "mean_1"), ("c00", "cov_00"), ("c01", "cov_01"), ("c11", "cov_11")))
    return f"WITH {VECTORS}, " + ",\n".join(tables) + f" SELECT CAST(component AS INTEGER) AS component, {shown} FROM fitted"


def whole_fit(spark, sf, criterion: str = "bic"):
    """The choice between one, two and three components on all values."""
    fits = univariate.fit_univariate(_events(spark, sf).select("value"), ["value"], 3, criterion, sample_fraction=1.0)
    return fits.select("marker", "comp", F.round("pro", 6).alias("pro"), F.round("mean", 4).alias("mean"), F.round("var", 2).alias("var"))


def _fit_sql(values: str, ks: Sequence[int] = (1, 2, 3), icl: bool = False) -> tuple[str, str]:
    """EM for each number of normals, on a histogram and from there on all values, and the choice by biased BIC or by ICL: tables, and a query of pro, mean and var.

    ``values``: a table of x without nulls. A row of ``em`` is a step of the fit with k components to the cells of the
    histogram, one of ``em2`` a step on the values; components beyond k have no density.
    """
    js = range(1, max(ks) + 1)
    each = lambda f, sep=", ": sep.join(f(j) for j in js)
    top = f"greatest({each(lambda j: f'z{j}')})"
    z = each(lambda j: f"CASE WHEN k >= {j} THEN ln(s{j}) - 0.5 * (ln(2 * pi() * v{j}) + pow(x - m{j}, 2) / v{j}) ELSE -1e300 END AS z{j}")
    whole = f"{top} + ln({each(lambda j: f'exp(z{j} - {top})', ' + ')})"
    held = each(lambda j: f"any_value(s{j}) AS s{j}, any_value(m{j}) AS m{j}, any_value(v{j}) AS v{j}")
    moments = each(lambda j: f"sum(r{j}) / any_value(n) AS s{j}, sum(r{j} * x) / sum(r{j}) AS m{j}, greatest(sum(r{j} * x * x) / sum(r{j}) - pow(sum(r{j} * x) / sum(r{j}), 2), any_value(least_var)) AS v{j}")
    scored = lambda points, source, before: f"SELECT k, any_value(t) AS t, {held}, sum(w * ({whole})) AS l, sum(w * ({top} - ({whole}))) AS ce, any_value({before}) AS before FROM (SELECT q.*, {z} FROM (SELECT * FROM ({source}) AS n, {points}) AS q) GROUP BY k"
    hard = each(lambda j: f"CASE WHEN least(floor((reach - w / 2) / n * k), k - 1) = {j - 1} THEN w ELSE 0.0 END AS r{j}")
    start = f"SELECT k, 1 AS t, {moments} FROM (SELECT h.*, k, {hard} FROM h, (SELECT unnest({list(ks)}) AS k)) GROUP BY k"
    soft = each(lambda j: f"CASE WHEN k >= {j} THEN w * exp(z{j} - ({whole})) ELSE 0.0 END AS r{j}")
    again = lambda em, points: f"SELECT k, any_value(t) + 1 AS t, any_value(l) AS l0, {moments} FROM (SELECT *, {soft} FROM (SELECT e.*, {points}.*, {z} FROM {em} AS e, {points} WHERE t < 500 AND (before IS NULL OR NOT abs(l - before) < 1e-6 * abs(l)))) GROUP BY k"
    last = lambda em: f"SELECT * FROM {em} QUALIFY row_number() OVER (PARTITION BY k ORDER BY t DESC) = 1"
    none = "CAST(NULL AS DOUBLE)"
    rows = " UNION ALL ".join(f"SELECT s{j} AS pro, m{j} + centre AS mean, v{j} AS var FROM best, (SELECT any_value(centre) AS centre FROM p) WHERE k >= {j}" for j in js)
    tables = f"""a AS ({values}), c AS (SELECT avg(x) AS centre, greatest(1e-10, 1e-8 * var_pop(x)) AS least_var, count(*) AS n, min(x) AS low, max(x) AS high FROM a),
p AS MATERIALIZED (SELECT x - centre AS x, CAST(1 AS DOUBLE) AS w, centre, least_var, n FROM a, c),
cells AS (SELECT avg(x) AS x, CAST(count(*) AS DOUBLE) AS w FROM (SELECT x, least(floor((x - low) / (high - low) * 8192), 8191) AS cell FROM a, c) GROUP BY cell),
h AS MATERIALIZED (SELECT x - centre AS x, w, least_var, n, sum(w) OVER (ORDER BY x) AS reach FROM cells, c),
em AS ({scored("h", start, none)} UNION ALL {scored("h", again("em", "h"), "l0")}),
em2 AS ({scored("p", f"SELECT k, 0 AS t, {each(lambda j: f's{j}, m{j}, v{j}')} FROM ({last('em')})", none)} UNION ALL {scored("p", again("em2", "p"), "l0")}),
done AS ({last("em2")}),
best AS (SELECT done.* FROM done, c ORDER BY 2 * l - (3 * k - 1) * ln(n) {"+ 2 * ce" if icl else "- exp(-3.7 + 0.732 * ln(n)) * k * log2(n)"} DESC, k LIMIT 1)"""
    return tables, rows


_COMPS = "CAST(row_number() OVER (ORDER BY mean) AS INTEGER) AS comp, round(pro, 6) AS pro, round(mean, 4) AS mean, round(var, 2) AS var"


def _whole_fit_sql(icl: bool = False) -> str:
    tables, rows = _fit_sql("SELECT CAST(value AS DOUBLE) AS x FROM events WHERE value IS NOT NULL AND NOT isnan(value)", icl=icl)
    return f"WITH RECURSIVE {tables} SELECT 'value' AS marker, {_COMPS} FROM ({rows})"


def whole_refit(spark, sf):
    """Two components for the positive values and one for the negative ones, beside the mixtures of other markers."""
    fits = univariate.refit_univariate(_read(spark, sf, "customer").select("c_acctbal"), {"c_acctbal": 2}, _literal(spark, OTHER, univariate.SCHEMA), sample_fraction=1.0, separate_negative=True)
    return fits.select("marker", "comp", F.round("pro", 6).alias("pro"), F.round("mean", 4).alias("mean"), F.round("var", 2).alias("var"))


def _whole_refit_sql() -> str:
    tables, rows = _fit_sql("SELECT CAST(c_acctbal AS DOUBLE) AS x FROM customer WHERE c_acctbal > 0", (2,))
    low = "low AS (SELECT count(*) AS n, avg(x) AS mean, var_samp(x) AS var FROM (SELECT CAST(c_acctbal AS DOUBLE) AS x FROM customer WHERE c_acctbal < 0)), share AS (SELECT low.n / (low.n + c.n) AS low FROM low, c)"
    every = f"SELECT pro * (1 - low) AS pro, mean, var FROM ({rows}), share UNION ALL SELECT share.low, mean, var FROM low, share"
    kept = f"SELECT marker, CAST(comp AS INTEGER) AS comp, pro, mean, var FROM {_values(OTHER, 'marker, comp, pro, mean, var')}"
    return f"WITH RECURSIVE {tables}, {low} SELECT 'c_acctbal' AS marker, {_COMPS} FROM ({every}) UNION ALL {kept}"


def _fitted_sql() -> str:
    """Table mix: what ``_mixtures`` fits."""
    parts = []
    for marker, table, expression, k in COLUMNS:
        tables, rows = _fit_sql(f"SELECT {expression} AS x FROM {table} WHERE {'value IS NOT NULL AND NOT isnan(value)' if marker == 'amount' else f'{expression} > 0' if k else 'o_totalprice IS NOT NULL'}", (k,) if k else (1, 2, 3))
        if k:
            low = f"low AS (SELECT count(*) AS n, avg(x) AS mean, var_samp(x) AS var FROM (SELECT {expression} AS x FROM {table}) WHERE x < 0), share AS (SELECT low.n / (low.n + c.n) AS low FROM low, c)"
            tables, rows = f"{tables}, {low}", f"SELECT pro * (1 - low) AS pro, mean, var FROM ({rows}), share UNION ALL SELECT share.low, mean, var FROM low, share"
        parts.append(f"SELECT '{marker}' AS marker, row_number() OVER (ORDER BY mean) AS comp, pro, mean, var FROM (WITH RECURSIVE {tables} {rows})")
    return f"mix AS MATERIALIZED ({' UNION ALL '.join(parts)})"


_MIX = _fitted_sql()
_ADJACENT = _MIX + ", adj AS (SELECT * FROM (SELECT marker, CAST(comp AS INTEGER) AS comp, pro, mean, var, " + ", ".join(f"lead({c}) OVER (PARTITION BY marker ORDER BY comp) AS next_{c}" for c in ("pro", "mean", "var")) + " FROM mix) WHERE next_mean IS NOT NULL)"
_BISECTION = f"""WITH RECURSIVE {_ADJACENT}, args AS (SELECT marker, comp, pro AS p1, mean AS m1, sqrt(var) AS s1, next_pro AS p2, next_mean AS m2, sqrt(next_var) AS s2 FROM adj),
s AS (SELECT marker, comp, p1, m1, s1, p2, m2, s2, 1 AS stage, m1 AS lo, m2 AS hi, CAST(NULL AS DOUBLE) AS found FROM args
UNION ALL
SELECT marker, comp, p1, m1, s1, p2, m2, s2,
  CASE WHEN got IS NULL THEN stage WHEN stage = 1 AND abs(got - m1) < 1e-4 THEN 2 WHEN stage < 3 AND abs(got - m2) < 1e-4 THEN 3 ELSE stage END,
  CASE WHEN got IS NULL THEN CASE WHEN right_half THEN mid ELSE lo END WHEN stage = 1 AND abs(got - m1) < 1e-4 THEN m1 - s1 WHEN stage < 3 AND abs(got - m2) < 1e-4 THEN m2 ELSE lo END,
  CASE WHEN got IS NULL THEN CASE WHEN right_half THEN hi ELSE mid END WHEN stage = 1 AND abs(got - m1) < 1e-4 THEN m1 WHEN stage < 3 AND abs(got - m2) < 1e-4 THEN m2 + s2 ELSE hi END,
  CASE WHEN got IS NULL OR stage = 1 AND abs(got - m1) < 1e-4 OR stage < 3 AND abs(got - m2) < 1e-4 THEN NULL ELSE got END
FROM (SELECT *, CASE WHEN abs(fm) < 1e-4 THEN mid WHEN hi - mid < 1e-4 THEN hi WHEN mid - lo < 1e-4 THEN lo END AS got, (CASE WHEN fh >= fl THEN 1 ELSE -1 END) * fm < 0 AS right_half
  FROM (SELECT *, {_fx("mid")} AS fm, {_fx("hi")} AS fh, {_fx("lo")} AS fl FROM (SELECT *, (lo + hi) / 2 AS mid FROM s WHERE found IS NULL)))), pos AS (SELECT marker, CAST(comp AS INTEGER) AS comp, found AS pos FROM s WHERE found IS NOT NULL)"""
_SIX = ("pro", "mean", "var", "next_pro", "next_mean", "next_var")


def curves(spark, sf):
    """All panels: the density estimate, the mixture and its components."""
    out = summaries.univariate_curves(_events(spark, sf).select("value"), _literal(spark, VALUE_MIX, univariate.SCHEMA), ["value"])
    return out.select("panel", "component", *_xy())


def labels(spark, sf):
    components, mapping = _merged(spark, sf)
    clusters = merge.phenotypes(mapping, LINE)
    rules = _rules(spark)
    return labeling.label_strings(clusters, labeling.first_match(clusters, rules, ["qty", "price"]), rules, ["qty", "price"])


def _reduce_sql(threshold: float = 1.0, most: float = 0.45, rounds: int = 2) -> str:
    """Low components, at most three a marker, pooled pair by pair: the cheapest first."""
    out = [f"WITH RECURSIVE {_MIX}", f"r0 AS (SELECT *, mean < {threshold} AND count(*) FILTER (mean < {threshold}) OVER (PARTITION BY marker) > 1 AS low FROM mix)"]
    for i in range(rounds):
        out += [
            f"x{i} AS (SELECT a.marker, a.comp AS i, b.comp AS j, a.pro + b.pro AS p, (a.pro * a.mean + b.pro * b.mean) / (a.pro + b.pro) AS m, a.pro AS p1, a.mean AS m1, a.var AS v1, b.pro AS p2, b.mean AS m2, b.var AS v2 FROM r{i} a JOIN r{i} b ON a.marker = b.marker AND a.comp < b.comp AND a.low AND b.low)",
            f"y{i} AS (SELECT *, (p1 * (v1 + pow(m1 - m, 2)) + p2 * (v2 + pow(m2 - m, 2))) / p AS v FROM x{i})",
            f"w{i} AS (SELECT *, 0.5 * (p * ln(v) - p1 * ln(v1) - p2 * ln(v2)) AS cost FROM y{i} QUALIFY row_number() OVER (PARTITION BY marker ORDER BY cost, i, j) = 1)",
            f"g{i} AS (SELECT * FROM w{i} WHERE cost <= {most})",
            f"u{i} AS (SELECT r.marker, r.pro, r.mean, r.var, r.low FROM r{i} r LEFT JOIN g{i} g ON r.marker = g.marker AND r.comp IN (g.i, g.j) WHERE g.marker IS NULL UNION ALL SELECT marker, p, m, v, TRUE FROM g{i})",
            f"r{i + 1} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY marker ORDER BY mean) AS comp FROM u{i})",
        ]
    return ",\n".join(out) + f" SELECT marker, CAST(comp AS INTEGER) AS comp, round(pro, 5) AS pro, round(mean, 5) AS mean, round(var, 5) AS var FROM r{rounds}"


def _whole_flagship_sql(largest: int = 50, smallest: int = 5, levels: int = 8) -> str:
    """Every stage of ``fit_predict_whole``."""
    mixes = []
    for d in PLANE:
        tables, rows = _fit_sql(f"SELECT {d} AS x FROM v10", (2,))
        mixes.append(f"SELECT '{d}' AS marker, row_number() OVER (ORDER BY mean) AS comp, pro, mean, var FROM (WITH RECURSIVE {tables} {rows})")
    bisection = _BISECTION.replace("WITH RECURSIVE ", "", 1).replace(_MIX, f"mix AS MATERIALIZED ({' UNION ALL '.join(mixes)})").replace("s AS (SELECT marker, comp, p1", "bs AS (SELECT marker, comp, p1").replace("FROM s WHERE found", "FROM bs WHERE found")
    depth = "CASE " + " ".join(f"WHEN k <= {1 << i} THEN {i}" for i in range(levels)) + f" ELSE {levels} END"
    out = [
        f"{VECTORS}, v10 AS MATERIALIZED (SELECT vec_id, x0 * 10 AS x0, x1 * 10 AS x1 FROM v)",
        bisection,
        "cuts AS MATERIALIZED (SELECT max(pos) FILTER (marker = 'x0') AS cut0, max(pos) FILTER (marker = 'x1') AS cut1 FROM pos WHERE pos >= -10)",
        "lv AS MATERIALIZED (SELECT v10.*, 1 + CASE WHEN x0 > cut0 THEN 1 ELSE 0 END AS l0, 1 + CASE WHEN x1 > cut1 THEN 1 ELSE 0 END AS l1 FROM v10, cuts)",
        "bn AS (SELECT l0, l1, count(*) AS bn, row_number() OVER (ORDER BY l0, l1) AS bin_id FROM lv GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (ORDER BY bn DESC, bin_id DESC) AS size_rank FROM bn)",
        f"h0 AS MATERIALIZED (SELECT lv.*, bin_id, bn, size_rank, 0 AS path, {depth} AS depth FROM (SELECT *, ceil(bn / {largest}.0) AS k FROM rk) AS rk JOIN lv ON lv.l0 = rk.l0 AND lv.l1 = rk.l1)",
    ]
    for i in range(levels):
        out += [
            f"w{i} AS MATERIALIZED (SELECT bin_id, path, count(*) AS m, stddev_pop(x0) AS a, stddev_pop(x1) AS c, median(x0) AS ma, median(x1) AS mc FROM h{i} WHERE depth > {i} GROUP BY 1, 2)",
            f"h{i + 1} AS MATERIALIZED (SELECT h.* REPLACE (CASE WHEN m IS NULL THEN h.path WHEN m = 1 THEN 2 * h.path ELSE 2 * h.path + CAST(CASE WHEN a >= c THEN x0 >= ma ELSE x1 >= mc END AS INTEGER) END AS path) FROM h{i} AS h LEFT JOIN w{i} AS w ON h.bin_id = w.bin_id AND h.path = w.path AND depth > {i})",
        ]
    core = f"SELECT row_number() OVER () AS id, CAST(count(*) AS DOUBLE) AS w, avg(x0) AS x0, avg(x1) AS x1, coalesce(var_samp(x0), 0) AS o00, coalesce(covar_samp(x0, x1), 0) AS o01, coalesce(var_samp(x1), 0) AS o11 FROM h{levels} WHERE bn >= {smallest} GROUP BY bin_id, path"
    least = "(SELECT ceil(0.005 * count(*)) FROM v10)"
    start = f"SELECT size_rank AS component, count(*) / sum(count(*)) OVER () AS pro, avg(x0) AS a, avg(x1) AS b, var_samp(x0) + 0.01 AS c00, covar_samp(x0, x1) AS c01, var_samp(x1) + 0.01 AS c11 FROM h0 WHERE size_rank <= 12 AND bn > {least} GROUP BY 1"
    out += _em_tables(core, start)
    out += [
        "fk AS (SELECT fitted.*, [1 + CASE WHEN a > cut0 THEN 1 ELSE 0 END, 1 + CASE WHEN b > cut1 THEN 1 ELSE 0 END] AS lev, row_number() OVER (ORDER BY component) AS kk FROM fitted, cuts), ff AS (SELECT *, min(kk) OVER (PARTITION BY lev) AS first FROM fk), fc AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY first) AS cluster FROM ff)",
        "best AS (SELECT kk, count(*) AS n FROM (SELECT vec_id, kk FROM v10, fc QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY ln(pro) - 0.5 * ln(c00 * c11 - c01 * c01) - 0.5 * (c11 * pow(x0 - a, 2) - 2 * c01 * (x0 - a) * (x1 - b) + c00 * pow(x1 - b, 2)) / (c00 * c11 - c01 * c01) DESC, kk) = 1) GROUP BY 1)",
    ]
    return "WITH RECURSIVE " + ",\n".join(out) + " SELECT CAST(fc.kk AS INTEGER) AS component, CASE WHEN n IS NOT NULL THEN CAST(cluster AS INTEGER) END AS cluster, n, round(pro, 4) AS pro, round(a, 4) AS mean_x0, round(b, 4) AS mean_x1 FROM fc LEFT JOIN best ON fc.kk = best.kk"


def _many_sql() -> str:
    cov = ", ".join(f"coalesce(covar_samp({LINE[i]}, {LINE[j]}), 0) + {0.01 if i == j else 0.0} AS c{i}{j}" for i in range(3) for j in range(i, 3))
    det = "c00 * (c11 * c22 - c12 * c12) - c01 * (c01 * c22 - c12 * c02) + c02 * (c01 * c12 - c11 * c02)"
    x, y, w = "(qty - m0)", "(price - m1)", "(disc - m2)"
    form = f"(c11 * c22 - c12 * c12) * {x} * {x} + (c00 * c22 - c02 * c02) * {y} * {y} + (c00 * c11 - c01 * c01) * {w} * {w} + 2 * (c02 * c12 - c01 * c22) * {x} * {y} + 2 * (c01 * c12 - c02 * c11) * {x} * {w} + 2 * (c01 * c02 - c00 * c12) * {y} * {w}"
    return f"""WITH {LINES}, {_binned_sql(FINE_CUTS)}, {_BINS}, q AS (SELECT * FROM r WHERE size_rank <= 100 AND n > 50),
u AS (SELECT size_rank AS component, count(*) AS n, avg(qty) AS m0, avg(price) AS m1, avg(disc) AS m2, {cov} FROM b JOIN q ON b.bin_key = q.bin_key GROUP BY 1),
c AS MATERIALIZED (SELECT *, ln(n / sum(n) OVER ()) AS lp, {det} AS det, row_number() OVER (ORDER BY component) AS k FROM u),
i AS (SELECT *, row_number() OVER () AS row FROM v),
z AS (SELECT row, any_value(qty) AS qty, arg_max(k, lp - 0.5 * ln(det) - 0.5 * ({form}) / det) AS k FROM i, c GROUP BY row)
SELECT CAST(k AS INTEGER) AS component, count(*) AS n, round(sum(qty), 4) AS total_qty FROM z GROUP BY 1"""


QUERIES = {
    "project_features": lambda spark, sf: frame.features(_vectors(spark, sf), DIMS, "vec_id"),
    "sample_topk_hash": lambda spark, sf: _events(spark, sf).withColumn("h", (F.col("event_id") * 7919) % 100003).transform(frame.first_rows, 500, "h", "event_id").select("event_id", "value"),
    "sample_rows_exact": lambda spark, sf: frame.sample_rows(_events(spark, sf), 400).agg(F.count(F.lit(1)).alias("n")),
    "sample_rows_by_id": lambda spark, sf: frame.sample_rows(_events(spark, sf), 400, seed=7, by=["event_id"]).select("event_id", "value"),
    "union_samples": lambda spark, sf: frame.union_samples({t: _events(spark, sf).filter(F.col("event_type") == t).select("value") for t in ("click", "view")}).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")),
    "level_map": lambda spark, sf: binning.with_bins(_vectors(spark, sf), CUTS).select("vec_id", *[F.col("levels")[i].alias(f"level_{m}") for i, m in enumerate(CUTS)], "bin_key"),
    "bin_summary": _summary_query(True),
    "bin_summary_lines": _summary_query(False),
    "bin_ranks_by_range": lambda spark, sf: binning.bin_summary(binning.with_bins(_lines(spark, sf), FINE_CUTS)).drop("levels"),
    "bin_filter_semi": lambda spark, sf: _placed(spark, sf)[0].filter(F.col("bin_n") >= 2000).groupBy("bin_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("qty"), 4).alias("total_qty")),
    "bin_moments": lambda spark, sf: _flat(coreset.moments(_placed(spark, sf)[0], ["bin_id"], LINE), "bin_id", "weight"),
    "n_repr": lambda spark, sf: _placed(spark, sf)[1].select("bin_id", "n", coreset.piece_count(F.col("n"), LARGEST).alias("n_repr")),
    "median_split_coreset": median_split,
    "kmeans_coreset": kmeans_coreset,
    "init_mixture": lambda spark, sf: (lambda p: _flat(coreset.initial_mixture(p[0], p[1], LINE, components=6, smallest=50), "component", "pro"))(_placed(spark, sf)),
    "adjacent_pairs": lambda spark, sf: univariate.adjacent_pairs(_mixtures(spark, sf)).select("marker", "comp", *[F.round(c, 5).alias(c) for c in _SIX]),
    "cutoff_filter": lambda spark, sf: univariate.kept_cutoffs(univariate.crossings(_mixtures(spark, sf))).select("marker", "comp", F.round("pos", 5).alias("pos")),
    "cutoff_bisection": lambda spark, sf: univariate.crossings(_mixtures(spark, sf)).select("marker", "comp", F.round("pos", 5).alias("pos")),
    "gmm1d_bic_bias": bic_bias,
    "gmm1d_fit": _gmm1d,
    "gmm1d_whole": whole_fit,
    "gmm1d_whole_icl": lambda spark, sf: whole_fit(spark, sf, "icl"),
    "gmm1d_whole_refit": whole_refit,
    "gmm1d_refit": lambda spark, sf: univariate.refit_univariate(_read(spark, sf, "customer").select("c_acctbal"), {"c_acctbal": 2}, _literal(spark, OTHER, univariate.SCHEMA), separate_negative=True),
    "neg_split_moments": neg_split,
    "find_to_merge": lambda spark, sf: univariate.merge_candidates(_mixtures(spark, sf)).select("marker", F.array_join(F.transform("comps", lambda x: x.cast("string")), ",").alias("comps")),
    "reduce_low": lambda spark, sf: univariate.reduce_low(_mixtures(spark, sf), 1.0, 0.45).select("marker", "comp", F.round("pro", 5).alias("pro"), F.round("mean", 5).alias("mean"), F.round("var", 5).alias("var")),
    "e_step": e_step,
    "weighted_loglik": weighted_loglik,
    "m_step": m_step,
    "variance_correction": variance_correction,
    "em_fit": em_fit,
    "categorical_merge": lambda spark, sf: _mapping(spark, sf).select("component", F.array_join(F.transform("levels", lambda x: x.cast("string")), "").alias("key"), "cluster"),
    "cluster_centers": lambda spark, sf: merge.cluster_centers(*_merged(spark, sf), LINE).select("cluster", "marker", F.round("center", 8).alias("center")),
    "cluster_sds": lambda spark, sf: merge.cluster_sds(*_merged(spark, sf), LINE).select("cluster", "marker", F.round("center", 8).alias("center"), F.round("sd", 8).alias("sd")),
    "phenotypes": lambda spark, sf: merge.phenotypes(_mapping(spark, sf), LINE),
    "rule_label": lambda spark, sf: labeling.first_match(merge.phenotypes(_mapping(spark, sf), LINE), _rules(spark), ["qty", "price"]),
    "label_string": labels,
    "predict_component": lambda spark, sf: predict.with_component(_vectors(spark, sf), MODEL).select("vec_id", "component"),
    "predict_cluster": lambda spark, sf: predict.with_cluster(predict.with_component(_vectors(spark, sf), MODEL), CLUSTER_OF).select("vec_id", "component", "cluster"),
    "cluster_counts": lambda spark, sf: predict.with_cluster(predict.with_component(_vectors(spark, sf), MODEL), CLUSTER_OF).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")),
    "kde_linear_bin": lambda spark, sf: summaries.kde_bins(_events(spark, sf), ["value"]).select("marker", "grid_idx", F.round("mass", 5).alias("mass")),
    "kde_curve": lambda spark, sf: summaries.kde_table(_events(spark, sf), ["value"]).select("marker", "grid_idx", *_xy()),
    "kde_overlay": lambda spark, sf: summaries.kde(_events(spark, sf), ["value"], _events(spark, sf).filter("event_type = 'click'")).select("series", "marker", "grid_idx", *_xy()),
    "kde_with_cutoffs": lambda spark, sf: summaries.kde_with_cutoffs(_events(spark, sf), {"value": [40.0, 90.0]}, ["value"]).select("marker", "grid_idx", *_xy(), F.size("cutoffs").alias("n_cutoffs")),
    "mixture_curve": lambda spark, sf: _value_curves(spark, sf).filter("component = 0").select("marker", "idx", *_xy()),
    "component_curves": lambda spark, sf: _value_curves(spark, sf).filter("component > 0").select("marker", "component", "idx", *_xy()),
    "univariate_curves": curves,
    "cluster_logsize": lambda spark, sf: summaries.log_sizes(*_merged(spark, sf), 9.0).select("cluster", F.round("share", 8).alias("share"), F.round("logsize", 8).alias("logsize")),
    "legend_marker": lambda spark, sf: summaries.legend_marker(merge.cluster_centers(*_merged(spark, sf), LINE)).select("marker", F.round("amplitude", 8).alias("amplitude")),
    "phenobars": lambda spark, sf: summaries.bars(merge.cluster_sds(*_merged(spark, sf), LINE), _cut_table(spark), ["qty", "price"], [1, 2]).select("cluster", "name", "marker", *[F.round(c, 6).alias(c) for c in ("mfi", "sd", "lo", "hi", "midpt", "ymin", "ymax")]),
    "cluster_vs_global_kde": lambda spark, sf: summaries.cluster_against_all(_events(spark, sf).withColumn("cluster", (F.col("event_id") % 3).cast("int")), [1], ["value"]).select("series", "marker", "grid_idx", F.round("scaled", 7).alias("scaled")),
    "pairwise_center_dist": lambda spark, sf: summaries.center_distances(_embedding_centers(spark, sf)).select("a", "b", F.round("distance", 6).alias("distance")),
    "tsne_clusters": lambda spark, sf: summaries.embedding(_embedding_centers(spark, sf)),
    "fit_predict_flagship": fit_predict_flagship,
    "fit_predict_whole": fit_predict_whole,
    "predict_many": predict_many,
}

ORACLES = {
    "project_features": f"WITH {VECTORS} SELECT * FROM v",
    "sample_topk_hash": "SELECT event_id, CAST(value AS DOUBLE) AS value FROM events ORDER BY (event_id * 7919) % 100003, event_id LIMIT 500",
    "sample_rows_exact": "SELECT least(400, count(*)) AS n FROM events",
    "sample_rows_by_id": "SELECT event_id, CAST(value AS DOUBLE) AS value FROM events ORDER BY md5('7:' || CAST(event_id AS VARCHAR)) LIMIT 400",
    "union_samples": "SELECT event_type AS sample_id, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type IN ('click', 'view') GROUP BY 1",
    "level_map": f"WITH {VECTORS} SELECT vec_id, " + ", ".join(f"CAST({_level_sql(m, c)} AS INTEGER) AS level_{m}" for m, c in CUTS.items()) + f", {' || '.join(f'CAST({_level_sql(m, c)} AS VARCHAR)' for m, c in CUTS.items())} AS bin_key FROM v",
    "bin_summary": f"WITH {VECTORS}, {_binned_sql(CUTS)}, {_SUMMARY}",
    "bin_summary_lines": f"WITH {LINES}, {_binned_sql(LINE_CUTS)}, {_SUMMARY}",
    "bin_ranks_by_range": f"WITH {LINES}, {_binned_sql(FINE_CUTS)}, {_SUMMARY}",
    "bin_filter_semi": f"{_LINE_BINS} SELECT CAST(bin_id AS INTEGER) AS bin_id, count(*) AS n, round(sum(qty), 4) AS total_qty FROM b JOIN s ON b.bin_key = s.bin_key WHERE s.n >= 2000 GROUP BY 1",
    "bin_moments": f"{_LINE_BINS} SELECT CAST(bin_id AS INTEGER) AS bin_id, count(*) AS weight, {_MOMENTS} FROM b JOIN s ON b.bin_key = s.bin_key GROUP BY 1",
    "n_repr": f"{_LINE_BINS} SELECT CAST(bin_id AS INTEGER) AS bin_id, n, CAST(ceil(n / {LARGEST}.0) AS BIGINT) AS n_repr FROM s",
    "median_split_coreset": _median_sql(),
    "init_mixture": f"{_LINE_BINS}, q AS (SELECT * FROM r WHERE size_rank <= 6 AND n > 50) SELECT CAST(size_rank AS INTEGER) AS component, CAST(count(*) AS DOUBLE) AS pro, "
    + ", ".join([*[f"round(avg({p}), 6) AS mean_{p}" for p in LINE], *[f"round(coalesce(covar_samp({LINE[i]}, {LINE[j]}), 0) + {0.01 if i == j else 0.0}, 6) AS cov_{LINE[i]}_{LINE[j]}" for i in range(3) for j in range(i, 3)]])
    + " FROM b JOIN q ON b.bin_key = q.bin_key GROUP BY 1",
    "adjacent_pairs": f"WITH RECURSIVE {_ADJACENT} SELECT marker, comp, {', '.join(f'round({c}, 5) AS {c}' for c in _SIX)} FROM adj",
    "cutoff_filter": f"{_BISECTION} SELECT marker, comp, round(pos, 5) AS pos FROM (SELECT *, max(pos) OVER (PARTITION BY marker ORDER BY comp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM pos WHERE pos >= 0.5) WHERE before IS NULL OR pos > before",
    "cutoff_bisection": f"{_BISECTION} SELECT marker, comp, round(pos, 5) AS pos FROM pos",
    "gmm1d_bic_bias": "SELECT event_type, n, CAST(k AS INTEGER) AS k, round(exp(-3.7 + 0.732 * ln(n)) * k * ln(n) / ln(2.0), 6) AS bias FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1), (VALUES (1), (2), (3)) AS t(k)",
    "neg_split_moments": """WITH x AS (SELECT CAST(c_acctbal AS DOUBLE) AS x FROM customer), n AS (SELECT count(*) FILTER (x < 0) AS low, count(*) FILTER (x <> 0) AS every FROM x)
SELECT CAST(1 AS INTEGER) AS comp, round(any_value(low / every), 8) AS pro, round(avg(x), 5) AS mean, round(var_samp(x), 2) AS var FROM x, n WHERE x < 0
UNION ALL SELECT CAST(2 AS INTEGER), round(any_value(1 - low / every), 8), round(avg(x), 5), round(var_pop(x), 2) FROM x, n WHERE x > 0""",
    "find_to_merge": f"WITH RECURSIVE {_MIX} SELECT marker, string_agg(CAST(comp AS VARCHAR), ',' ORDER BY comp) AS comps FROM mix WHERE mean < 0.5 GROUP BY 1 HAVING count(*) > 1",
    "reduce_low": _reduce_sql(),
    "e_step": f"{_R} SELECT vec_id, CAST(component AS INTEGER) AS component, round(r, 6) AS r FROM r",
    "weighted_loglik": f"{_Z}, {_TOTAL} SELECT round(sum(total * (1 + vec_id % 3)), 5) AS loglik FROM t",
    "m_step": f"""{_R}, n AS (SELECT count(*) / 3 AS m, sum(w) / 3 AS total FROM r), q AS (SELECT r.*, w * r / total AS wr, m FROM r, n),
s AS (SELECT component, any_value(m) AS m, sum(wr) AS s0, sum(wr * x0) AS a, sum(wr * x1) AS b, sum(wr * x0 * x0) AS aa, sum(wr * x0 * x1) AS ab, sum(wr * x1 * x1) AS bb, sum(sqrt(wr) * x0) AS ta, sum(sqrt(wr) * x1) AS tb FROM q GROUP BY 1)
SELECT CAST(component AS INTEGER) AS component, round(s0, 6) AS pro, round(a / s0, 6) AS mean_0, round(b / s0, 6) AS mean_1,
"""
    + ",\n".join(f"round(m / s0 * (({u}{v} - {'t' + u} * {'t' + v} / m) / (m - 1) + {'t' + u} * {'t' + v} / (m * m)) - {u} * {v} / (s0 * s0) + {ridge}, 6) AS cov_{i}{j}" for u, v, i, j, ridge in (("a", "a", 0, 0, 0.01), ("a", "b", 0, 1, 0.0), ("b", "b", 1, 1, 0.01)))
    + " FROM s",
    "variance_correction": f"{_R}, n AS (SELECT sum(w) / 3 AS total FROM r), s AS (SELECT component, sum(w * r) / any_value(total) AS s0 FROM r, n GROUP BY 1), p AS (SELECT * FROM "
    + _values([(k + 1, float(MODEL.pro[k]), *map(float, MODEL.mean[k]), *map(float, (MODEL.cov[k, 0, 0], MODEL.cov[k, 0, 1], MODEL.cov[k, 1, 1]))) for k in range(3)], "component, pro, mean_0, mean_1, c00, c01, c11")
    + ") SELECT CAST(p.component AS INTEGER) AS component, round(pro, 6) AS pro, round(mean_0, 6) AS mean_0, round(mean_1, 6) AS mean_1, round(c00 + 0.001 * s0 / pro, 6) AS cov_00, round(c01, 6) AS cov_01, round(c11 + 0.002 * s0 / pro, 6) AS cov_11 FROM p JOIN s ON p.component = s.component",
    "em_fit": _em_sql(),
    "gmm1d_whole": _whole_fit_sql(),
    "gmm1d_whole_icl": _whole_fit_sql(icl=True),
    "gmm1d_whole_refit": _whole_refit_sql(),
    "categorical_merge": f"WITH {_MAP_SQL} SELECT CAST(component AS INTEGER) AS component, array_to_string(levels, '') AS key, CAST(cluster AS INTEGER) AS cluster FROM g",
    "cluster_centers": f"WITH {_LONG_SQL} SELECT CAST(cluster AS INTEGER) AS cluster, marker, round(center, 8) AS center FROM ctr",
    "cluster_sds": f"WITH {_SD_SQL} SELECT CAST(cluster AS INTEGER) AS cluster, marker, round(center, 8) AS center, round(sd, 8) AS sd FROM sd",
    "phenotypes": f"WITH {_CLUSTER_SQL} SELECT CAST(cluster AS INTEGER) AS cluster, CAST(m1 AS INTEGER) AS qty, CAST(m2 AS INTEGER) AS price, CAST(m3 AS INTEGER) AS disc FROM cl",
    "rule_label": f"WITH {_CLUSTER_SQL}, ru AS (SELECT * FROM {_values(RULES, 'rule_order, label, m1, m2')}) SELECT CAST(c.cluster AS INTEGER) AS cluster, coalesce(arg_min(r.label, r.rule_order), 'UNK') AS func FROM cl c LEFT JOIN ru r ON NOT (r.m1 = 'hi' AND c.m1 = 1 OR r.m1 = 'lo' AND c.m1 > 1 OR r.m2 = 'hi' AND c.m2 = 1 OR r.m2 = 'lo' AND c.m2 > 1) GROUP BY 1",
    "label_string": f"""WITH {_CLUSTER_SQL}, ru AS (SELECT * FROM {_values(RULES, "rule_order, label, m1, m2")}),
fu AS (SELECT c.cluster, c.m1, c.m2, c.m3, arg_min(r.label, r.rule_order) AS func, arg_min(r.m1, r.rule_order) AS r1, arg_min(r.m2, r.rule_order) AS r2 FROM cl c LEFT JOIN ru r ON NOT (r.m1 = 'hi' AND c.m1 = 1 OR r.m1 = 'lo' AND c.m1 > 1 OR r.m2 = 'hi' AND c.m2 = 1 OR r.m2 = 'lo' AND c.m2 > 1) GROUP BY ALL),
o AS (SELECT cluster, coalesce(func, 'UNK') AS func, CASE WHEN func IS NOT NULL AND r1 = 'dc' THEN m1 END AS l1, CASE WHEN func IS NOT NULL AND r2 = 'dc' THEN m2 END AS l2, m3 AS l3 FROM fu),
nn AS (SELECT *, coalesce(l1 = 2, FALSE) OR coalesce(l2 = 2, FALSE) OR l3 = 2 AS mid FROM o)
SELECT CAST(cluster AS INTEGER) AS cluster, func, func || CASE WHEN mid THEN CASE WHEN l1 = 2 THEN ' qty+' ELSE '' END || CASE WHEN l2 = 2 THEN ' price+' ELSE '' END || CASE WHEN l3 = 2 THEN ' disc+' ELSE '' END ELSE CASE WHEN l1 = 3 THEN ' qty++' ELSE '' END || CASE WHEN l2 = 3 THEN ' price++' ELSE '' END || CASE WHEN l3 = 3 THEN ' disc++' ELSE '' END END AS label FROM nn""",
    "fit_predict_whole": _whole_flagship_sql(),
    "predict_many": _many_sql(),
    "predict_component": f"{_Z} SELECT vec_id, CAST({_WHICH} AS INTEGER) AS component FROM z",
    "predict_cluster": f"{_Z} SELECT vec_id, CAST({_WHICH} AS INTEGER) AS component, CAST(CASE WHEN {_WHICH} = 2 THEN 1 ELSE 2 END AS INTEGER) AS cluster FROM z",
    "cluster_counts": f"{_Z} SELECT CAST(CASE WHEN {_WHICH} = 2 THEN 1 ELSE 2 END AS INTEGER) AS cluster, count(*) AS n FROM z GROUP BY 1",
    "kde_linear_bin": f"WITH {_KDE}, {_kde_sql('k')} SELECT marker, grid_idx, round(mass, 5) AS mass FROM k_b",
    "kde_curve": f"WITH {_KDE}, {_kde_sql('k')} SELECT marker, grid_idx, {_ROUND_XY} FROM k",
    "kde_overlay": f"WITH {_KDE}, {_kde_sql('k')}, {_kde_sql('o', "event_type = 'click'")} SELECT 'data' AS series, marker, grid_idx, {_ROUND_XY} FROM k UNION ALL SELECT 'overlay', marker, grid_idx, {_ROUND_XY} FROM o",
    "kde_with_cutoffs": f"WITH {_KDE}, {_kde_sql('k')} SELECT marker, grid_idx, {_ROUND_XY}, CAST(2 AS INTEGER) AS n_cutoffs FROM k",
    "mixture_curve": f"{_CURVES}, s AS (SELECT marker, idx, any_value(x) AS x, sum(y) AS y FROM d GROUP BY 1, 2) SELECT marker, idx, {_ROUND_XY} FROM s",
    "component_curves": f"{_CURVES} SELECT marker, CAST(component AS INTEGER) AS component, idx, {_ROUND_XY} FROM d",
    "univariate_curves": f"{_CURVES}, ev{_KDE[1:]}, {_kde_sql('kd').replace('FROM e WHERE', 'FROM ev WHERE')}, su AS (SELECT idx, any_value(x) AS x, sum(y) AS y FROM d GROUP BY 1) SELECT 'kde' AS panel, CAST(0 AS INTEGER) AS component, {_ROUND_XY} FROM kd UNION ALL SELECT 'mixture', CAST(0 AS INTEGER), {_ROUND_XY} FROM su UNION ALL SELECT 'components', CAST(component AS INTEGER), {_ROUND_XY} FROM d",
    "cluster_logsize": f"WITH {_MAP_SQL}, sh AS (SELECT cluster, sum(pro) AS share FROM g GROUP BY 1), me AS (SELECT avg(ln(share)) AS mean FROM sh) SELECT CAST(cluster AS INTEGER) AS cluster, round(share, 8) AS share, round(ln(share) * 9.0 / mean, 8) AS logsize FROM sh, me",
    "legend_marker": f"WITH {_LONG_SQL} SELECT marker, round(max(center) - min(center), 8) AS amplitude FROM ctr GROUP BY 1 ORDER BY max(center) - min(center) DESC, marker LIMIT 1",
    "phenobars": f"WITH {_SD_SQL}, ba AS (SELECT cluster, marker, center AS mfi, sd, center - sd AS lo, center + sd AS hi, CASE marker WHEN 'qty' THEN 2.25 ELSE 2.0 END AS midpt FROM sd WHERE cluster IN (1, 2) AND marker IN ('qty', 'price')), ax AS (SELECT least(0, min(lo)) AS ymin, max(hi) AS ymax FROM ba) SELECT CAST(cluster AS INTEGER) AS cluster, CAST(cluster AS VARCHAR) AS name, marker, "
    + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in ("mfi", "sd", "lo", "hi", "midpt", "ymin", "ymax"))
    + " FROM ba, ax",
    "cluster_vs_global_kde": f"WITH {_KDE.replace('event_type FROM', 'event_type, event_id % 3 AS cluster FROM')}, {_kde_sql('k')}, {_kde_sql('o', 'cluster = 1')} SELECT 'all' AS series, marker, grid_idx, round(0.8 * y / max(y) OVER (PARTITION BY marker), 7) AS scaled FROM k UNION ALL SELECT 'cluster 1', marker, grid_idx, round(0.8 * y / max(y) OVER (PARTITION BY marker), 7) FROM o",
    "pairwise_center_dist": "WITH c AS (SELECT CAST(label + 1 AS INTEGER) AS cluster, " + ", ".join(f"avg(CAST(embedding[{i + 1}] AS DOUBLE)) AS c{i}" for i in range(4)) + " FROM embeddings GROUP BY 1) SELECT a.cluster AS a, b.cluster AS b, round(sqrt(" + " + ".join(f"pow(a.c{i} - b.c{i}, 2)" for i in range(4)) + "), 6) AS distance FROM c a JOIN c b ON a.cluster < b.cluster",
}
