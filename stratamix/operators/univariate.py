"""One-dimensional mixtures for each column, all fitted by the same passes over the rows, and the cutoffs between their components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normal import Fit1D, best_1d, cutoff, em_1d, least_variance, reduced, settled, stepped_1d, sums_1d, with_negative
from ..sources.frame import default_fraction, features, release, sample_rows, sample_size

SCHEMA = "marker string, comp int, pro double, mean double, var double"
#: Cells of the histogram from which fits begin, and passes over the rows at most.
HISTOGRAM, MOST_STEPS = 8192, 500
_NAMES = ["fit", "comp", "s0", "s1", "s2", "loglik", "certainty"]


@dataclass
class _Fit:
    """A mixture of one column while it is fitted: all its values, or those above zero."""

    marker: str
    positive: bool
    floor: float
    shares: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    before: float = -np.inf
    loglik: float = -np.inf
    certainty: float = 0.0

    def step(self, sums: np.ndarray, loglik: float, certainty: float) -> bool:
        """Takes the sums of a pass; whether that pass was the last."""
        self.before, self.loglik, self.certainty = self.loglik, loglik, certainty
        if settled(loglik, self.before):
            return True
        self.shares, self.means, self.variances = stepped_1d(sums, self.means, self.floor)
        return False

    def result(self) -> Fit1D:
        by = np.argsort(self.means, kind="stable")
        return Fit1D(self.shares[by], self.means[by], self.variances[by], self.loglik, self.certainty)


def _statistics(rows: DataFrame, params: Sequence[str]) -> dict[str, dict]:
    """By column: number, extremes and variance of its values and of those above zero, and number, mean and variance below. One aggregation."""
    cells = []
    for i, p in enumerate(params):
        x = F.col(f"`{p}`")
        known = x.isNotNull() & ~F.isnan(x)
        for part, chosen in (("all", known), ("high", known & (x > 0)), ("low", known & (x < 0))):
            v = F.when(chosen, x)
            for what, of in (("n", F.count), ("min", F.min), ("max", F.max), ("mean", F.avg), ("var", F.var_pop), ("sample", F.var_samp)):
                cells.append(of(v).alias(f"{i}_{part}_{what}"))
    row = rows.agg(*cells).first()
    return {p: {part: {what: row[f"{i}_{part}_{what}"] for what in ("n", "min", "max", "mean", "var", "sample")} for part in ("all", "high", "low")} for i, p in enumerate(params)}


def condensed(rows: DataFrame, ranges: dict[str, tuple[bool, float, float]]) -> DataFrame:
    """(marker, x, weight, values): means and counts over HISTOGRAM equal cells between two ends, for each column.

    ``ranges``: whether values above zero count alone, and the ends. ``values`` is 2 where a cell has different values, else 1.
    """
    cells = []
    for m, (positive, low, high) in ranges.items():
        x = F.col(f"`{m}`")
        at = F.least(F.floor((x - F.lit(low)) / F.lit(high - low) * HISTOGRAM), F.lit(HISTOGRAM - 1)) if high > low else F.lit(0)
        cells.append(F.when(x.isNotNull() & ~F.isnan(x) & (x > 0 if positive else F.lit(True)), F.struct(F.lit(m).alias("marker"), at.cast("int").alias("at"), x.alias("x"))))
    points = rows.select(F.explode(F.array(*cells)).alias("c")).filter("c is not null").select("c.*")
    different = F.when(F.min("x") < F.max("x"), 2).otherwise(1)
    return points.groupBy("marker", "at").agg(F.avg("x").alias("x"), F.count(F.lit(1)).cast("double").alias("weight"), different.alias("values")).drop("at")


def _begun(rows: DataFrame, wanted: dict[str, Sequence[int]], stats: dict[str, dict], positive: dict[str, bool]) -> list[_Fit]:
    """The mixtures that EM on the histograms finds, for each column and number of components that it has the values for."""
    part = {m: "high" if positive[m] else "all" for m in wanted}
    ranges = {m: (positive[m], float(stats[m][part[m]]["min"]), float(stats[m][part[m]]["max"])) for m in wanted}
    floors = {m: least_variance(float(stats[m][part[m]]["var"])) for m in wanted}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        m, values = pdf.marker.iloc[0], int(pdf["values"].sum())
        x, w = pdf.x.to_numpy(), pdf.weight.to_numpy()
        fits = [em_1d(x, k, w, floor=floors[m]) for k in dict.fromkeys(min(k, values) for k in wanted[m])]
        return pd.DataFrame([(m, len(f.means), c + 1, f.shares[c], f.means[c], f.variances[c]) for f in fits for c in range(len(f.means))], columns=["marker", "k", "comp", "pro", "mean", "var"])

    # at most HISTOGRAM rows a group
    found = condensed(rows, ranges).groupBy("marker").applyInPandas(fit, "marker string, k int, comp int, pro double, mean double, var double").toPandas()
    fits = []
    for (m, _), part_ in found.sort_values(["marker", "k", "comp"]).groupby(["marker", "k"], sort=True):
        fits.append(_Fit(m, positive[m], floors[m], *(part_[c].to_numpy(float) for c in ("pro", "mean", "var"))))
    return fits


def _pass(rows: DataFrame, fits: Sequence[_Fit]) -> dict[int, tuple[np.ndarray, float, float]]:
    """The sums of all rows for all mixtures, in one aggregation; a task hands over a row for each component."""
    columns = list(dict.fromkeys(f.marker for f in fits))
    models = [(columns.index(f.marker), f.positive, f.shares, f.means, f.variances) for f in fits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            known = [x[~np.isnan(x)] for x in (c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns)]
            for i, (column, positive, *fit) in enumerate(models):
                x = known[column]
                x = x[x > 0] if positive else x
                if len(x):
                    new = sums_1d(x, np.ones(len(x)), *fit)
                    held[i] = [a + c for a, c in zip(held[i], new, strict=True)] if i in held else list(new)
        flat = [(i, c, *map(float, sums[c]), loglik if c == 0 else 0.0, certainty if c == 0 else 0.0) for i, (sums, loglik, certainty) in held.items() for c in range(len(sums))]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*flat, strict=True)], names=_NAMES)

    parts = rows.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, "fit long, comp long, s0 double, s1 double, s2 double, loglik double, certainty double")
    whole = parts.groupBy("fit", "comp").agg(*[F.sum(c).alias(c) for c in _NAMES[2:]]).orderBy("fit", "comp").collect()  # a row a component
    out: dict[int, tuple[np.ndarray, float, float]] = {}
    for i in range(len(fits)):
        own = [r for r in whole if r.fit == i]
        out[i] = (np.array([[r.s0, r.s1, r.s2] for r in own]), sum(r.loglik for r in own), sum(r.certainty for r in own))
    return out


def fitted(rows: DataFrame, wanted: dict[str, Sequence[int]], *, separate_negative: bool = False) -> dict[str, tuple[float, list[Fit1D]]]:
    """By column, the number of values and a mixture for each wanted number of components.

    EM on a histogram of HISTOGRAM cells gives where to begin; then each pass over the rows is a step of EM with all columns,
    numbers of components and values, until no log-likelihood changes by more than a millionth. ``separate_negative``: a column
    with values on both sides of zero is fitted above it, with a component in front for those below; zeros are left out. Nulls
    and NaN don't count; a column without values has no mixtures. A column gets no more components than it has values that
    are extremes of their cells.
    """
    params = list(wanted)
    stats = _statistics(rows, params)
    params = [p for p in params if stats[p]["all"]["n"]]
    positive = {p: bool(separate_negative and stats[p]["high"]["n"] and stats[p]["low"]["n"]) for p in params}
    fits = _begun(rows, {p: wanted[p] for p in params}, stats, positive) if params else []
    going = list(fits)
    for _ in range(MOST_STEPS):
        if not going:
            break
        sums = _pass(rows, going)
        going = [f for i, f in enumerate(going) if not f.step(*sums[i])]
    out: dict[str, tuple[float, list[Fit1D]]] = {}
    for p in params:
        own = [f.result() for f in fits if f.marker == p]
        if positive[p]:
            low, high = stats[p]["low"], stats[p]["high"]
            own = [with_negative(f, (low["n"], low["mean"], low["sample"]), high["n"]) for f in own]
        out[p] = (float(stats[p]["high" if positive[p] else "all"]["n"]), own)
    return out


def _table(spark, chosen: dict[str, Fit1D]) -> DataFrame:
    rows = [(m, c + 1, float(f.shares[c]), float(f.means[c]), float(f.variances[c])) for m, f in chosen.items() for c in range(len(f.means))]
    return spark.createDataFrame(rows, SCHEMA)


def fit_univariate(df: DataFrame, params: Sequence[str], max_mixture: int = 3, criterion: str = "bic", sample_fraction: float = 0.05, seed: int = 0, prior_bic: float | None = None, n: int | None = None) -> DataFrame:
    """A mixture for each column: (marker, comp from 1 by ascending mean, pro, mean, var).

    The number of components is the best by biased BIC (``prior_bic`` sets another bias), or by ICL. ``n`` is the number of rows,
    where it is known. See ``fitted``.
    """
    rows = features(df, params)
    n = rows.count() if n is None else n
    sample = sample_rows(rows, sample_size(n, sample_fraction), n, seed)
    rows = sample.persist()
    fits = fitted(rows, {p: range(1, max_mixture + 1) for p in params})
    rows.unpersist()
    release(sample)
    return _table(df.sparkSession, {p: best_1d(own, size, criterion, prior_bic) for p, (size, own) in fits.items()})


def fit_univariate_default(df: DataFrame, params: Sequence[str], seed: int = 0) -> DataFrame:
    """``fit_univariate`` with up to three components and the share of rows that their number calls for."""
    n = df.count()
    return fit_univariate(df, params, 3, "bic", default_fraction(n), seed, n=n)


def refit_univariate(df: DataFrame, components: dict[str, int], mixtures: DataFrame, sample_fraction: float = 0.2, separate_negative: bool = False, seed: int = 0) -> DataFrame:
    """``mixtures`` with the named markers fitted anew with a fixed number of components; new markers are added. See ``fitted``."""
    params = list(components)
    rows = features(df, params)
    n = rows.count()
    sample = sample_rows(rows, sample_size(n, sample_fraction, floor=0), n, seed)
    rows = sample.persist()
    fits = fitted(rows, {p: [k] for p, k in components.items()}, separate_negative=separate_negative)
    rows.unpersist()
    release(sample)
    new = {}
    for p, (_, (f, *_)) in fits.items():
        by = np.argsort(f.means, kind="stable")
        new[p] = Fit1D(f.shares[by], f.means[by], f.variances[by], f.loglik, f.certainty)
    return mixtures.filter(~F.col("marker").isin(params)).select("marker", "comp", "pro", "mean", "var").unionByName(_table(df.sparkSession, new))


def merge_candidates(mixtures: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(marker, comps): components with a mean below the threshold, where a marker has two or more."""
    low = mixtures.filter(F.col("mean") < threshold).groupBy("marker").agg(F.array_sort(F.collect_list("comp")).alias("comps"))
    return low.filter(F.size("comps") > 1)


def reduce_low(mixtures: DataFrame, threshold: float = 0.5, most: float = 0.05) -> DataFrame:
    """``mixtures`` in which a marker's ``merge_candidates`` have become fewer: pairs are pooled, moments kept, while that costs at most ``most`` nats.

    Components that describe one mode then leave no cutoff between them. Markers without candidates stay; components are
    numbered anew by ascending mean.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low = pdf.comp.isin(pdf.comps.iloc[0]) if pdf.comps.iloc[0] is not None else pdf.comp < 0
        cells = ["pro", "mean", "var"]
        pdf = pdf.sort_values("comp")
        rest = [tuple(r) for r in pdf.loc[~low, cells].to_numpy(float)]
        rows = sorted([*reduced([tuple(r) for r in pdf.loc[low, cells].to_numpy(float)], most), *rest], key=lambda c: c[1])
        return pd.DataFrame([(pdf.marker.iloc[0], i, *c) for i, c in enumerate(rows, 1)], columns=["marker", "comp", *cells])

    both = mixtures.join(merge_candidates(mixtures, threshold), "marker", "left")
    return both.groupBy("marker").applyInPandas(run, SCHEMA)  # a few rows a marker


def adjacent_pairs(mixtures: DataFrame) -> DataFrame:
    """Each component with the next of its marker."""
    w = W.partitionBy("marker").orderBy("comp")
    out = mixtures.select("marker", "comp", "pro", "mean", "var", *[F.lead(c).over(w).alias(f"next_{c}") for c in ("pro", "mean", "var")])
    return out.filter(F.col("next_mean").isNotNull())


def kept_cutoffs(candidates: DataFrame, floor: float = 0.5) -> DataFrame:
    """Of (marker, comp, pos), the positions of at least ``floor`` that exceed all before them."""
    w = W.partitionBy("marker").orderBy("comp").rowsBetween(W.unboundedPreceding, -1)
    before = F.max("pos").over(w)
    return candidates.filter(F.col("pos") >= floor).withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("pos") > F.col("_before"))).drop("_before")


def crossings(mixtures: DataFrame) -> DataFrame:
    """(marker, comp, pos): where each component's density crosses the next one's; see ``normal.cutoff``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pos = [cutoff(r.pro, r.mean, r.var**0.5, r.next_pro, r.next_mean, r.next_var**0.5) for r in b.itertuples()]
            yield pd.DataFrame({"marker": b.marker, "comp": b.comp, "pos": np.array(pos, float)})

    return adjacent_pairs(mixtures).mapInPandas(run, "marker string, comp int, pos double")


def cutoffs_of(mixtures: DataFrame, params: Iterable[str] | None = None, floor: float = 0.5) -> dict[str, list[float]]:
    """Cutoffs by marker; a marker with one component has no entry, one whose cutoffs all fall away has an empty one."""
    found = crossings(mixtures).persist()
    by: dict[str, list[float]] = {r.marker: [] for r in found.select("marker").distinct().orderBy("marker").collect()}  # a few rows for each column
    for r in kept_cutoffs(found, floor).orderBy("marker", "comp").collect():
        by[r.marker].append(r.pos)
    found.unpersist()
    return {m: by[m] for m in (params or by) if m in by}
