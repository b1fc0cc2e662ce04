import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamix.functions.normal import choose_1d, em_1d, merge_cost, pooled, reduced
from stratamix.operators import univariate

COLUMNS = "marker string, comp int, pro double, mean double, var double"


def test_refit_uses_the_whole_sample(spark, monkeypatch):
    """A small component far out and the negative part rest on all rows, however coarse the histogram is from which fits begin."""
    monkeypatch.setattr(univariate, "HISTOGRAM", 16)
    part = F.col("id") % 1000
    x = F.when(part < 3, -5 - part).when(part < 6, 100 + part).when(part < 10, 0.0).otherwise(1 + (F.col("id") % 97) / 97)
    df = spark.range(40_000).select(x.cast("double").alias("x"))
    none = spark.createDataFrame([], univariate.SCHEMA)
    low, main, far = univariate.refit_univariate(df, {"x": 2}, none, sample_fraction=1.0, separate_negative=True).orderBy("comp").collect()
    n = 40 * 996
    assert low.pro == pytest.approx(120 / n) and low.mean == pytest.approx(-6.0) and low["var"] == pytest.approx(80 / 119)
    assert far.pro == pytest.approx(120 / n, rel=1e-3) and far.mean == pytest.approx(104.0, rel=1e-3)
    assert main.pro == pytest.approx((n - 240) / n, rel=1e-3)


def test_prior_bic_sets_the_bias(spark):
    df = spark.range(4000).select((F.when(F.col("id") % 2 == 0, 0.0).otherwise(6.0) + F.randn(3) * 0.5).alias("x"))
    assert univariate.fit_univariate(df, ["x"], 3, sample_fraction=1.0, prior_bic=0.0).count() >= 2
    assert univariate.fit_univariate(df, ["x"], 3, sample_fraction=1.0, prior_bic=1e6).count() == 1


@pytest.fixture(scope="module")
def columns(spark):
    r = np.random.default_rng(12)
    a = np.r_[r.normal(0, 1, 6000), r.normal(5, 0.7, 3000)]
    b = np.where(np.arange(9000) % 10 == 0, np.nan, r.normal(3, 2, 9000))
    return a, b, spark.createDataFrame([(float(x), None if np.isnan(y) else float(y), 4.0, None) for x, y in zip(a, b, strict=True)], "a double, b double, c double, d double").repartition(5).persist()


@pytest.mark.parametrize("cells", [16, 8192])
def test_all_columns_end_where_plain_em_does(spark, columns, monkeypatch, cells):
    """The same as EM on all values at once, wherever the histogram begins; nulls and empty columns aside."""
    monkeypatch.setattr(univariate, "HISTOGRAM", cells)
    a, b, df = columns
    got = univariate.fitted(df, {"a": [1, 2], "b": [1], "c": [1, 2, 3], "d": [1]})
    assert list(got) == ["a", "b", "c"] and got["b"][0] == 8100
    two = em_1d(a, 2, tolerance=1e-12, most=5000)
    assert got["a"][1][1].means == pytest.approx(two.means, abs=0.02) and got["a"][1][1].shares == pytest.approx(two.shares, abs=0.01)
    assert got["a"][1][1].loglik == pytest.approx(two.loglik, rel=1e-4)
    assert got["b"][1][0].means == pytest.approx([np.nanmean(b)]) and got["b"][1][0].variances == pytest.approx([np.nanvar(b)])
    assert len(got["c"][1]) == 1 and got["c"][1][0].means == [4.0]


def test_choices_are_those_of_the_local_kernel(spark, columns):
    a, b, df = columns
    for criterion in ("bic", "icl"):
        got = univariate.fit_univariate(df, ["a", "b"], 3, criterion, sample_fraction=1.0).groupBy("marker").count().collect()
        assert {r.marker: r["count"] for r in got} == {"a": len(choose_1d(a, 3, criterion).means), "b": len(choose_1d(b[~np.isnan(b)], 3, criterion).means)}


def test_a_pass_is_one_aggregation_of_rows_for_components(spark, columns):
    """However many rows, columns and numbers of components: tasks hand over a row for each component."""
    _, _, df = columns
    fits = univariate._begun(df.select("a", "b"), {"a": [1, 2, 3], "b": [2]}, univariate._statistics(df.select("a", "b"), ["a", "b"]), {"a": False, "b": False})
    sums = univariate._pass(df.select("a", "b"), fits)
    assert len(sums) == 4 and [len(s[0]) for s in sums.values()] == [1, 2, 3, 2]
    assert sums[0][0][0, 0] == pytest.approx(9000) and sums[3][0][:, 0].sum() == pytest.approx(8100)


def test_low_components_of_one_mode_are_pooled(spark):
    """One skewed mode that took two components leaves no cutoff once they are pooled; the others stay, and so do the moments."""
    rows = [("a", 1, 0.35, 0.10, 0.02), ("a", 2, 0.25, 0.30, 0.04), ("a", 3, 0.40, 3.0, 0.2), ("b", 1, 0.5, 0.0, 0.01), ("b", 2, 0.5, 0.45, 0.0001), ("c", 1, 0.6, 0.2, 0.1), ("c", 2, 0.4, 2.0, 0.1)]
    mixtures = spark.createDataFrame(rows, COLUMNS)
    got = univariate.reduce_low(mixtures, 0.5, 0.2).orderBy("marker", "comp").collect()
    assert [(r.marker, r.comp) for r in got] == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1), ("c", 2)]
    assert got[0].pro == pytest.approx(0.6) and got[0].mean == pytest.approx((0.035 + 0.075) / 0.6)
    second = (0.35 * (0.02 + 0.01) + 0.25 * (0.04 + 0.09)) / 0.6
    assert got[0]["var"] == pytest.approx(second - got[0].mean ** 2)
    assert len(univariate.cutoffs_of(mixtures, floor=0.0)["a"]) == 2 and len(univariate.cutoffs_of(univariate.reduce_low(mixtures, 0.5, 0.2), floor=0.0)["a"]) == 1
    assert univariate.reduce_low(mixtures, 0.5, 0.0).orderBy("marker", "comp").collect() == mixtures.orderBy("marker", "comp").collect()


def test_the_cost_of_pooling_bounds_the_divergence():
    x = np.linspace(-12, 12, 40_001)
    density = lambda parts: sum(p * np.exp(-0.5 * (x - m) ** 2 / v) / np.sqrt(2 * np.pi * v) for p, m, v in parts)
    r = np.random.default_rng(3)
    for _ in range(20):
        p = r.dirichlet([1, 1, 1])
        parts = [(float(a), float(r.normal(0, 2)), float(r.uniform(0.3, 2))) for a in p]
        before, after = density(parts), density([pooled(parts[0], parts[1]), parts[2]])
        apart = (before * np.log(before / after)).sum() * (x[1] - x[0])
        assert -1e-6 < apart <= merge_cost(parts[0], parts[1]) + 1e-6
    assert len(reduced([(0.5, 0.0, 1.0), (0.3, 0.1, 1.0), (0.2, 9.0, 1.0)], 0.05)) == 2
